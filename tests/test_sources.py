import datetime as dt
import json

import pytest

from quantloom import cli, session
from quantloom.operators import simulator as S
from quantloom.plans import strategies
from quantloom.sources import bars, calendars, filings, sinks


def write_csv(folder, symbol, n=80):
    with open(folder / f"{symbol}.csv", "w") as f:
        f.write("Date,Open,High,Low,Close,Volume\n")
        for i in range(n):
            c = 100 + (i % 20) * (1 if (i // 20) % 2 else -1)
            f.write(f"{dt.date(2020, 1, 1) + dt.timedelta(days=i)},{c},{c + 1},{c - 1},{c},1000\n")


def test_csv_source_and_cli(spark, tmp_path, capsys):
    data = tmp_path / "data"
    data.mkdir()
    for s in ("AA", "BB"):
        write_csv(data, s)
    b = bars.read_csv(spark, str(data), "2020-01-10", "2020-02-01")
    assert {r.symbol for r in b.collect()} == {"AA", "BB"} and b.count() == 46
    (tmp_path / "c.toml").write_text('strategy = "sma_crossover"\n')
    args = ["run", "--config", str(tmp_path / "c.toml"), "--data", str(data), "--params", json.dumps({"sma_fast": 3, "sma_slow": 8}), "--set", "max_alloc=0.5", "--save", str(tmp_path / "r1"), "--tearsheet", str(tmp_path / "t.html")]
    assert cli.main(args) == 0 and "sharpe" in capsys.readouterr().out
    assert "<svg" in (tmp_path / "t.html").read_text()
    loaded = sinks.load(spark, str(tmp_path / "r1"))
    assert loaded["equity"].count() == 80
    assert sinks.compare(spark, [str(tmp_path / "r1")]).where("metric = 'sharpe'").count() == 1
    assert cli.main(["optimize", "--data", str(data), "--grid", json.dumps({"sma_fast": [2, 4], "sma_slow": [8]})]) == 0
    assert cli.main(["walk-forward", "--data", str(data), "--params", json.dumps({"sma_fast": 3, "sma_slow": 8}), "--is-months", "1", "--oos-months", "1"]) == 0
    assert cli.main(["stress-test", "--data", str(data), "--params", json.dumps({"sma_fast": 3, "sma_slow": 8}), "--ranges", json.dumps([["x", "2020-01-01", "2020-02-01"]])]) == 0
    (tmp_path / "c.yaml").write_text("strategy: sma_crossover\nparams: {sma_fast: 3, sma_slow: 8}\n")
    common = ["--config", str(tmp_path / "c.yaml"), "--data", str(data)]
    capsys.readouterr()
    assert cli.main(["run", *common, *[x for name in sorted(cli.REPORTS) for x in ("--report", name)]]) == 0
    shown = capsys.readouterr().out
    assert all(f"\n{name}\n" in shown for name in cli.REPORTS) and "optimal_days" in shown and "p_value" in shown
    assert cli.main(["walk-forward", *common, "--folds", "3", "--metric", "cagr"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["optimize", *common, "--metric", "nothing"])
    assert cli.main(["list-strategies"]) == 0 and "momentum_rotation" in capsys.readouterr().out
    (tmp_path / "bad.toml").write_text("nothing = 1\n")
    with pytest.raises(SystemExit):
        cli.main(["run", "--config", str(tmp_path / "bad.toml"), "--data", str(data)])


def test_activity_csv(spark, tmp_path):
    rows = [("r", "A", dt.date(2020, 1, 1) + dt.timedelta(days=i), 10.0, 11.0, 9.0, 10.0, 1000.0, i == 0, i == 2) for i in range(5)]
    f = spark.createDataFrame(rows, "run_id string, symbol string, date date, open double, high double, low double, close double, volume double, buy boolean, sell boolean")
    sinks.write_activity_csv(S.simulate(f), str(tmp_path / "a"))
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).count() == 2


def test_cache_round_trip(spark, tmp_path, monkeypatch):
    b = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0), ("B", dt.date(2020, 1, 2), 2.0, 2.0, 2.0, 2.0, 2.0)], bars.BAR_SCHEMA)
    bars.write_cache(b, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).where("symbol = 'B'").count() == 1
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert cli.main(["clear-cache", str(tmp_path / "c")]) == 1 and (tmp_path / "c" / "symbol=A").exists()
    assert cli.main(["clear-cache", str(tmp_path / "c"), "--ticker", "a", "--yes"]) == 0
    assert not (tmp_path / "c" / "symbol=A").exists() and (tmp_path / "c" / "symbol=B").exists()
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "text.txt").write_text("kept")
    assert cli.main(["clear-cache", str(tmp_path / "other"), "--yes"]) == 1 and (tmp_path / "other" / "text.txt").exists()
    monkeypatch.setattr("builtins.input", lambda _: "y")
    assert cli.main(["clear-cache", str(tmp_path / "c")]) == 0 and not (tmp_path / "c").exists()


def test_known_holidays(spark):
    days = {r.date for r in calendars.sessions(spark, "2019-01-01", "2024-12-31").collect()}
    closed = ["2019-01-01", "2019-04-19", "2020-04-10", "2021-04-02", "2022-04-15", "2023-04-07", "2024-03-29", "2021-07-05", "2022-06-20", "2023-11-23", "2021-12-24", "2022-12-26", "2024-01-15", "2024-05-27"]
    assert not days & {dt.date.fromisoformat(d) for d in closed}
    assert dt.date(2021, 12, 31) in days and dt.date(2020, 7, 2) in days
    assert sum(d.year == 2021 for d in days) == 252 and sum(d.year == 2023 for d in days) == 250


def test_resample_rejects_unknown_units(spark):
    with pytest.raises(ValueError):
        bars.resample(spark.createDataFrame([], bars.BAR_SCHEMA), "year")


def test_shared_dirs_differ(spark):
    assert session.shared_dir(spark, "x") != session.shared_dir(spark, "x")


def test_key_values_as_of(spark, tmp_path):
    (tmp_path / "v.csv").write_text("date,symbol,field,value\n2020-01-10, aa ,eps,1.5\n2020-02-10,AA,eps,n/a\n2020-03-01,AA,eps,2\n2020-03-01,AA,eps,2.5\n,AA,eps,9\n")
    values = filings.read_key_values(spark, str(tmp_path / "v.csv"))
    probes = spark.createDataFrame([("aa", "eps", dt.date(2020, m, 5)) for m in (1, 2, 3)] + [("ZZ", "eps", dt.date(2020, 3, 5))], "symbol string, field string, date date")
    got = {(r.symbol, r.date.month): r.value for r in filings.values_as_of(probes, values).collect()}
    assert got == {("AA", 1): None, ("AA", 2): 1.5, ("AA", 3): 2.5, ("ZZ", 3): None}


def test_put_call_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Remarks, on use\nProduct\nTrade_date,Call,Put,Total,P/C Ratio\n11/1/2006,10,5,15,0.5\n2006-11-02,10,x,15,\nnone,1,1,2,1\n")
    rows = filings.read_put_call(spark, str(tmp_path / "a.csv")).orderBy("date").collect()
    assert [(r.date.day, r.calls, r.puts, r.total, r.pcr) for r in rows] == [(1, 10.0, 5.0, 15.0, 0.5), (2, 10.0, None, 15.0, None)]
    (tmp_path / "b.csv").write_text("nothing\n")
    with pytest.raises(ValueError):
        filings.read_put_call(spark, str(tmp_path / "b.csv"))


def test_analyst_snapshot(spark, tmp_path):
    (tmp_path / "s.csv").write_text("symbol,up,down\naa,3,1\nBB,,2\n")
    assert [tuple(r) for r in filings.read_analyst(spark, str(tmp_path / "s.csv")).orderBy("symbol").collect()] == [("AA", 3, 1), ("BB", None, 2)]


def test_filings_replace_by_key(spark, tmp_path):
    day = lambda d: dt.date(2020, 1, d)
    schema = "symbol string, filed_date date, insider_name string, shares double, price double"
    first = spark.createDataFrame([("aa", day(1), "x", 5.0, 1.0), ("aa", day(2), "y", 5.0, 1.0), ("bb", day(1), "x", 5.0, 1.0)], schema)
    again = spark.createDataFrame([("aa", day(1), "x", 5.0, 2.0), ("aa", day(3), None, 1.0, 3.0)], schema)
    assert filings.read_cache(spark, str(tmp_path), "insider") is None
    for new in (first, again):
        filings.merge_into_cache(spark, str(tmp_path), "insider", new)
    cache = filings.read_cache(spark, str(tmp_path), "insider")
    assert {(r.symbol, r.filed_date.day, r.price) for r in cache.collect()} == {("AA", 1, 2.0), ("AA", 2, 1.0), ("AA", 3, 3.0), ("BB", 1, 1.0)}
    assert {(r.symbol, r.first.day, r.last.day) for r in filings.spans(cache).collect()} == {("AA", 1, 3), ("BB", 1, 1)}


def test_ranked_breaks_ties_by_symbol(spark):
    rows = [("A", 1.0), ("B", 1.0), ("C", None), ("D", 0.5)]
    df = spark.createDataFrame([(s, dt.date(2020, 1, 1), x) for s, x in rows], "symbol string, date date, x double")
    assert [r.symbol for r in strategies.ranked(df, "x", 2).orderBy("rank").collect()] == ["A", "B"]
    assert [r.symbol for r in strategies.ranked(df, "x", 2, largest=False).orderBy("rank").collect()] == ["D", "A"]
