"""A grid in one scan gives what each combination gives by itself."""

import datetime as dt
import random

import pytest

from quantloom.plans import grids, strategies

PARAMS = {"indicators": {"b": {"fn": "bollinger", "period": 10}, "r": {"fn": "rsi", "period": 5}}, "buy_when": [["close", "<", "b_lower"], ["r", "<", 40]], "sell_when": [["close", ">", "b_middle"]]}
GRID = {"indicators.b.period": [5, 10], "buy_when.1.2": [30, 60], "indicators.r.period": [3, 7]}


def walk(n):
    r, price, out = random.Random(4), 50.0, []
    for s in "AB":
        for i in range(n):
            price = max(5.0, price * (1 + r.gauss(0, 0.03)))
            out.append((s, dt.date(2020, 1, 1) + dt.timedelta(days=i), price * (1 + r.gauss(0, 0.01)), price * 1.03, price * 0.97, price, 1000.0))
    return out


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame(walk(120), "symbol string, date date, open double, high double, low double, close double, volume double").cache()


def test_each_combination_alone(spark, series):
    got = {(r.combo, r.symbol, r.date): (r.buy, r.sell) for r in grids.signals(series, PARAMS, GRID).collect()}
    assert len(got) == 8 * 240
    for n, values in enumerate(grids.combinations(GRID)):
        alone = strategies.get_strategy("rule_based", grids.substituted(PARAMS, values)).signals(series)
        for r in alone.select("symbol", "date", "buy", "sell").collect():
            assert got[n, r.symbol, r.date] == (r.buy, r.sell)
    assert any(b for b, _ in got.values())


def test_returns_of_one_position(spark, series):
    rows = grids.signals(series, PARAMS, GRID)
    got = {(r.combo, r.symbol, r.date): (round(r.r, 9), r.entered) for r in grids.daily_returns(rows).collect()}
    by = {}
    for r in sorted(rows.collect(), key=lambda r: (r.combo, r.symbol, r.date)):
        by.setdefault((r.combo, r.symbol), []).append(r)
    for key, days in by.items():
        held, wish, last = False, False, None
        for d in days:
            grow, entered = d.open / last if held else 1.0, wish and not held
            held = wish
            grow *= d.close / d.open if held else 1.0
            assert got[(*key, d.date)] == (round(grow - 1, 9), entered)
            wish, last = True if d.buy else False if d.sell else wish, d.close


def test_plan_has_one_scan(spark, tmp_path):
    spark.createDataFrame(walk(20), "symbol string, date date, open double, high double, low double, close double, volume double").write.parquet(str(tmp_path / "b"))
    params = {"indicators": {"m": {"fn": "sma", "period": 3}}, "buy_when": [["close", "<", "m"], ["close", "<", 10]], "sell_when": [["close", ">", "m"]]}
    for grid in ({"buy_when.1.2": [10]}, {"buy_when.1.2": list(range(30)), "indicators.m.period": [3, 4, 5]}):
        plan = grids.signals(spark.read.parquet(str(tmp_path / "b")), params, grid)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "Join" not in plan and plan.count("Exchange") == 1


def test_what_can_not_be_swept():
    assert grids.substituted({"a": [[1, 2]]}, {"a.0.1": 5}) == {"a": [[1, 5]]}
    for grid in ({"buy_when.0.1": ["<", ">"]}, {"indicators.none.period": [1]}):
        with pytest.raises((ValueError, KeyError)):
            grids.signals(None, PARAMS, grid)


def test_walk_forward_picks_the_first_of_equals(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    rows = [(c, day(i), [0.01, 0.02][i % 2] * [1, 1, -1][c], 1) for c in range(3) for i in range(60)]
    days = spark.createDataFrame(rows, "combo int, date date, r double, entries long")
    got = grids.walk_forward(days, [(0, day(0), day(29), day(30), day(39)), (1, day(30), day(49), day(50), day(59))]).collect()
    assert sorted((r.window, r.combo, r.oos_entries) for r in got) == [(0, 0, 10), (1, 0, 10)] and all(r.is_sharpe > 0 and r.oos_sharpe > 0 for r in got)
