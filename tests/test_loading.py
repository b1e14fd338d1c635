"""Cache-first loading and snapshots."""

import datetime as dt

from pyspark.sql import functions as F

from quantloom.sources import bars, readthrough

BAR = "symbol string, date date, open double, high double, low double, close double, volume double"
DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(31)]
SESSIONS = [d for d in DAYS if d.weekday() < 5]


def frame(spark, rows):
    return spark.createDataFrame([(s, d, c, c, c, c, 1.0) for s, d, c in rows], BAR)


def test_only_stale_symbols_are_fetched_and_then_cached(spark, tmp_path):
    cache, asked = f"file://{tmp_path}/cache", []
    held = [("FULL", d, 1.0) for d in SESSIONS] + [("LATE", d, 1.0) for d in SESSIONS[1:]] + [("THIN", d, 1.0) for d in (SESSIONS[0], SESSIONS[8], SESSIONS[-1])]
    held += [("GAPS", d, 1.0) for d in SESSIONS[::6]] + [("GAPS", SESSIONS[-1], 1.0)]  # six sessions a bar: carried forward it is whole
    bars.write_cache(frame(spark, held), cache)
    whole = frame(spark, [(s, d, 2.0) for s in ("FULL", "LATE", "THIN", "GAPS", "NEW") for d in SESSIONS])

    def fetch(symbols, start, end):
        asked.append(sorted(symbols))
        return whole.where(F.col("symbol").isin(symbols)).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))

    calendar = spark.createDataFrame([(d,) for d in DAYS if d.weekday() < 5], "date date")
    symbols = spark.createDataFrame([("full",), ("LATE",), ("thin",), ("GAPS",), ("NEW",), ("NONE",), (None,), ("full",)], "symbol string")
    for _ in range(2):
        out = readthrough.load(spark, symbols, "2024-01-01", "2024-01-31", cache, calendar, fetch).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("close").alias("c")).collect()
        assert sorted((r.symbol, r.n, r.c) for r in out) == [(s, len(SESSIONS), c) for s, c in (("FULL", 1.0), ("GAPS", 1.0), ("LATE", 2.0), ("NEW", 2.0), ("THIN", 2.0))]
    assert asked == [["LATE", "NEW", "NONE", "THIN"], ["NONE"]]


def test_an_empty_cache_is_filled(spark, tmp_path):
    cache = f"file://{tmp_path}/none"
    calendar = spark.createDataFrame([(d,) for d in SESSIONS], "date date")
    symbols = spark.createDataFrame([("A",)], "symbol string")
    out = readthrough.load(spark, symbols, "2024-01-01", "2024-01-31", cache, calendar, lambda s, a, b: frame(spark, [("A", d, 3.0) for d in SESSIONS]))
    assert out.count() == len(SESSIONS) == readthrough.read(spark, cache).count()
    assert readthrough.load(spark, symbols.limit(0), "2024-01-01", "2024-01-31", cache, calendar, lambda *a: 1 / 0).count() == 0


def test_constituents_of_pages(spark, tmp_path):
    from quantloom.sources import universe

    us = "<p>x</p><TABLE id=a><tr><th>Name</th><th> <a href='/'>Symbol</a>\n</th></tr><tr><td>B</td><td><a>BRK.B</a></td></tr><tr><td>A&amp;T</td><td> T </td></tr><tr><td>T</td><td>T</td></tr><tr><td colspan=2>note</td></tr></TABLE><table><tr><td>Symbol</td></tr><tr><td>NO</td></tr></table>"
    ca = "<table><tr><th>Ticker</th></tr><tr><td>RY.TO</td></tr><tr><td>BNS</td></tr></table>"
    for key, page in (("us_index", us), ("ca_index", ca), ("bad", "<table></table>"), ("none", "no table")):
        (tmp_path / f"key={key}").mkdir()
        (tmp_path / f"key={key}" / "page.html").write_text(page)
    got = {r.key: r.symbols for r in universe.read_constituents(spark, str(tmp_path)).collect()}
    assert got == {"us_index": ["BRK-B", "T"], "ca_index": ["BNS.TO", "RY.TO"]}


def test_snapshots_by_age(spark):
    from quantloom.sources import universe

    now = dt.datetime(2024, 2, 1)
    rows = [("young", now - dt.timedelta(days=6), ["A"]), ("old", now - dt.timedelta(days=20), ["B0"]), ("old", now - dt.timedelta(days=8), ["B"]), ("late", now + dt.timedelta(days=1), ["C"]), ("lost", now - dt.timedelta(days=9), ["D"]), ("edge", now - universe.TTL, ["E"])]
    held = spark.createDataFrame(rows, universe.SNAPSHOTS)
    keys = spark.createDataFrame([(k,) for k in ("young", "old", "late", "lost", "edge", "never")], "key string")
    asked = []

    def fetch(names):
        asked.append(sorted(names))
        return spark.createDataFrame([("old", ["B2"]), ("late", ["C2"]), ("young", ["unasked"])], "key string, symbols array<string>")

    out, new = universe.refresh(spark, keys, held, fetch, now)
    assert sorted((r.key, r.state, r.symbols) for r in out.collect()) == [("edge", "fresh", ["E"]), ("late", "fetched", ["C2"]), ("lost", "stale", ["D"]), ("never", "missing", None), ("old", "fetched", ["B2"]), ("young", "fresh", ["A"])]
    assert asked == [["late", "lost", "never", "old"]]
    again, none = universe.refresh(spark, keys.where("key IN ('old', 'late')"), held.unionByName(new), lambda names: 1 / 0, now + dt.timedelta(hours=1))
    assert {r.state for r in again.collect()} == {"fresh"} and none.count() == 0
    own = spark.createDataFrame([("us_index", ["T", "A"], now, "fresh"), ("ca_index", ["A"], now, "stale")], "key string, symbols array<string>, loaded_at timestamp_ntz, state string")
    assert sorted(r.symbol for r in universe.tickers(own, "us_ca").collect()) == ["A", "T"]
    for market, frame_ in (("moon", own), ("ca", own.where("key = 'us_index'"))):
        try:
            universe.tickers(frame_, market)
            raise AssertionError(market)
        except ValueError:
            pass


def test_rows_of_any_source_are_normalised(spark):
    rows = [(" aa ", "2024-01-02 23:30:00+09:00", 1, 1.0, float("nan")), ("AA", "2024-01-02", 2, 2.0, float("inf")), ("AA", " 2024-01-03T00:00:00Z", 3, 3.0, 5.0), ("AA", "no day", 4, 4.0, 5.0), (None, "2024-01-02", 5, 5.0, 5.0), ("bb", "2024-01-02", None, 6.0, 5.0), ("bb", "2024-01-02", 1, 7.0, 5.0)]
    raw = spark.createDataFrame(rows, "Symbol string, DATE string, n int, Close double, Volume double").withColumn("Adj Close", F.lit(1.0))
    got = [tuple(r) for r in bars.normalise(raw, ["n"]).orderBy("symbol", "date").collect()]
    day = lambda d: dt.date(2024, 1, d)
    assert got == [("AA", day(2), None, None, None, 2.0, None), ("AA", day(3), None, None, None, 3.0, 5.0), ("BB", day(2), None, None, None, 7.0, 5.0)]
    stamped = spark.sql("SELECT 'A' AS symbol, TIMESTAMP_NTZ'2024-01-02 23:59:59' AS time, 1 AS n UNION ALL SELECT 'A', TIMESTAMP_NTZ'2024-01-02 00:00:00', 2")
    assert [(r.symbol, r.date) for r in bars.normalise(stamped, ["n"], "time").collect()] == [("A", day(2))]
    assert bars.normalise(raw.limit(0), ["n"]).count() == 0
