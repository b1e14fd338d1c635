"""Timers and upserts over several batches, repeated ones too; the connector's files."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import functions as F

from quantloom.queries import streams as stream_queries
from quantloom.sources import bars, connector
from quantloom.streaming import streams, timers, upsert

T0 = dt.datetime(2024, 1, 1)
BAR = "symbol string, date date, open double, high double, low double, close double, volume double"


def fed(spark, path, parts, schema):
    """A stream with a batch for each part."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, stream, path):
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").collect()


def test_silences_over_batches(spark, tmp_path):
    day = lambda d, h=0: T0 + dt.timedelta(days=d, hours=h)
    parts = [[("a", day(0)), ("b", day(0)), (None, day(0)), ("c", None)], [("a", day(1)), ("b", day(5))], [("b", day(7))], [("a", day(8)), ("b", day(8))], [("b", day(9)), ("b", day(30))]]
    stream = fed(spark, str(tmp_path / "in"), parts, "key string, ts timestamp")
    got = sorted((r.key, r.last) for r in drain(spark, timers.silences(stream, "key"), str(tmp_path)))
    # a is silent from day 1 (a timer or its row of day 8 tells, once) and from day 8; b never for more than five days but at day 9
    assert got == [("a", day(1)), ("a", day(8)), ("b", day(9))]


def test_orders_fill_or_expire_once(spark, tmp_path):
    h = lambda n: T0 + dt.timedelta(hours=n)
    parts = [
        [("x", 1, h(0), True, 10.0), ("x", 2, h(1), True, 5.0), ("x", 9, h(2), False, 11.0)],
        [("x", 10, h(10), False, 9.0), ("x", 3, h(11), True, 20.0), ("x", 4, h(11), True, 1.0), ("x", 5, h(11), True, None)],
        [("x", 11, h(40), False, 0.5)],
        [("y", 12, h(90), False, 3.0)],
    ]
    stream = fed(spark, str(tmp_path / "in"), parts, "key string, id long, ts timestamp, is_order boolean, price double")
    got = sorted((r.id, r.state, r.done_at, r.price) for r in drain(spark, timers.limit_orders(stream, dt.timedelta(days=1)), str(tmp_path)))
    assert got == [(1, "filled", h(10), 9.0), (2, "expired", h(25), None), (3, "expired", h(35), None), (4, "expired", h(35), None)]


@pytest.mark.parametrize("processor", [timers.Silence(dt.timedelta(days=5)), timers.Pending(dt.timedelta(days=1))])
def test_processors_unpickle_without_the_package(processor, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import pickle, sys; sys.modules['quantloom'] = None; print(type(pickle.loads(sys.stdin.buffer.read())).__name__)"
    out = subprocess.run([sys.executable, "-c", code], input=CloudPickleSerializer().dumps(processor), capture_output=True, env=env, cwd=tmp_path, timeout=60)
    assert out.stdout.decode().strip() == type(processor).__name__, out.stderr.decode()


def test_streams_of_a_folder_with_the_default_store(spark, tmp_path):
    day = lambda d, h=0: T0 + dt.timedelta(days=d, hours=h)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = [(1, day(0), 7, "purchase", 8.0, None), (2, day(0, 1), 7, "view", 1.5, None), (3, day(9), 7, "view", 9.0, None), (4, day(20), 8, "view", 9.0, None)]
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get(streams.STORE)
    spark.conf.set(streams.STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        stale = stream_queries.stream_stale_symbols(spark, str(tmp_path)).collect()
        orders = stream_queries.stream_gtc_orders(spark, str(tmp_path)).collect()
        assert "HDFSBacked" in spark.conf.get(streams.STORE)
    finally:
        spark.conf.set(streams.STORE, before)
    assert sorted((r.key, r.last) for r in stale) == [("7:purchase", day(0)), ("7:view", day(0, 1)), ("7:view", day(9))]
    assert [(r.key, r.id, r.state, r.done_at, r.price) for r in orders] == [("7", 1, "filled", day(0, 1), 1.5)]


def test_repeated_batches_change_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    row = lambda s, d, c: (s, dt.date(2024, 1, d), c)
    batches = [[row("A", 1, 1.0), row("A", 2, 2.0), row("B", 1, 3.0)], [row("A", 1, 10.0), row("A", 1, 9.0), row(None, 1, 4.0)], [row("B", 2, 5.0)]]
    frames = [spark.createDataFrame(b, "symbol string, date date, close double") for b in batches]
    for i in (0, 1, 1, 0, 2, 1, 0):
        upsert.merge_batch(frames[i], i, path, ["symbol", "date"], "symbol")
    kept = upsert.cached(spark, path, "date date, close double, symbol string")
    assert sorted(((r.symbol, r.date.day, r.close) for r in kept.collect()), key=repr) == [("A", 1, 10.0), ("A", 2, 2.0), ("B", 1, 3.0), ("B", 2, 5.0), (None, 1, 4.0)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("bars")
    lines = lambda n, base: "Date,Open,High,Low,Close,Volume\n" + "".join(f"2024-01-{d:02d},{base},{base + 1},{base - 1},{base},{100 * d}\n" for d in range(1, n + 1))
    (path / "aaa.csv").write_text(lines(10, 5))
    (path / "B%23.csv").write_text(lines(3, 7))
    (path / "BAD.csv").write_bytes(b"\x00\xff no bars here")
    (path / "_ignored.csv").write_text("x")
    os.mkdir(path / "symbol=PQ")
    import pyarrow as pa
    from pyarrow import parquet

    parquet.write_table(pa.table({"date": [dt.date(2024, 1, 4)], "close": [1.5]}), path / "symbol=PQ" / "part-0.parquet")
    return path


def test_connector_opens_only_what_is_asked_for(spark, folder):
    connector.register(spark)
    all_of = spark.read.format("bars").load(str(folder))
    with pytest.raises(Exception, match="BAD|columns|date|Date|KeyError"):
        all_of.collect()
    asked = all_of.where(F.col("symbol").isin("AAA", "PQ")).where("date >= DATE'2024-01-03' AND date < DATE'2024-01-05'")
    assert sorted((r.symbol, r.date.day, r.open, r.close, r.volume) for r in asked.collect()) == [("AAA", 3, 5.0, 5.0, 300.0), ("AAA", 4, 5.0, 5.0, 400.0), ("PQ", 4, None, 1.5, None)]
    assert all_of.where("symbol = 'B#' AND close > 6").count() == 3
    assert all_of.where("symbol = 'NONE'").count() == 0
    reader = connector.BarsReader(str(folder))
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull

    left = list(reader.pushFilters([EqualTo(("symbol",), "AAA"), GreaterThan(("date",), dt.date(2024, 1, 8)), IsNotNull(("close",))]))
    assert left == [IsNotNull(("close",))] and [p.symbol for p in reader.partitions()] == ["AAA"]
    assert sum(b.num_rows for b in reader.read(reader.partitions()[0])) == 2


def test_connector_streams_new_files(spark, tmp_path):
    connector.register(spark)
    source, out = tmp_path / "in", str(tmp_path / "out")
    os.mkdir(source)
    head = "Date,Open,High,Low,Close,Volume\n"

    def run():
        stream = spark.readStream.format("bars").load(str(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.symbol, r.date.day) for r in spark.read.schema(BAR).parquet(out).collect())

    (source / "A.csv").write_text(head + "2024-01-01,1,1,1,1,1\n")
    assert run() == [("A", 1)]
    (source / "B.csv").write_text(head + "2024-01-02,1,1,1,1,1\n")
    assert run() == [("A", 1), ("B", 2)] == run()
    assert bars.BAR_SCHEMA == BAR
