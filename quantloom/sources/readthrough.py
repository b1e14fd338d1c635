"""Cache-first loading: what the cache covers is read from it, the rest is fetched, merged into it and read together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise
from .bars import FILL_LIMIT, MIN_COVERAGE, OHLCV, reindex, upsert
from .connector import register

C = F.col
CACHE = "date date, open double, high double, low double, close double, volume double, symbol string"
#: Gives the bars of these symbols between two days.
Fetch = Callable[[list[str], str, str], DataFrame]


def source(spark: SparkSession, path: str) -> Fetch:
    """Fetches from the files of a folder through the `bars` format, which opens those of the symbols alone."""
    register(spark)
    return lambda symbols, start, end: spark.read.format("bars").load(path).where(C("symbol").isin(symbols)).where(C("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The cached bars; none before the first were kept."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE).select("symbol", "date", *OHLCV)
    return spark.read.schema(CACHE).parquet(path).select("symbol", "date", *OHLCV)


def stale(wanted: DataFrame, cached: DataFrame, sessions: DataFrame) -> DataFrame:
    """The wanted symbols that the cache does not serve: its bars must reach from the first to the last of the sessions
    and, carried forward over FILL_LIMIT sessions, have a close on MIN_COVERAGE of them."""
    days = sessions.agg(F.min("date").alias("from"), F.max("date").alias("to"), F.count(F.lit(1)).alias("n"))
    own = cached.join(wanted, "symbol", "left_semi")
    spans = own.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    place = sessions.select("date", F.row_number().over(Window.orderBy("date")).alias("i"))  # one calendar: a row a day
    held = own.where("close IS NOT NULL").select("symbol", "date").join(F.broadcast(place), "date")
    # A bar covers its own session and the next FILL_LIMIT, up to the symbol's next bar.
    gap = F.lead("i").over(Window.partitionBy("symbol").orderBy("i"))
    covered = held.withColumn("next", gap).crossJoin(F.broadcast(days.select("n"))).groupBy("symbol").agg(F.sum(F.least(F.lit(FILL_LIMIT + 1), F.coalesce(C("next"), C("n") + 1) - C("i"))).alias("covered"))
    fresh = spans.join(covered, "symbol").crossJoin(F.broadcast(days)).where(f"first <= `from` AND last >= `to` AND covered >= {MIN_COVERAGE} * n")
    return wanted.join(fresh, "symbol", "left_anti")


def load(spark: SparkSession, symbols: DataFrame, start: str, end: str, cache: str, sessions: DataFrame, fetch: Fetch) -> DataFrame:
    """Bars of the symbols (a frame with that column) on every session from start to end, carried forward over small gaps.

    Stale symbols are found by an anti-join on the plan's side of the cache, fetched in one scan that names them, and
    merged: fetched rows before cached ones of the same day. Their partitions alone are written, after the merged rows
    are safe in the shared folder. Symbols that the source does not have give no row. One writer at a time."""
    sessions = sessions.where(C("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    wanted = symbols.select(F.upper("symbol").alias("symbol")).where("symbol IS NOT NULL").distinct()
    missing = [r.symbol for r in stale(wanted, read(spark, cache), sessions).collect()]  # a name for each file to open
    if missing:
        new = fetch(missing, start, end).select("symbol", "date", *[C(c).cast("double").alias(c) for c in OHLCV])
        old = read(spark, cache).where(C("symbol").isin(missing))
        merged = materialise(upsert(old, new, ["symbol", "date"]), "fetched")
        merged.repartition("symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(cache)
    asked = read(spark, cache).join(wanted, "symbol", "left_semi").where(C("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return reindex(asked.join(F.broadcast(sessions), "date", "left_semi"), sessions)
