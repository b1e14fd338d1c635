"""Streams: event-time windows over events, and the ledger as state keyed by run.

Each function drains what is there (availableNow) into the shared folder and returns the written rows; the same
transformations serve a stream that never ends.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import simulator
from ..session import shared_dir

C = F.col
WATERMARK = "1 hour"
#: Processors with timers need this store, which is not Spark's default.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, one file or a folder of them, as a stream, its time stamps as instants."""
    raw = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(f"{sf_dir}/events.parque[t]")
    return raw.withColumn("ts", C("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "append", timers: bool = False) -> DataFrame:
    """Runs a stream over all there is and reads back what it wrote; event times come back without a zone."""
    spark = stream.sparkSession
    path = shared_dir(spark, name)
    before = spark.conf.get(STORE, None)
    if timers:
        spark.conf.set(STORE, ROCKSDB)
    try:  # a query keeps the settings of its start
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    finally:
        if timers:
            spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{path}/data")
    return out.select(*[C(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.simpleString() == "timestamp" else C(f.name) for f in out.schema])


def tumbling(stream: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Bars by event type and window, each emitted once the watermark has passed its end."""
    key = F.window("ts", width, slide) if slide else F.window("ts", width)
    order = F.struct("ts", "event_id")
    agg = stream.withWatermark("ts", WATERMARK).groupBy(key, "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close")
    )
    return agg.select(C("window.start").alias("start"), "event_type", "n", "open", "high", "low", "close")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Each user's runs of events with no longer gap."""
    agg = stream.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return agg.select(C("session_window.start").alias("start"), C("session_window.end").alias("end"), "user_id", "n", "value")


def deduplicated(stream: DataFrame) -> DataFrame:
    """Late repeats within the watermark are dropped."""
    return stream.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["event_id"])


def ledger(features: DataFrame, settings: simulator.Settings) -> DataFrame:
    """The simulator over a stream of feature rows: a run's ledger is state between batches.

    Rows of one day must arrive in one batch, days in order; the last day seen is not closed, as more may come."""

    def advance(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = pickle.loads(state.get[0]) if state.exists else simulator.Ledger(settings.cash)
        rows = pd.concat(list(pdfs), ignore_index=True)
        out = [e for day, bars in simulator.days_of(rows) for e in simulator.step(settings, book, day, bars, key[0])]
        state.update((pickle.dumps(book),))
        yield simulator.events_frame(out, key[0])

    keyed = features.withColumn("run_id", C("run_id").cast("string"))
    return keyed.groupBy("run_id").applyInPandasWithState(advance, simulator.SCHEMA, "book binary", "append", GroupStateTimeout.NoTimeout)
