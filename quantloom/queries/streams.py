"""Streams with timers, and late bars merged into a cache."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import bars
from ..streaming import streams, timers, upsert
from .base import query, rounded

C = F.col
_MARK = "m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)"


@query(f"""WITH {_MARK}, k AS (SELECT user_id || ':' || event_type AS key, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS following FROM events)
SELECT key, ts AS last FROM k, m WHERE following - ts > INTERVAL 5 DAY OR following IS NULL AND ts + INTERVAL 5 DAY <= mark""")
def stream_stale_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events of one type are silent for more than five days."""
    return streams.drained(timers.silences(streams.events(spark, sf), "concat(user_id, ':', event_type)"), "stale", timers=True)


@query(f"""WITH {_MARK}, o AS (SELECT user_id, event_id AS id, ts, value * 0.25::DOUBLE AS level FROM events WHERE event_type = 'purchase'), t AS (SELECT * FROM events WHERE event_type <> 'purchase'),
f AS (SELECT o.user_id, o.id, o.ts AS placed, arg_min(t.ts, (t.ts, t.event_id)) AS done_at, arg_min(t.value, (t.ts, t.event_id)) AS price FROM o LEFT JOIN t ON t.user_id = o.user_id AND (t.ts, t.event_id) > (o.ts, o.id) AND t.ts <= o.ts + INTERVAL 1 DAY AND t.value <= level GROUP BY 1, 2, 3)
SELECT user_id::VARCHAR AS key, id, CASE WHEN done_at IS NULL THEN 'expired' ELSE 'filled' END AS state, coalesce(done_at, placed + INTERVAL 1 DAY) AS done_at, round(price, 6) AS price FROM f, m WHERE done_at IS NOT NULL OR placed + INTERVAL 1 DAY <= mark""")
def stream_gtc_orders(spark: SparkSession, sf: str) -> DataFrame:
    """A purchase is a limit buy at a quarter of its value, good for a day; a user's other events are prices."""
    is_order = C("event_type") == "purchase"
    rows = streams.events(spark, sf).select(C("user_id").alias("key"), C("event_id").alias("id"), "ts", is_order.alias("is_order"), F.when(is_order, C("value") * 0.25).otherwise(C("value")).alias("price"))
    return rounded(streams.drained(timers.limit_orders(rows, dt.timedelta(days=1)), "orders", timers=True))


@query("SELECT symbol, date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close * CASE WHEN volume % 2 = 0 THEN 2 ELSE 1 END, 6) AS close, volume FROM brand", "brand")
def stream_late_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Bars from 1995 on arrive first, then the older ones and corrections of every other day."""
    b, path = bars.brand_bars(spark, sf), shared_dir(spark, "late")
    corrected = b.withColumn("close", C("close") * F.when(C("volume") % 2 == 0, 2).otherwise(1))
    for part in (b.where("date >= DATE'1995-01-01'"), corrected.where("date < DATE'1995-01-01' OR volume % 2 = 0")):
        part.repartition(2).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    upsert.start(stream, f"{path}/cache", f"{path}/checkpoint", ["symbol", "date"]).awaitTermination()
    return rounded(upsert.cached(spark, f"{path}/cache", "date date, open double, high double, low double, close double, volume long, symbol string").select(*b.columns))
