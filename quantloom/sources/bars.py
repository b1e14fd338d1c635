"""Price bars: normalisation, derivation from ticks, resampling, gap filling, caches and their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OHLCV = ("open", "high", "low", "close", "volume")
BAR_SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"
#: Sessions over which a missing price is carried forward, and the share of sessions a cache must hold.
FILL_LIMIT, MIN_COVERAGE = 5, 0.90


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span(bars: DataFrame) -> tuple[str, str]:
    """The first and the last day of bars."""
    return tuple(bars.agg(F.min("date").cast("string"), F.max("date").cast("string")).first())


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def finite(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def from_ticks(ticks: DataFrame, order: list[str], volume: Column) -> DataFrame:
    """Bars of ticks (symbol, date, px and the columns of order, a total order within a bar)."""
    key = F.struct(*order)
    return ticks.groupBy("symbol", "date").agg(
        F.min_by("px", key).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", key).alias("close"), volume.cast("long").alias("volume")
    )


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily series of line item unit prices, symbol MKT."""
    lines = read_table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_quantity")
    ticks = lines.select(F.lit("MKT").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), *LINE_ORDER, "l_quantity")
    return from_ticks(ticks, LINE_ORDER, F.sum("l_quantity"))


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series of the same prices by brand of the part."""
    lines = read_table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_quantity")
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    ticks = lines.join(parts, "l_partkey").select("symbol", F.col("l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), *LINE_ORDER, "l_quantity")
    return from_ticks(ticks, LINE_ORDER, F.sum("l_quantity"))


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataFrame:
    """Series of event values by event type, a bar for each day or hour; volume is the number of events."""
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    at = F.col("ts").cast("date") if unit == "day" else F.date_trunc(unit, F.col("ts")).cast("timestamp_ntz")
    ticks = events.select(F.col("event_type").alias("symbol"), at.alias("date"), F.col("value").alias("px"), "ts", "event_id")
    return from_ticks(ticks, ["ts", "event_id"], F.count(F.lit(1)))


def read_csv(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """{path}/{SYMBOL}.csv files with a Date column: one scan, symbols from the file names, dates as a filter."""
    raw = spark.read.option("header", True).schema("Date date, Open double, High double, Low double, Close double, Volume double").csv(path)
    return _files(raw, "csv", start, end)


def read_parquet(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The same over {path}/{SYMBOL}.parquet files."""
    return _files(spark.read.schema("Date date, Open double, High double, Low double, Close double, Volume double").parquet(path), "parquet", start, end)


def _files(raw: DataFrame, kind: str, start: str | None, end: str | None) -> DataFrame:
    name = F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\.{kind}$", 1)
    out = raw.select(F.upper(F.url_decode(name)).alias("symbol"), F.col("Date").alias("date"), *[finite(F.col(c.capitalize())).alias(c) for c in OHLCV])
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end else out


def normalise(raw: DataFrame, order: list[str], time: str = "date") -> DataFrame:
    """symbol, date and the five price columns of rows from any source, sorted within partitions of symbols.

    The names of columns count without case, others are dropped, missing ones are null. Symbols are trimmed and in upper
    case. A time is the day on its own wall clock: of a string with an offset the day it is written with, of a
    TIMESTAMP the day in the session's zone. NaN and infinities are null. Of several rows of a day the last by `order`,
    in which a null comes first, stays whole; rows without symbol or day are left out."""
    names = {c.lower(): c for c in raw.columns}
    kind = raw.schema[names[time.lower()]].dataType.simpleString()
    at = F.col(f"`{names[time.lower()]}`")
    day = F.expr(f"try_cast(substring(trim(`{names[time.lower()]}`), 1, 10) AS date)") if kind == "string" else at.cast("date")
    price = lambda c: finite(F.col(f"`{names[c]}`").cast("double")) if c in names else F.lit(None).cast("double")
    rows = raw.select(F.upper(F.trim(F.col(f"`{names['symbol']}`"))).alias("symbol"), day.alias("date"), *[price(c).alias(c) for c in OHLCV], F.struct(*order).alias("_order"))
    last = rows.where("symbol IS NOT NULL AND date IS NOT NULL").groupBy("symbol", "date").agg(F.max_by(F.struct(*OHLCV), "_order").alias("r"))
    return last.select("symbol", "date", "r.*").repartition("symbol").sortWithinPartitions("symbol", "date")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which the later row of a key stays: new rows before old ones."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    cols = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in cols if c != "_age"]), F.col("_age")).alias("r")).select(*keys, "r.*")


def write_cache(bars: DataFrame, path: str) -> None:
    """A price cache: one partition for each symbol, so that a scan for a symbol reads its files alone."""
    bars.repartition("symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").partitionBy("symbol").parquet(path)


def coverage(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bars against sessions for each symbol between its first and last bar; stale below the minimum."""
    spans = bars.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n_bars"))
    days = sessions.select(F.col("date").alias("d"))
    met = spans.join(F.broadcast(days), F.col("d").between(F.col("first"), F.col("last")))
    out = met.groupBy("symbol", "n_bars").agg(F.count(F.lit(1)).alias("n_sessions"))
    return out.withColumn("stale", F.col("n_bars") < MIN_COVERAGE * F.col("n_sessions"))


def weekdays(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS date")
    return days.where(F.weekday("date") < 5)


def reindex(bars: DataFrame, sessions: DataFrame, limit: int = FILL_LIMIT) -> DataFrame:
    """Every session between a symbol's first and last bar; prices carried forward over at most limit sessions,
    volume too, sessions still without a close dropped. The sessions are few: the calendar is broadcast."""
    spans = bars.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    grid = spans.join(F.broadcast(sessions), F.col("date").between(F.col("first"), F.col("last"))).select("symbol", "date")
    held = by_symbol().rowsBetween(-limit, 0)
    out = grid.join(bars, ["symbol", "date"], "left")
    return out.select("symbol", "date", *[F.last(c, ignorenulls=True).over(held).alias(c) for c in OHLCV]).where("close is not null")


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Weekly (ending Sunday) or monthly bars, dated by the last bar in them."""
    if unit not in ("week", "month"):
        raise ValueError(f"unknown timeframe {unit}")
    return (
        bars.groupBy("symbol", F.date_trunc(unit, "date").alias("p"))
        .agg(F.max("date").alias("date"), F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").cast("long").alias("volume"))
        .where("close is not null").drop("p")
    )
