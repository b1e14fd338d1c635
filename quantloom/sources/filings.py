"""Filings, point-in-time values, put/call ratios and analyst snapshots from files, and the cache of filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import asof_join
from ..session import materialise

# The columns by which filings of each kind replace each other.
KEYS = {"financials": ["metric", "period_end"], "insider": ["filed_date", "insider_name", "shares"], "institutional": ["report_date"], "events": ["filed_date", "event_date"]}


def merged(old: DataFrame | None, new: DataFrame, kind: str) -> DataFrame:
    """One row for each symbol and key of the kind: a new one before an old one, then the one filed last; one without
    filing date comes after all dated ones of its age. Null symbols and keys are values like others."""
    keys = ["symbol", *KEYS[kind]]
    both = new.withColumn("_age", F.lit(0)) if old is None else old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    values = [c for c in both.columns if c not in (*keys, "_age")]
    latest = F.struct(F.col("_age"), F.lit(0) if "filed_date" in keys else F.coalesce(-F.unix_date("filed_date"), F.lit(1 << 30)), *[F.col(c) for c in values])
    return both.groupBy(*keys).agg(F.min_by(F.struct(*values), latest).alias("_r")).select(*keys, "_r.*")


def read_cache(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """The cached filings of a kind, or None before the first were kept."""
    at = f"{path}/{kind}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(at)
    return spark.read.option("basePath", at).parquet(at) if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder) else None


def merge_into_cache(spark: SparkSession, path: str, kind: str, new: DataFrame) -> None:
    """Merges new filings into the cache, a partition a symbol; only the partitions of symbols in new are read and
    written, after the merged rows are safe in the shared folder. One writer at a time: two that merge the same symbol
    at once would lose the rows of one. Filings without symbol are kept under the partition of null."""
    new = new.withColumn("symbol", F.upper("symbol"))
    old = read_cache(spark, path, kind)
    if old is not None:
        old = old.withColumn("symbol", F.col("symbol").cast("string")).alias("o")
        own = new.select(F.col("symbol").alias("_own")).distinct()
        old = old.join(own, F.col("o.symbol").eqNullSafe(F.col("_own")), "left_semi")
    rows = materialise(merged(old, new, kind), "filings")
    order = ["symbol", "filed_date"] if "filed_date" in rows.columns else ["symbol"]
    rows.repartition("symbol").sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(f"{path}/{kind}")


def spans(cache: DataFrame) -> DataFrame:
    """First and last filing date of each symbol."""
    return cache.groupBy("symbol").agg(F.min("filed_date").alias("first"), F.max("filed_date").alias("last"))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """symbol, field, date, value of CSV files with columns date, symbol, field and value. Rows whose value is no
    number do not count; of rows with one key and date the last of a file does."""
    raw = spark.read.option("header", True).schema("date string, symbol string, field string, value string").option("enforceSchema", False).csv(path)
    place = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = raw.select(F.upper(F.trim("symbol")).alias("symbol"), F.trim("field").alias("field"), F.to_date(F.trim("date")).alias("date"), F.expr("try_cast(trim(value) as double)").alias("value"), place.alias("_place"))
    return rows.where("value is not null and date is not null").groupBy("symbol", "field", "date").agg(F.max_by("value", "_place").alias("value"))


def values_as_of(probes: DataFrame, values: DataFrame) -> DataFrame:
    """Each probe (symbol, field, date) with the latest value reported by its date."""
    return asof_join(probes.withColumn("symbol", F.upper("symbol")), values.select("symbol", "field", "date", "value"), "date", ["symbol", "field"])


def _role(header: str) -> str | None:
    name = header.strip().lower()
    if "date" in name:
        return "date"
    if "p/c" in name or "put/call" in name or name == "ratio":
        return "pcr"
    return next((role for word, role in (("call", "calls"), ("put", "puts"), ("total", "total")) if word in name), None)


def read_put_call(spark: SparkSession, path: str) -> DataFrame:
    """date and what there is of pcr, calls, puts and total, from CSV files whose header, below lines of remarks, is the
    first line with a date column among two or more. Rows without a date do not count."""
    lines = spark.read.text(path)
    head = lines.where("lower(value) like '%date%' and value like '%,%'").first()
    if head is None:
        raise ValueError(f"no date column in {path}")
    roles = [_role(h) for h in head.value.split(",")]
    cells = F.split("value", ",")
    day = F.trim(F.get(cells, F.lit(roles.index("date"))))
    date = F.coalesce(*[F.expr(f"try_to_timestamp(_day, '{f}')") for f in ("yyyy-MM-dd", "M/d/yyyy")]).cast("date")
    cols = {r: F.expr(f"try_cast(trim(get(_cells, {i})) as double)") for i, r in reversed(list(enumerate(roles))) if r and r != "date"}
    return lines.select(cells.alias("_cells"), day.alias("_day")).select(date.alias("date"), *[c.alias(r) for r, c in cols.items()]).where("date is not null")


def read_analyst(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of revisions, symbol, up and down, from CSV files with these columns."""
    raw = spark.read.option("header", True).schema("symbol string, up long, down long").option("enforceSchema", False).csv(path)
    return raw.select(F.upper(F.trim("symbol")).alias("symbol"), "up", "down").where("symbol is not null")
