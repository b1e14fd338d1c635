"""Late bars merged into a cache exactly once, however often a batch is repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import materialise

C = F.col
#: The batch that a cached row came with.
BATCH = "_batch"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def merge_batch(batch: DataFrame, number: int, path: str, keys: list[str], by: str) -> None:
    """Merges a batch into the cache, a partition for each value of `by`. A row replaces the one with its keys unless that
    came with a later batch, so that a batch merged again, even after others, changes nothing. Of rows of one batch with
    the same keys the largest values stay. Only the partitions in the batch are read and written."""
    spark = batch.sparkSession
    rows = batch.withColumn(BATCH, F.lit(number).cast("long"))
    if _exists(spark, path):
        old = spark.read.schema(rows.schema).parquet(path)
        here = [r[0] for r in batch.select(by).distinct().collect()]  # a name for each partition to read
        rows = rows.unionByName(old.where(C(by).isin([x for x in here if x is not None]) | (C(by).isNull() & F.lit(None in here))))
    values = [c for c in rows.columns if c not in keys and c != BATCH]
    latest = F.max(F.struct(BATCH, *values)).alias("_r")
    merged = rows.groupBy(*keys).agg(latest).select(*keys, "_r.*")
    safe = materialise(merged.select(*rows.columns), "upsert")
    safe.repartition(by).sortWithinPartitions(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def start(stream: DataFrame, path: str, checkpoint: str, keys: list[str], by: str = "symbol") -> StreamingQuery:
    """Upserts a stream into the cache, one writer at a time, until nothing is left."""
    merge = lambda batch, number: merge_batch(batch, number, path, keys, by)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cached(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cache without what it keeps for itself."""
    return spark.read.schema(f"{schema}, {BATCH} long").parquet(path).drop(BATCH)
