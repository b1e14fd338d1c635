"""Session settings, and the package itself for executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Fixed values of a local session; a cluster sets its own.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", shuffle_partitions)
    for key, value in (LOCAL | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Adds this package to what Spark sends to its executors, once an application."""
    context = spark.sparkContext
    if getattr(context, "_package_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(), "package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(target)
    context._package_shipped = True


def application_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, which driver and executors share: below spark.checkpoint.dir of
    the session, or below ./spark-checkpoints of a local session without it; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        base = f"file://{os.path.abspath('spark-checkpoints')}"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the application's; results may still read it, so that it stays until clear()."""
    return f"{application_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes the application's folder, once nothing reads a result of it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(application_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, written to the shared folder and read again."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
