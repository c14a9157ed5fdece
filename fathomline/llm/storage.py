"""Tables and files that one job leaves for the next, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Spark's setting that frees a query's shuffle files when it has ended.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the bytes of a batch that goes to Python, and its value here: texts differ in length, so rows do not bound a batch.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set(BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a session on one machine (tests) that names none gets a folder of this machine."""
    bound_batches(spark)
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='fathomline-')}"
        spark.conf.set(SETTING, found)
        spark.sparkContext.setCheckpointDir(found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` as a written table: later jobs read what this one computed, whichever executors are lost meanwhile. Its shuffle files go once it is written."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a written table that no later job reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
