"""Written intermediate tables: they cut lineage, survive lost executors and carry real sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one is set only where none is configured."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.conf.set(SETTING, root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a frame that reads the stored copy. What was shuffled for it is deleted as soon as it is written."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the stored copy behind a frame that ``written`` gave and that nothing reads any more."""
    hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    folders = {file.rpartition("/")[0] for file in df.inputFiles()}
    for folder in folders:
        path = hadoop.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table below the shared folder that this module named."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(scratch_root(spark))
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return
    for status in files.listStatus(root):
        name, _, tail = status.getPath().getName().rpartition("-")
        if name and len(tail) == 32:
            files.delete(status.getPath(), True)
