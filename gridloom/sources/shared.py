"""The folder that the driver and all executors share, and what is written there for a while."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a local master without it gets a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def place(spark: SparkSession, label: str) -> str:
    """A new name in the folder; what is there is deleted with the session's process at the latest."""
    path = f"{folder(spark)}/gridloom-{uuid.uuid4().hex}-{label}"
    _written[path] = spark
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written once, as read back: what comes after doesn't work it out again, and lost executors cost only that."""
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gridloom_place = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of saved() that nothing reads any more."""
    path = getattr(df, "_gridloom_place", None)
    if path in _written:
        _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
