"""Tables written to the cluster's shared folder: they cut lineage and survive lost executors.

The folder is the one the session names in spark.checkpoint.dir; only a local master without that setting gets a
folder of its own. Every table goes through Spark's writers, so the folder may be on any file system Spark knows.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df once and return it as read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{uuid.uuid4().hex}-{label}"
    schema = df.schema
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(schema).parquet(path)
    out._gridloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that save() wrote and that nothing reads any more."""
    path = getattr(df, "_gridloom_path", None)
    if path in _written:
        _delete(_written.pop(path), path)


def free(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs now.

    It does so when the driver's JVM collects what referred to them, and a driver that makes little garbage may not
    collect any before disks are full; there is no other way to ask for it from Python.
    """
    gc.collect()
    spark._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def fresh(columns: list[str], name: str) -> str:
    """A column name like name that none of columns has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
