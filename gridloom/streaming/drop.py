"""Images that arrive in a folder, each file whole, through the same operators as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import checked

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arrivals(spark: SparkSession, folder: str, most: int = 64) -> DataFrame:
    """(path, modificationTime, length, content) of new files, most of them in a batch."""
    return spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", most).load(folder)


def process(files: DataFrame, each: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run each over every batch of files and append what it gives, as Parquet.

    Statistics are of an image, and an image is in one batch, so batches give what one run over all would.
    """

    def sink(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a failure replaces what it wrote.
        each(checked(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
