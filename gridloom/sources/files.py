"""Names and sizes of files: what is taken in, and what results are called."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import FileTooLarge, UnsupportedFormat
from ..params import MAX_BYTES, RASTER_EXTENSIONS, SUFFIXES


def verdict(path: Column, length: Column, extensions: tuple[str, ...] = RASTER_EXTENSIONS, most: int = MAX_BYTES) -> Column:
    """ok, unsupported or too large."""
    ext = F.concat(F.lit("."), F.lower(F.substring_index(F.substring_index(path, "/", -1), ".", -1)))
    return F.when(~F.contains(F.substring_index(path, "/", -1), F.lit(".")) | ~ext.isin(*extensions), "unsupported").when(length > most, "too large").otherwise("ok")


def checked(files: DataFrame, extensions: tuple[str, ...] = RASTER_EXTENSIONS) -> DataFrame:
    """files (path, length) as they are, or an error that names the first that can't be taken."""
    bad = files.select("path", "length", verdict(F.col("path"), F.col("length"), extensions).alias("v")).where("v <> 'ok'").orderBy("path").first()
    if bad:
        raise (FileTooLarge if bad.v == "too large" else UnsupportedFormat)(f"{bad.path}: {bad.v}")
    return files


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def output_name(path: Column, operation: str) -> Column:
    return F.concat(stem(path), F.lit(SUFFIXES[operation] + ".tiff"))


def mosaic_name(scenes: DataFrame) -> DataFrame:
    """One row: the stems of all images by priority, joined."""
    order = F.array_sort(F.collect_list(F.struct("priority", "image_id", stem(F.col("path")).alias("s"))))
    return scenes.agg(F.concat(F.array_join(order["s"], "_"), F.lit(SUFFIXES["mosaic"] + ".tiff")).alias("name"))


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, priority) in the order given."""
    return spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, priority int")


def write(out: DataFrame, folder: str) -> list[str]:
    """Write (image_id, data) as files, named by a column name or as the images are; the paths.

    Each task writes its own files through pyarrow, to a folder that all machines share or to a store that it knows. A
    file gets its name when it is whole, so that a task that is lost leaves none behind, and one that is run again
    replaces it.
    """
    name = F.col("name") if "name" in out.columns else F.substring_index("image_id", "/", -1)
    target = F.concat(F.lit(folder.rstrip("/") + "/"), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = pa.fs.FileSystem.from_uri(r["target"])
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(r["data"])
                store.move(part, path)
                yield pa.RecordBatch.from_arrays([pa.array([r["target"]])], names=["target"])

    return sorted(r.target for r in out.select(target.alias("target"), "data").mapInArrow(run, "target string").collect())
