"""Feature collections and overlays of detections."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def collections(features: DataFrame, counts: DataFrame, scenes: DataFrame | None = None, elapsed: float | None = None) -> DataFrame:
    """(image_id, geojson): features of operators.boxes.features() by id, class counts by confidence, and metadata.

    A collection is one document by its nature; its features are at most its image's detections. With scenes, an image
    without detections has an empty collection.
    """
    feature = F.struct(F.col("id").alias("_id"), F.struct(F.lit("Feature").alias("type"), "id", F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")).alias("geometry"), "properties").alias("f"))
    each = features.groupBy("image_id").agg(F.array_sort(F.collect_list(feature)).alias("fs"), F.count("*").alias("n"))
    named = counts.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("best")).alias("b"), "class_name", "n"))).alias("cs"))
    joined = each.join(named, "image_id", "left")
    meta = [F.coalesce("n", F.lit(0)).alias("total_detections"), F.map_from_entries(F.coalesce(F.transform("cs", lambda c: F.struct(c["class_name"], c["n"])), F.array().cast("array<struct<class_name: string, n: bigint>>"))).alias("class_counts")]
    if elapsed is not None:
        meta.append(F.lit(round(elapsed, 1)).alias("elapsed_seconds"))
    if scenes is not None:
        joined = joined.join(scenes.select("image_id", F.col("width").alias("image_width"), F.col("height").alias("image_height")), "image_id", "right")
        meta += [F.col("image_width"), F.col("image_height")]
    doc = F.struct(F.lit("FeatureCollection").alias("type"), F.coalesce("fs.f", F.array()).alias("features"), F.struct(*meta).alias("metadata"))
    return joined.select("image_id", F.to_json(doc).alias("geojson"))


def write(docs: DataFrame, folder: str) -> list[str]:
    """An indented .geojson file for each image, named as it is; the paths."""
    from .files import write as written

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [i.rsplit("/", 1)[-1].rsplit(".", 1)[0] + ".geojson" for i in batch.column("image_id").to_pylist()]
            data = [json.dumps(json.loads(g), ensure_ascii=False, indent=2).encode() for g in batch.column("geojson").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(names, pa.string()), pa.array(data, pa.binary())], names=["image_id", "name", "data"])

    text = docs.select(F.col("image_id").cast("string").alias("image_id"), "geojson")
    return written(text.mapInArrow(run, "image_id string, name string, data binary"), folder)


def downscaled(pixels: DataFrame, factor: int, bands: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Means over squares of factor pixels."""
    return pixels.groupBy("image_id", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(*(F.avg(b).alias(b) for b in bands))


def png(image: np.ndarray) -> bytes:
    """(height, width, 3) uint8 as PNG."""
    h, w, _ = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + image[i].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def overlay(image: np.ndarray, rings: list[list[tuple[float, float]]], colour: tuple[int, int, int] = (255, 64, 0)) -> np.ndarray:
    """The image with rings of (x, y) drawn on it."""
    out = image.copy()
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
            n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
            y, x = np.rint(np.linspace(y0, y1, n + 1)).astype(int), np.rint(np.linspace(x0, x1, n + 1)).astype(int)
            on = (y >= 0) & (y < out.shape[0]) & (x >= 0) & (x < out.shape[1])
            out[y[on], x[on]] = colour
    return out
