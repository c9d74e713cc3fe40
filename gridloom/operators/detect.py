"""Detection: windows of images through a detector on the workers, then one merge for all images."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..errors import DetectionFailed
from ..params import BATCH, TILE_IOU, Detect
from ..sources import shared
from . import boxes, tiles


class Detector(Protocol):
    """Takes (n, 3, tile, tile) of uint8 and gives for each tile rows (cls, cx, cy, width, height, angle, confidence); the angle may be left out."""

    def __call__(self, batch: np.ndarray) -> list[list[tuple]]: ...


#: Makes a detector from the least confidence and the most overlap of boxes of one tile.
Factory = Callable[[float, float], Detector]


@lru_cache(maxsize=1)
def _loaded(factory: Factory, tile: int, confidence: float, iou: float) -> Detector:
    """One detector for each worker process, warmed up once."""
    model = factory(confidence, iou)
    model(np.zeros((1, 3, tile, tile), np.uint8))
    return model


def parsed(row: Sequence[float]) -> tuple[float, ...]:
    """cx, cy, width, height, angle, confidence of a raw row; short rows hold the confidence in place of the angle."""
    return (*row[:5], row[5]) if len(row) > 5 else (*row[:4], 0.0, row[4])


DETECTIONS = "image_id {kind}, tile_id int, k int, cls int, confidence double, cx double, cy double, width double, height double, angle double, col_off int, row_off int"


def detected(windows: DataFrame, factory: Factory, p: Detect = Detect()) -> DataFrame:  # noqa: B008
    """windows (image_id, tile_id, row_off, col_off, data of 3 x tile x tile) -> detections in tile coordinates, BATCH windows at a time."""
    kind = windows.schema["image_id"].dataType.simpleString()
    tile, names = p.tile, [f.split(" ")[0] for f in DETECTIONS.format(kind=kind).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(factory, tile, p.confidence, TILE_IOU)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows = part.select(["tile_id", "row_off", "col_off"]).to_pylist()
                data = np.stack([np.frombuffer(x, np.uint8).reshape(3, tile, tile) for x in part.column("data").to_pylist()])
                found = model(data)
                src = [i for i, f in enumerate(found) for _ in f or ()]
                each = [(i, k, int(d[0]), parsed(d[1:])) for i, f in enumerate(found) for k, d in enumerate(f or ())]
                out = [(rows[i]["tile_id"], k, cls, float(d[5]), *map(float, d[:5]), rows[i]["col_off"], rows[i]["row_off"]) for i, k, cls, d in each]
                types = [pa.int32()] * 3 + [pa.float64()] * 6 + [pa.int32()] * 2
                cols = zip(*out, strict=True) if out else [()] * len(types)
                yield pa.RecordBatch.from_arrays([part.column("image_id").take(pa.array(src, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return windows.select("image_id", "tile_id", "row_off", "col_off", "data").mapInArrow(run, DETECTIONS.format(kind=kind))


def detect(windows: DataFrame, factory: Factory, p: Detect = Detect()) -> DataFrame:  # noqa: B008
    """All steps: detection, classes and confidence, image coordinates, suppression."""
    if factory is None:
        raise DetectionFailed("no detector")
    raw = boxes.filtered(detected(tiles.padded(windows, p.tile), factory, p), p.class_ids(), p.confidence)
    # Written once: the merge reads them several times, and a detector is dear. Ids are unique in an image: by window and
    # by place in the window.
    once = shared.saved(raw.withColumn("det_id", F.col("tile_id").cast("long") * (1 << 32) + F.col("k")), "detections")
    return boxes.merged(once, p.iou)
