"""Windows, band choice, padding and cropping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..errors import InvalidImage
from ..params import LEAST_SIDE, OVERLAP, TILE


def stride(tile: int = TILE, overlap: float = OVERLAP) -> int:
    return max(int(tile * (1 - overlap)), 1)


def windows(scenes: DataFrame, tile: int = TILE, overlap: float = OVERLAP, cover_edges: bool = False) -> DataFrame:
    """(image_id, tile_id, row_off, col_off, tile_width, tile_height): row by row, cut at the edges.

    A window under LEAST_SIDE of the tile to either side is left out, with what only it would see; cover_edges keeps
    such windows.
    """
    step = stride(tile, overlap)
    grid = scenes.select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(step))).alias("row_off"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(step))).alias("col_off"))
    sized = grid.withColumns({"tile_width": F.least(F.lit(tile), F.col("width") - F.col("col_off")), "tile_height": F.least(F.lit(tile), F.col("height") - F.col("row_off"))})
    if not cover_edges:
        least = F.lit(LEAST_SIDE * tile)
        sized = sized.where((F.col("tile_width") >= least) & (F.col("tile_height") >= least))
    columns = F.ceil(F.col("width") / step)
    return sized.select("image_id", ((F.col("row_off") / step) * columns + F.col("col_off") / step).cast("int").alias("tile_id"), "row_off", "col_off", "tile_width", "tile_height")


def tiled(pixels: DataFrame, scenes: DataFrame, tile: int = TILE, overlap: float = OVERLAP) -> DataFrame:
    """Each pixel in each window that sees it, with its place there: an equi-join on the windows it may be in."""
    step = stride(tile, overlap)
    reach = -(-tile // step) - 1
    back = lambda c: F.sequence(F.greatest(F.floor(F.col(c) / step) - reach, F.lit(0)), F.floor(F.col(c) / step))
    placed = pixels.select("*", F.explode(back("y")).alias("_r")).select("*", F.explode(back("x")).alias("_c"))
    wins = windows(scenes, tile, overlap).select("*", F.floor(F.col("row_off") / step).alias("_r"), F.floor(F.col("col_off") / step).alias("_c"))
    joined = placed.join(wins, ["image_id", "_r", "_c"])
    inside = (F.col("y") < F.col("row_off") + F.col("tile_height")) & (F.col("x") < F.col("col_off") + F.col("tile_width"))
    return joined.where(inside).withColumns({"ty": F.col("y") - F.col("row_off"), "tx": F.col("x") - F.col("col_off")}).drop("_r", "_c")


def three_bands(bands: list[Column]) -> tuple[Column, Column, Column]:
    """Of three or more the first three; two and an empty one; or one three times."""
    if not bands:
        raise InvalidImage("an image has one band at least")
    return tuple(bands[:3]) if len(bands) >= 3 else (bands[0], bands[1], F.lit(0).cast("int")) if len(bands) == 2 else (bands[0],) * 3


def to_byte(v: Column, dtype: str, low: Column | None = None, high: Column | None = None) -> Column:
    """To 8 bits for detection: 16 bits lose the lower eight, other types are stretched between their window's ends."""
    if dtype == "uint8":
        return v.cast("int")
    if dtype == "uint16":
        return F.shiftright(v.cast("int"), 8)
    return F.when(high > low, ((v - low) / (high - low) * F.lit(255.0)).cast("int")).otherwise(0)


def reflected(i: Column, n: Column) -> Column:
    """The index inside 0 to n - 1 that stands for i in a reflection without repeated edges, however often it folds."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    at = F.pmod(i, period)
    return F.when(n == 1, 0).otherwise(F.when(at < n, at).otherwise(period - at)).cast("int")


def pad_index(sizes: DataFrame, tile: int) -> DataFrame:
    """sizes (image_id, n) -> (image_id, i, src): which of n places each of tile places shows."""
    return sizes.select("image_id", "n", F.explode(F.sequence(F.lit(0), F.lit(tile - 1))).alias("i")).select("image_id", "i", reflected(F.col("i"), F.col("n")).alias("src"))


def band_sums(chunks: DataFrame) -> DataFrame:
    """Binary tiles with the sums r, g and b of their three bands in place of the data."""
    keep = [c for c in chunks.columns if c not in ("data", "image_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [np.frombuffer(d.as_buffer(), np.uint8).reshape(3, -1).sum(axis=1, dtype=np.int64) for d in batch.column("data")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array([x[k] for x in sums], pa.int64()) for k in range(3))], names=[*keep, *"rgb"])

    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in keep)
    return chunks.mapInArrow(run, f"{kinds}, r bigint, g bigint, b bigint")


def padded(chunks: DataFrame, tile: int = TILE) -> DataFrame:
    """Binary tiles (bands, tile_height, tile_width, uint8) filled up below and to the right by reflection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], np.uint8).reshape(3, r["tile_height"], r["tile_width"])
                rows, cols = (fold(n) for n in a.shape[1:])
                out.append(a[:, rows][:, :, cols].tobytes())
            at = batch.schema.get_field_index("data")
            yield batch.set_column(at, "data", pa.array(out, pa.binary()))

    def fold(n: int) -> np.ndarray:
        i = np.arange(max(tile, n))
        if n == 1:
            return np.zeros_like(i)
        i %= 2 * (n - 1)
        return np.where(i < n, i, 2 * (n - 1) - i)

    return chunks.mapInArrow(run, chunks.schema)


def centre_crop(pixels: DataFrame, scenes: DataFrame, size: int) -> DataFrame:
    """The middle size x size of each image, with places counted from its corner; images too small are an error upstream."""
    box = scenes.select("image_id", F.floor((F.col("width") - size) / 2).cast("int").alias("_c"), F.floor((F.col("height") - size) / 2).cast("int").alias("_r"))
    joined = pixels.join(box, "image_id").where(F.col("y").between(F.col("_r"), F.col("_r") + size - 1) & F.col("x").between(F.col("_c"), F.col("_c") + size - 1))
    return joined.withColumns({"y": F.col("y") - F.col("_r"), "x": F.col("x") - F.col("_c")}).drop("_r", "_c")


def check_crop(scenes: DataFrame, size: int) -> None:
    if small := scenes.where((F.col("width") < size) | (F.col("height") < size)).select("image_id", "width", "height").first():
        raise InvalidImage(f"{small.image_id} is {small.width} x {small.height}; too small for {size}")
