"""Shifts between images by phase correlation: of whole patches, and of overlapping blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..params import MAX_SHIFT, MIN_OVERLAP, MIN_RESPONSE
from ..sources import shared

#: A block has from LEAST to MOST pixels a side; one under TINY is not correlated.
LEAST, MOST, TINY = 32, 64, 16


def correlate(ref: np.ndarray, src: np.ndarray) -> tuple[float, float, float]:
    """(d_row, d_col, response): by how much src is to be moved to lie on ref, and the share of the peak's 5 x 5 surround.

    Both are tapered; the peak is refined by the centre of mass around it. What can't be correlated gives zeros.
    """
    h, w = ref.shape
    if h < 2 or w < 2:
        return 0.0, 0.0, 0.0
    taper = np.outer(np.hanning(h), np.hanning(w))
    cross = np.fft.fft2(ref * taper) * np.conj(np.fft.fft2(src * taper))
    size = np.abs(cross)
    if not np.isfinite(size).all() or size.max() == 0:
        return 0.0, 0.0, 0.0
    plane = np.real(np.fft.ifft2(cross / np.where(size > 0, size, 1)))
    py, px = (int(i) for i in np.unravel_index(int(plane.argmax()), plane.shape))
    step = np.arange(-2, 3)
    return centred(plane[np.ix_((py + step) % h, (px + step) % w)], py, px, h, w)


def centred(near: np.ndarray, py: int, px: int, h: int, w: int) -> tuple[float, float, float]:
    """The peak at (py, px), refined by the centre of mass of its 5 x 5 surround, and that mass; beyond half the plane it is negative."""
    dy, dx = np.meshgrid(np.arange(-2, 3), np.arange(-2, 3), indexing="ij")
    mass = near.sum()
    off_y, off_x = ((near * dy).sum() / mass, (near * dx).sum() / mass) if mass else (0.0, 0.0)
    wrap = lambda v, n: v - n if v > n / 2 else v
    return float(wrap(py + off_y, h)), float(wrap(px + off_x, w)), float(np.clip(mass, 0, 1))


def refined(ref: np.ndarray, src: np.ndarray) -> tuple[float, float, float]:
    """correlate(), measured again on what both blocks show once src is moved by whole pixels.

    What one block shows and the other doesn't pulls the peak aside, by up to a tenth of a pixel. The response stays
    the first one's; a second peak that is less clear, or a pixel or more away, doesn't count.
    """
    d_row, d_col, response = correlate(ref, src)
    dy, dx = int(np.rint(d_row)), int(np.rint(d_col))
    cut = lambda a, y, x: a[max(y, 0) : a.shape[0] + min(y, 0), max(x, 0) : a.shape[1] + min(x, 0)]
    a, b = cut(ref, dy, dx), cut(src, -dy, -dx)
    if min(a.shape) < TINY:
        return d_row, d_col, response
    e_row, e_col, clear = correlate(a, b)
    return (dy + e_row, dx + e_col, response) if clear >= response - 1e-6 and abs(e_row) < 1 and abs(e_col) < 1 else (d_row, d_col, response)


def grey(bands: list[np.ndarray]) -> np.ndarray:
    return 0.299 * bands[0] + 0.587 * bands[1] + 0.114 * bands[2] if len(bands) >= 3 else bands[0]


def _patch(pdf: pd.DataFrame, bands: list[str], height: int, width: int) -> np.ndarray:
    out = []
    for b in bands:
        a = np.zeros((height, width))
        a[pdf["py"].to_numpy(), pdf["px"].to_numpy()] = pdf[b].to_numpy(float)
        out.append(a)
    return grey(out)


def block_correlations(patches: DataFrame, bands: list[str]) -> DataFrame:
    """patches (pair_id, side in ref and src, py, px, height, width, bands) -> (pair_id, d_row, d_col, response), of patches that are blocks, refined: a pair is one task's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
        ref, src = (_patch(pdf[pdf["side"] == s], bands, h, w) for s in ("ref", "src"))
        return pd.DataFrame([(pdf["pair_id"].iloc[0], *refined(ref, src))], columns=["pair_id", "d_row", "d_col", "response"])

    kind = patches.schema["pair_id"].dataType.simpleString()
    return patches.select("pair_id", "side", "py", "px", "height", "width", *bands).groupBy("pair_id").applyInPandas(run, f"pair_id {kind}, d_row double, d_col double, response double")


# Patches of any size. A two-dimensional transform is one along the rows and one along the columns: bands of rows are
# transformed, exchanged as bands of columns, and back again.

#: Places of a band of rows or columns that a task holds, about.
BAND = 1 << 20


def thick(length: Column, area: int = BAND) -> Column:
    """How many rows or columns of this length make a band."""
    return F.greatest(F.floor(F.lit(area) / length), F.lit(1)).cast("int")


def _parts(a: np.ndarray, size: int, axis: int) -> list[tuple[int, bytes]]:
    """Pieces of a band across the other axis, numbered."""
    return [(k, np.ascontiguousarray(a[:, k * size : (k + 1) * size] if axis else a[k * size : (k + 1) * size]).tobytes()) for k in range(-(-a.shape[axis] // size))]


def shifts(patches: DataFrame, bands: list[str], area: int = BAND) -> DataFrame:
    """patches (pair_id, side in ref and src, py, px, height, width, bands) -> (pair_id, d_row, d_col, response), as correlate() has them.

    A patch is an overlap of two images of any size: a task holds a band of about area places of it. The correlation
    plane is written once, as its peak is known only when all of it is there; the surround of the peak is then read from
    the bands that hold it. Places without a pixel are 0.
    """
    kind = patches.schema["pair_id"].dataType.simpleString()
    light = F.lit(0.299) * F.col(bands[0]) + F.lit(0.587) * F.col(bands[1]) + F.lit(0.114) * F.col(bands[2]) if len(bands) >= 3 else F.col(bands[0])
    rows = patches.select("pair_id", "side", "py", "px", "height", "width", light.cast("double").alias("v")).withColumn("k", F.floor(F.col("py") / thick(F.col("width"), area)))

    def size(n: int) -> int:
        return max(1, area // n)

    def along_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        h, w, k = int(first["height"]), int(first["width"]), int(first["k"])
        top = k * size(w)
        a = np.zeros((min(size(w), h - top), w))
        a[pdf["py"].to_numpy() - top, pdf["px"].to_numpy()] = pdf["v"].to_numpy()
        a = np.fft.fft(a * np.outer(np.hanning(h)[top : top + len(a)], np.hanning(w)), axis=1)
        return pd.DataFrame([(first["pair_id"], first["side"], h, w, k, c, data) for c, data in _parts(a, size(h), 1)], columns=["pair_id", "side", "height", "width", "k", "c", "data"])

    def along_columns(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        h, w, c = int(first["height"]), int(first["width"]), int(first["c"])
        across = min(size(h), w - c * size(h))
        both = {s: np.zeros((h, across), complex) for s in ("ref", "src")}
        for r in pdf.itertuples():
            part = np.frombuffer(r.data, complex).reshape(-1, across)
            both[r.side][r.k * size(w) : r.k * size(w) + len(part)] = part
        cross = np.fft.fft(both["ref"], axis=0) * np.conj(np.fft.fft(both["src"], axis=0))
        length = np.abs(cross)
        plane = np.fft.ifft(cross / np.where(length > 0, length, 1), axis=0)
        return pd.DataFrame([(first["pair_id"], h, w, k, c, data) for k, data in _parts(plane, size(w), 0)], columns=["pair_id", "height", "width", "k", "c", "data"])

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        h, w, k = int(first["height"]), int(first["width"]), int(first["k"])
        a = np.zeros((min(size(w), h - k * size(w)), w), complex)
        for r in pdf.itertuples():
            across = min(size(h), w - r.c * size(h))
            a[:, r.c * size(h) : r.c * size(h) + across] = np.frombuffer(r.data, complex).reshape(-1, across)
        plane = np.real(np.fft.ifft(a, axis=1))
        sound = bool(np.isfinite(plane).all())
        py, px = np.unravel_index(int(plane.argmax()), plane.shape)
        return pd.DataFrame([(first["pair_id"], h, w, k, sound, float(plane[py, px]) if sound else 0.0, k * size(w) + int(py), int(px), plane.tobytes())], columns=["pair_id", "height", "width", "k", "sound", "peak", "py", "px", "data"])

    def around(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        h, w, py, px = (int(first[c]) for c in ("height", "width", "top_py", "top_px"))
        if not bool(first["all_sound"]) or h < 2 or w < 2:
            return pd.DataFrame([(first["pair_id"], 0.0, 0.0, 0.0)], columns=["pair_id", "d_row", "d_col", "response"])
        lines = {}
        for r in pdf.itertuples():
            plane = np.frombuffer(r.data).reshape(-1, w)
            lines |= {y: plane[y - r.k * size(w)] for y in {(py + d) % h for d in range(-2, 3)} if 0 <= y - r.k * size(w) < len(plane)}
        step = np.arange(-2, 3)
        near = np.stack([lines[(py + d) % h][(px + step) % w] for d in step])
        return pd.DataFrame([(first["pair_id"], *centred(near, py, px, h, w))], columns=["pair_id", "d_row", "d_col", "response"])

    forth = rows.groupBy("pair_id", "side", "k").applyInPandas(along_rows, f"pair_id {kind}, side string, height int, width int, k int, c int, data binary")
    crossed = forth.groupBy("pair_id", "c").applyInPandas(along_columns, f"pair_id {kind}, height int, width int, k int, c int, data binary")
    plane = shared.saved(crossed.groupBy("pair_id", "k").applyInPandas(back, f"pair_id {kind}, height int, width int, k int, sound boolean, peak double, py int, px int, data binary"), "planes")
    # Of equal peaks the first, row by row.
    top = plane.groupBy("pair_id").agg(F.max_by(F.struct("py", "px"), F.struct("peak", -F.col("py"), -F.col("px"))).alias("top"), F.min("sound").alias("all_sound"))
    found = plane.join(top, "pair_id").withColumns({"top_py": F.col("top.py"), "top_px": F.col("top.px")})
    high = thick(F.col("width"), area)
    holds = F.exists(F.sequence(F.lit(-2), F.lit(2)), lambda d: F.floor(F.pmod(F.col("top_py") + d, F.col("height")) / high) == F.col("k"))
    return found.where(holds).select("pair_id", "height", "width", "k", "top_py", "top_px", "all_sound", "data").groupBy("pair_id").applyInPandas(around, f"pair_id {kind}, d_row double, d_col double, response double")


def overlap_shift(pixels: DataFrame, before: DataFrame, now: dict, bands: list[str]) -> tuple[int, int]:
    """By how many whole pixels image now is to be moved onto the overlay of the images before it that it overlaps."""
    from .mosaic import overlay, reliable, whole_shift

    filled = overlay(pixels, before, bands)
    y0, x0 = max(0, now["row_off"]), max(0, now["col_off"])
    y1, x1 = min(now["grid_height"], now["row_off"] + now["height"]), min(now["grid_width"], now["col_off"] + now["width"])
    inside = filled.where(F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1))
    box = inside.agg(F.min("y").alias("a"), F.max("y").alias("b"), F.min("x").alias("c"), F.max("x").alias("d")).first()
    if box.a is None:
        return 0, 0
    h, w = box.b - box.a + 1, box.d - box.c + 1
    at = lambda df, side, y, x: df.select(F.lit(0).alias("pair_id"), F.lit(side).alias("side"), (y - box.a).alias("py"), (x - box.c).alias("px"), F.lit(h).alias("height"), F.lit(w).alias("width"), *bands).where(f"py between 0 and {h - 1} and px between 0 and {w - 1}")
    own = pixels.where(F.col("image_id") == now["image_id"])
    both = at(inside, "ref", F.col("y"), F.col("x")).unionByName(at(own, "src", F.col("y") + now["row_off"], F.col("x") + now["col_off"]))
    d_row, d_col = F.col("d_row"), F.col("d_col")
    if max(h, w) < MIN_OVERLAP:
        return 0, 0
    r = shifts(both, bands).select(reliable(F.lit(h), F.lit(w), F.col("response"), d_row, d_col).alias("ok"), whole_shift(d_row, d_col).alias("row"), whole_shift(d_col, d_row).alias("col")).first()
    return (r.row, r.col) if r.ok else (0, 0)


def block_size(height: int, width: int) -> int:
    return max(min(MOST, height // 2, width // 2), LEAST)


def block_shifts(ref: DataFrame, src: DataFrame, height: int, width: int, bands: list[str], block: int | None = None, step: int | None = None) -> DataFrame:
    """(y, x, d_row, d_col, response) of blocks half a block apart; (y, x): the middle of the block.

    A shift too long is taken as none and keeps its response; blocks too small give zeros.
    """
    n = block or block_size(height, width)
    step = step or n // 2
    reach = (n - 1) // step

    def laid(df: DataFrame, side: str) -> DataFrame:
        back = lambda c, top: F.sequence(F.greatest(F.floor(F.col(c) / step) - reach, F.lit(0)), F.least(F.floor(F.col(c) / step), F.lit(top // step)))
        if height < n or width < n:
            return df.select(F.lit(0).alias("by"), F.lit(0).alias("bx"), "y", "x", *bands).where(F.lit(False))
        rows = df.select("y", "x", *bands, F.explode(back("y", height - n)).alias("by")).select("*", F.explode(back("x", width - n)).alias("bx"))
        py, px = F.col("y") - F.col("by") * step, F.col("x") - F.col("bx") * step
        return rows.where((py < n) & (px < n)).select((F.col("by") * step * 1_000_000 + F.col("bx") * step).cast("bigint").alias("pair_id"), F.lit(side).alias("side"), py.cast("int").alias("py"), px.cast("int").alias("px"), F.lit(n).alias("height"), F.lit(n).alias("width"), *bands)

    if height < n or width < n or n < TINY:
        return ref.sparkSession.createDataFrame([], "y int, x int, d_row double, d_col double, response double")
    each = block_correlations(laid(ref, "ref").unionByName(laid(src, "src")), bands)
    far = F.hypot("d_row", "d_col") > MAX_SHIFT
    zero = lambda c: F.when(far, 0.0).otherwise(F.col(c)).alias(c)
    return each.select((F.floor(F.col("pair_id") / 1_000_000) + n // 2).cast("int").alias("y"), (F.col("pair_id") % 1_000_000 + n // 2).cast("int").alias("x"), zero("d_row"), zero("d_col"), "response")


def median_shift(blocks: DataFrame) -> DataFrame:
    """(d_row, d_col, response): medians over the blocks with a clear peak; zeros without any."""
    sure = blocks.where(F.col("response") >= MIN_RESPONSE)
    return sure.agg(*(F.coalesce(F.median(c), F.lit(0.0)).alias(c) for c in ("d_row", "d_col", "response")))

