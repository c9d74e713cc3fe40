"""Displacement fields: from control points to a coarse grid, to every pixel, to a warped image."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources import shared

#: Nearest points that count; a point nearer than EXACT to a node gives it its own value; nodes to a side.
NEAREST, EXACT, EVERY, FEWEST = 8, 0.5, 4, 8


def nodes_of(n: int) -> int:
    return max(FEWEST, n // EVERY)


def node_at(i: Column, nodes: int, size: int) -> Column:
    """Where a node lies; in doubles, as the product is beyond an int on long images."""
    return i * F.lit(float(size - 1)) / F.lit(float(max(nodes - 1, 1)))


#: How much wider cells are made for nodes that are asked again; distances taken at once; the side of a block of nodes
#: that are asked together; so few points lie in one cell.
WIDER, AT_ONCE, BLOCK, FEW = 4, 1 << 22, 64, 256


def interpolated(at: DataFrame, points: DataFrame, values: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, j, values): inverse squared distances from nodes (by, i, j, gy, gx) to the nearest points (by, y, x, values).

    Points lie in cells that hold a few of them on average. A node looks at its own cell and the eight around it; where
    the nearest points found may not be the nearest of all, it is asked again with wider cells. Few points lie in one
    cell, so there is nothing to ask again. Nodes of images without any point get zeros. A block of nodes and the points
    of the cells that it looks at are one task's.
    """
    edge = lambda df, y, x: df.groupBy(*by).agg(F.min(y).alias("y0"), F.max(y).alias("y1"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.count("*").alias("n"))
    own = points.select(*by, F.col("y").cast("double").alias("py"), F.col("x").cast("double").alias("px"), *(F.col(v).cast("double").alias(v) for v in values))
    near, far = edge(own, "py", "px"), edge(at, "gy", "gx").drop("n")
    both = near.join(far.select(*by, *(F.col(c).alias(c + "_") for c in ("y0", "y1", "x0", "x1"))), [*by]) if by else near.crossJoin(far.select(*(F.col(c).alias(c + "_") for c in ("y0", "y1", "x0", "x1"))))  # one row each
    side = lambda k: F.greatest(f"{k}1", f"{k}1_") - F.least(f"{k}0", f"{k}0_")
    cells = both.where("n > 0").select(*by, "n", F.when(F.col("n") <= FEW, 2 * F.greatest(*(F.abs(F.col(c + e)) for c in "yx" for e in ("0", "1", "0_", "1_"))) + 1).otherwise(F.greatest(F.lit(1.0), 2 * F.sqrt(side("y") * side("x") / F.col("n")), (side("y") + side("x")) / F.lit(2000.0))).alias("cell"))
    join = lambda df, how: df.join(cells, [*by], how) if by else (df.crossJoin(F.broadcast(cells)) if how == "inner" else df.join(F.broadcast(cells), F.lit(True), how))
    own, asked = join(own, "inner"), join(at.select(*by, "i", "j", "gy", "gx"), "left")
    none = asked.where("n is null").select(*by, "i", "j", *(F.lit(0.0).alias(v) for v in values))
    left = asked.where("n is not null")
    names = [*by, "i", "j", "gy", "gx", "n", "cell"]
    kinds = ", ".join(f"{c} {left.schema[c].dataType.simpleString()}" for c in names) + "".join(f", {v} double" for v in values) + ", sure boolean"

    def run(nodes: pa.Table, pts: pa.Table) -> pa.Table:
        get = lambda t, c: t.column(c).to_numpy(zero_copy_only=False)
        py, px = get(pts, "py"), get(pts, "px")
        order = np.lexsort((px, py))
        py, px = py[order], px[order]
        z = [get(pts, v)[order] for v in values]
        gy, gx, total, reach = (get(nodes, c) for c in ("gy", "gx", "n", "cell"))
        cols, sure = [np.zeros(len(nodes)) for _ in values], np.zeros(len(nodes), bool)
        step = max(1, AT_ONCE // max(1, len(pts)))
        for a in range(0, len(nodes) if len(pts) else 0, step):
            at_ = slice(a, a + step)
            d2 = (gy[at_, None] - py) ** 2 + (gx[at_, None] - px) ** 2
            first = np.argsort(d2, axis=1, kind="stable")[:, :NEAREST]
            d2 = np.take_along_axis(d2, first, axis=1)
            w = 1.0 / (d2 + 1e-10)
            for out_, own_ in zip(cols, z, strict=True):
                out_[at_] = np.where(d2[:, 0] < EXACT * EXACT, own_[first[:, 0]], (w * own_[first]).sum(axis=1) / w.sum(axis=1))
            sure[at_] = (total[at_] == len(pts)) | ((d2[:, -1] < reach[at_] * reach[at_]) & (len(pts) >= NEAREST))
        return pa.table({c: nodes.column(c) for c in names} | dict(zip(values, map(pa.array, cols), strict=True)) | {"sure": pa.array(sure)})

    out, wide, keys = none, 1, [*by, "cy", "cx"]
    block = (F.floor(F.col("i") / BLOCK) * 1_000_003 + F.floor(F.col("j") / BLOCK)).alias("block")
    while True:
        place = lambda c, w=wide: F.floor(F.col(c) / (F.col("cell") * w))
        nodes = left.withColumn("cell", F.col("cell") * wide).withColumns({"cy": F.floor(F.col("gy") / F.col("cell")), "cx": F.floor(F.col("gx") / F.col("cell"))}).withColumn("block", block)
        around = F.array(F.lit(-1), F.lit(0), F.lit(1))
        spread = own.select(*by, "py", "px", *values, place("py").alias("cy"), place("px").alias("cx")).select("*", F.explode(around).alias("ry")).select("*", F.explode(around).alias("rx"))
        spread = spread.select(*by, "py", "px", *values, (F.col("cy") + F.col("ry")).alias("cy"), (F.col("cx") + F.col("rx")).alias("cx"))
        met = spread.join(nodes.select(*keys, F.col("block").alias("met")).distinct(), keys)
        found = shared.saved(nodes.groupBy(*keys, "block").cogroup(met.groupBy(*keys, "met")).applyInArrow(run, kinds), "nodes")
        out = out.unionByName(found.where("sure").select(*by, "i", "j", *values))
        left = found.where("not sure").select(*by, "i", "j", "gy", "gx", "n", (F.col("cell") / wide).alias("cell"))
        if left.isEmpty():
            return out
        wide *= WIDER


def idw(points: DataFrame, height: int, width: int, values: tuple[str, ...] = ("dx", "dy"), nodes: tuple[int, int] | None = None) -> DataFrame:
    """(i, j, values): interpolated() at the nodes of a grid over an image; no points give zeros, one gives its own value everywhere."""
    ny, nx = nodes or (nodes_of(height), nodes_of(width))
    grid = points.sparkSession.range(ny).select(F.col("id").cast("int").alias("i")).select("i", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("j"))
    return interpolated(grid.withColumns({"gy": node_at(F.col("i"), ny, height), "gx": node_at(F.col("j"), nx, width)}), points, values)


def resized(coarse: DataFrame, nodes: tuple[int, int], height: int, width: int, values: tuple[str, ...] = ("dx", "dy")) -> DataFrame:
    """(y, x, values): the field at every pixel, bilinear between nodes by pixel centres, the edge beyond them."""
    ny, nx = nodes
    spark = coarse.sparkSession
    grid = spark.range(height).select(F.col("id").cast("int").alias("y")).select("y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    src = lambda c, n, size: F.least(F.greatest((F.col(c) + 0.5) * F.lit(n / size) - 0.5, F.lit(0.0)), F.lit(float(n - 1)))
    return sampled(grid.withColumns({"sy": src("y", ny, height), "sx": src("x", nx, width)}), coarse.select(F.col("i").alias("y"), F.col("j").alias("x"), *values), ny, nx, values)


#: Half the width of each kernel; the parameter of cubic convolution.
KERNELS = {"bilinear": 1, "cubic": 2, "lanczos": 3}
SHARPNESS = -0.5


def _weight(t: np.ndarray, kernel: str) -> np.ndarray:
    """The kernel at distance t, which is within its half width."""
    if kernel == "cubic":
        t, a = np.abs(t), SHARPNESS
        return np.where(t <= 1, ((a + 2) * t - (a + 3)) * t * t + 1, ((a * t - 5 * a) * t + 8 * a) * t - 4 * a)
    return np.sinc(t) * np.sinc(t / KERNELS[kernel])


def taps(f: np.ndarray, kernel: str = "bilinear") -> list[tuple[int, np.ndarray]]:
    """(steps from the place below, weight) of the places along an axis that count at a fraction f beyond it."""
    if kernel == "bilinear":
        return [(0, 1 - f), (1, f)]
    half = KERNELS[kernel]
    return [(k, _weight(f - k, kernel)) for k in range(1 - half, half + 1)]


#: The side of a chunk that is sampled at once.
CHUNK = 128


def sampled(at: DataFrame, image: DataFrame, height: int, width: int, values: tuple[str, ...], kernel: str = "bilinear", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, y, x, values) of image (by, y, x, values) at the places (by, y, x, sy, sx), the edge replicated; by: what tells images apart.

    Places go to the chunk that they lie in, once each, and meet its pixels and those around it that the kernel
    reaches; a chunk is one array. Pixels that are missing or null don't count, and places without any are left out.
    """
    half = KERNELS[kernel]
    clamp = lambda c, n: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(n - 1))
    cell = lambda c: F.floor(c / CHUNK).cast("int")
    reach = lambda c, n: F.sequence(F.greatest(cell(F.col(c) - half), F.lit(0)), F.least(cell(F.col(c) + half), F.lit((n - 1) // CHUNK)))
    places = at.where("sy is not null and sx is not null").select(*by, "y", "x", F.col("sy").cast("double").alias("sy"), F.col("sx").cast("double").alias("sx"), cell(clamp("sy", height)).alias("_cy"), cell(clamp("sx", width)).alias("_cx"))
    inside = image.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    laid = inside.select(*by, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *(F.col(v).cast("double").alias(v) for v in values), F.explode(reach("y", height)).alias("_cy"))
    laid = laid.select("*", F.explode(reach("x", width)).alias("_cx"))
    side = CHUNK + 2 * half

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        get = lambda t, c: t.column(c).to_numpy(zero_copy_only=False)
        keep = [*by, "y", "x"]
        if not len(left) or not len(right):
            return pa.table({c: left.column(c).slice(0, 0) for c in keep} | {v: pa.array([], pa.float64()) for v in values})
        top, first = (int(left.column(c)[0].as_py()) * CHUNK - half for c in ("_cy", "_cx"))
        y, x = get(right, "y") - top, get(right, "x") - first
        sy, sx = get(left, "sy"), get(left, "sx")
        y0, x0 = np.floor(sy), np.floor(sx)
        near = [(np.clip(y0 + dy, 0, height - 1).astype(np.int64) - top, np.clip(x0 + dx, 0, width - 1).astype(np.int64) - first, wy * wx) for dy, wy in taps(sy - y0, kernel) for dx, wx in taps(sx - x0, kernel)]
        cols, any_ = {}, np.zeros(len(left), bool)
        for v in values:
            plane, there = np.zeros((side, side)), np.zeros((side, side), bool)
            own = get(right, v)
            plane[y, x], there[y, x] = np.nan_to_num(own), ~np.isnan(own)
            total, weight, found = np.zeros(len(left)), np.zeros(len(left)), np.zeros(len(left), bool)
            for i, j, w in near:
                on = there[i, j] & (w != 0)
                total += np.where(on, w * plane[i, j], 0.0)
                weight += np.where(on, w, 0.0)
                found |= on
            # The weights of the last kernel sum to nearly one only.
            cols[v] = pa.array(total / np.where(found & (weight != 0), weight, 1.0) if kernel == "lanczos" else total, mask=~found)
            any_ |= found
        return pa.table({c: left.column(c) for c in keep} | cols).filter(pa.array(any_))

    kinds = ", ".join(f"{c} {at.schema[c].dataType.simpleString()}" for c in (*by, "y", "x"))
    keys = (*by, "_cy", "_cx")
    return places.groupBy(*keys).cogroup(laid.groupBy(*keys)).applyInArrow(run, kinds + "".join(f", {v} double" for v in values))


def translated(image: DataFrame, d_row: float, d_col: float, height: int, width: int, values: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """dst(y, x) = src(y - d_row, x - d_col), of each image that by tells apart."""
    return sampled(image.select(*by, "y", "x", (F.col("y") - F.lit(d_row)).alias("sy"), (F.col("x") - F.lit(d_col)).alias("sx")), image, height, width, values, by=by)


def remapped(image: DataFrame, field: DataFrame, height: int, width: int, values: tuple[str, ...], legacy_sign: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """dst(y, x) = src(y - dy, x - dx): the same direction as translated(); legacy_sign samples at y + dy, x + dx."""
    sign = 1.0 if legacy_sign else -1.0
    return sampled(field.select(*by, "y", "x", (F.col("y") + sign * F.col("dy")).alias("sy"), (F.col("x") + sign * F.col("dx")).alias("sx")), image, height, width, values, by=by)


def block_warp(ref: DataFrame, src: DataFrame, height: int, width: int, bands: list[str], step: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(warped src, median response): along the field of the blocks' shifts, or by their median if under four are sure."""
    from ..params import MIN_RESPONSE
    from .registration import block_shifts, block_size, median_shift

    n = block_size(height, width)
    blocks = shared.saved(block_shifts(ref, src, height, width, bands, n, max(step or n // 2, 8)), "blocks")
    points = blocks.where(F.col("response") >= MIN_RESPONSE).select("y", "x", F.col("d_col").alias("dx"), F.col("d_row").alias("dy"), "response")
    image = src.select("y", "x", *bands)
    if points.count() < 4:
        m = median_shift(blocks).first()
        return translated(image, m.d_row, m.d_col, height, width, tuple(bands)), median_shift(blocks).select("response")
    nodes = (nodes_of(height), nodes_of(width))
    field = resized(idw(points, height, width, nodes=nodes), nodes, height, width)
    return remapped(image, field, height, width, tuple(bands)), points.agg(F.median("response").alias("response"))
