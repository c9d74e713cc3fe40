"""Orthorectification: a grid on the ground, each place looked up in the image through its camera model."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import OrthoFailed
from ..functions import geodesy
from ..params import Ortho
from .field import sampled


def resolved_crs(dst_crs: str, long_off: float) -> str:
    """auto (a Gauss-Krueger zone by the model's longitude), EPSG:n, or a Proj4 or WKT text as it stands."""
    if dst_crs.strip().lower() == "auto":
        zone = max(geodesy.ZONES[0], min(geodesy.ZONES[1], round((long_off - 1.5) / 3)))
        return f"EPSG:{geodesy.FIRST_EPSG + zone}"
    text = dst_crs.strip()
    if re.fullmatch(r"(?i)epsg:\d+", text):
        return text.upper()
    if text.startswith("+") or re.match(r"[A-Z]+\[", text):
        return text
    raise OrthoFailed(f"unknown coordinate reference system: {dst_crs!r}")


def footprint(model: dict, height: int, width: int, h: float, steps: int = 10) -> tuple[float, float, float, float]:
    """(west, south, east, north) of the image's border on the ground at height h, by Newton steps on the model."""
    import numpy as np

    def line_samp(lon, lat):
        p, l, z = (lat - model["lat_off"]) / model["lat_scale"], (lon - model["long_off"]) / model["long_scale"], (h - model["height_off"]) / model["height_scale"]  # noqa: E741
        one = np.ones_like(p)
        x = np.array([one, l, p, z * one, l * p, l * z, p * z, l * l, p * p, z * z * one, p * l * z, l**3, l * p * p, l * z * z, l * l * p, p**3, p * z * z, l * l * z, p * p * z, z**3 * one])
        ratio = lambda a, b: np.tensordot(model[a], x, 1) / np.tensordot(model[b], x, 1)
        return ratio("line_num_coeff", "line_den_coeff") * model["line_scale"] + model["line_off"], ratio("samp_num_coeff", "samp_den_coeff") * model["samp_scale"] + model["samp_off"]

    t = np.linspace(0, 1, 21)
    rows = np.concatenate([t * 0, t * 0 + height, t * height, t * height])
    cols = np.concatenate([t * width, t * width, t * 0, t * 0 + width])
    lon, lat = np.full(len(rows), model["long_off"]), np.full(len(rows), model["lat_off"])
    for _ in range(steps):
        a, b = line_samp(lon, lat)
        d = 1e-6
        (a1, b1), (a2, b2) = line_samp(lon + d, lat), line_samp(lon, lat + d)
        j = np.array([[(a1 - a) / d, (a2 - a) / d], [(b1 - b) / d, (b2 - b) / d]])
        det = j[0, 0] * j[1, 1] - j[0, 1] * j[1, 0]
        da, db = rows - a, cols - b
        lon, lat = lon + (j[1, 1] * da - j[0, 1] * db) / det, lat + (j[0, 0] * db - j[1, 0] * da) / det
    return float(lon.min()), float(lat.min()), float(lon.max()), float(lat.max())


#: Codes of systems in degrees that can be projected to.
DEGREES = (4326, 4490)


def meridian_of(crs: str) -> float | None:
    """The central meridian of a Gauss-Krueger zone, None for degrees; anything else has no projection here."""
    m = re.fullmatch(r"EPSG:(\d+)", crs)
    code = int(m[1]) if m else 0
    if geodesy.ZONES[0] <= code - geodesy.FIRST_EPSG <= geodesy.ZONES[1]:
        return 3.0 * (code - geodesy.FIRST_EPSG)
    if code in DEGREES:
        return None
    raise OrthoFailed(f"only degrees and Gauss-Krueger zones are projected to: {crs}")


def ground_grid(spark: SparkSession, west: float, north: float, res: float, height: int, width: int, meridian: float | None = None) -> DataFrame:
    """(y, x, lon, lat): the middles of the grid's cells, which are metres in a zone if there is a meridian."""
    grid = spark.range(height).select(F.col("id").cast("int").alias("y")).select("y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    e, n = F.lit(west) + (F.col("x") + 0.5) * res, F.lit(north) - (F.col("y") + 0.5) * res
    lon, lat = (e, n) if meridian is None else geodesy.gk_inverse(e, n, F.lit(meridian))
    return grid.select("y", "x", lon.alias("lon"), lat.alias("lat"))


def heights(grid: DataFrame, dem: DataFrame, h: float) -> DataFrame:
    """grid (y, x, lon, lat) with h: bilinear between the middles of the cells of dem (lon_cell, lat_cell, h, res), the given height beyond them."""
    box = dem.agg(F.min("lat_cell").alias("y0"), F.max("lat_cell").alias("y1"), F.min("lon_cell").alias("x0"), F.max("lon_cell").alias("x1"), F.first("res").alias("res")).first()
    if box.res is None:
        return grid.withColumn("h", F.lit(float(h)))
    rows, cols = box.y1 - box.y0 + 1, box.x1 - box.x0 + 1
    cells = dem.select((F.col("lat_cell") - box.y0).alias("y"), (F.col("lon_cell") - box.x0).alias("x"), "h")
    places = grid.select("y", "x", (F.col("lat") / box.res - 0.5 - box.y0).alias("sy"), (F.col("lon") / box.res - 0.5 - box.x0).alias("sx"))
    inside = places.where(F.col("sy").between(-0.5, rows - 0.5) & F.col("sx").between(-0.5, cols - 0.5))
    return grid.join(sampled(inside, cells, rows, cols, ("h",)), ["y", "x"], "left").withColumn("h", F.coalesce("h", F.lit(float(h))))


def looked_up(grid: DataFrame, rpc: DataFrame, h: float = 0.0, dem: DataFrame | None = None) -> DataFrame:
    """The grid with sy, sx: where each place is in the image. rpc has one row; dem (lon_cell, lat_cell, h, res) is in degrees."""
    model = rpc.select(F.struct(*rpc.columns).alias("rpc"))
    high = grid.withColumn("h", F.lit(float(h))) if dem is None else heights(grid, dem, h)
    at = high.crossJoin(F.broadcast(model))  # one row
    line, samp = geodesy.image_point(F.col("rpc"), F.col("lon"), F.col("lat"), F.col("h"))
    return at.select("y", "x", "lon", "lat", line.alias("sy"), samp.alias("sx"))


def rectified(image: DataFrame, at: DataFrame, height: int, width: int, values: tuple[str, ...], resampling: str = "bilinear") -> DataFrame:
    """(y, x, values): the image at the places looked up; 0 outside it."""
    inside = at.where((F.col("sy") >= 0) & (F.col("sx") >= 0) & (F.col("sy") <= height - 1) & (F.col("sx") <= width - 1))
    if resampling == "nearest":
        near = inside.select("y", "x", F.rint("sy").cast("int").alias("ny"), F.rint("sx").cast("int").alias("nx"))
        found = near.join(image.select(F.col("y").alias("ny"), F.col("x").alias("nx"), *values), ["ny", "nx"]).select("y", "x", *values)
    else:
        found = sampled(inside, image, height, width, values, resampling)
    return at.select("y", "x").join(found, ["y", "x"], "left").select("y", "x", *(F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values))


def orthorectify(image: DataFrame, rpc: DataFrame, height: int, width: int, values: tuple[str, ...], p: Ortho = Ortho(), dem: DataFrame | None = None) -> tuple[DataFrame, dict]:  # noqa: B008
    """(pixels, {crs, west, north, res, height, width}) of one image (y, x, values). Height and elevation model are both heeded."""
    model = rpc.first().asDict()
    crs = resolved_crs(p.dst_crs, model["long_off"])
    meridian = meridian_of(crs)
    west, south, east, north = footprint(model, height, width, p.height)
    if meridian is not None:
        border = [(west + (east - west) * i / 8, lat) for i in range(9) for lat in (south, (south + north) / 2, north)]
        xy = image.sparkSession.createDataFrame(border, "lon double, lat double").select(*(c.alias(n) for c, n in zip(geodesy.gk_forward(F.col("lon"), F.col("lat"), F.lit(meridian)), "en", strict=True))).collect()
        west, south, east, north = min(r.e for r in xy), min(r.n for r in xy), max(r.e for r in xy), max(r.n for r in xy)
    res = p.resolution or max((east - west) / width, (north - south) / height)
    rows, cols = round((north - south) / res), round((east - west) / res)
    if rows < 1 or cols < 1:
        raise OrthoFailed("the image covers no cell of the grid")
    at = looked_up(ground_grid(image.sparkSession, west, north, res, rows, cols, meridian), rpc, p.height, dem)
    info = {"crs": crs, "west": west, "north": north, "res": res, "height": rows, "width": cols}
    return rectified(image, at, height, width, values, p.resampling), info
