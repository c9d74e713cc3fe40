"""Whole operations on files: images in, images or feature collections out.

Parameters are checked before anything is read. Pixels stay on the executors from the reader to the writer; the driver
gets the headers of the images, one row each. A result is listed in a report row with the names of what went in and
came out.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from .errors import EnhancementFailed, InvalidImage, MosaicFailed, OrthoFailed
from .operators import boxes, detect as detection, mosaic as mosaics, ortho as orthos, tiles, tone
from .params import CONFIDENCE, RPC_EXTENSIONS, SUFFIXES, Detect, Enhance, EnhanceRegions, Ortho
from .sources import files, geojson, geotiff, rpc as cameras

REPORT = "original string, output string, path string, width int, height int, bands int, dtype string, crs string"


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's reader of files names it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _listed(spark: SparkSession, paths: list[str] | str, extensions: tuple[str, ...] | None = None) -> None:
    """Raise for files that are missing, of a kind that isn't taken, or too large; contents are not read."""
    try:
        found = spark.read.format("binaryFile").load(paths).select("path", "length")
    except AnalysisException as e:
        raise InvalidImage(f"no such file: {paths}") from e
    files.checked(found, extensions) if extensions else files.checked(found)


def opened(spark: SparkSession, paths: list[str] | str) -> tuple[DataFrame, list[Row]]:
    """The images' headers, as a table and as rows."""
    _listed(spark, paths)
    rows = geotiff.scenes(spark, paths).collect()
    return spark.createDataFrame(rows, geotiff.SCENES), rows


def _base(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _name(path: str, operation: str) -> str:
    return _base(path).rsplit(".", 1)[0] + SUFFIXES[operation] + ".tiff"


def _written(px: DataFrame, info: DataFrame, names: tuple[str, ...], folder: str, output: dict[str, str] | str) -> list[str]:
    """Pixels as files; output: the suffix to each image's own name, or the one name there is."""
    parts = geotiff.assembled(px, info, names)
    called = F.lit(output) if isinstance(output, str) else files.output_name(F.col("image_id"), output["operation"])
    return geotiff.written(parts, info.withColumn("name", called), folder)


def _report(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, REPORT)


def _toned(spark: SparkSession, paths: list[str] | str, folder: str, change: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    info, rows = opened(spark, paths)
    if few := [r.image_id for r in rows if r.band_count < 3]:
        raise EnhancementFailed(f"{few[0]} has fewer than three bands")
    for dtype in sorted({r.dtype for r in rows}):  # a handful of sample types, each with its own expression
        own = [r.image_id for r in rows if r.dtype == dtype]
        px = geotiff.pixels(geotiff.chunks(spark, own))
        _written(change(px, dtype), info, ("r", "g", "b"), folder, {"operation": "enhance"})
    return _report(spark, [(_base(r.image_id), n := _name(r.image_id, "enhance"), f"{folder.rstrip('/')}/{n}", r.width, r.height, r.band_count, r.dtype, r.crs) for r in rows])


def enhance(spark: SparkSession, paths: list[str] | str, folder: str, brightness: float = 1.0, contrast: float = 1.0, saturation: float = 1.0, rescale: bool = False) -> DataFrame:
    """Linear tone enhancement of each image into folder; the report."""
    p = Enhance(brightness, contrast, saturation)
    return _toned(spark, paths, folder, lambda px, dtype: tone.enhance(px, p, dtype, rescale))


def enhance_regions(spark: SparkSession, paths: list[str] | str, folder: str, brightness: float = 0.0, contrast: float = 0.0, saturation: float = 0.0) -> DataFrame:
    """Water and vegetation set off, then gamma, S-curve and saturation; the report."""
    p = EnhanceRegions(brightness, contrast, saturation)
    return _toned(spark, paths, folder, lambda px, dtype: tone.enhance_regions(px, p, dtype))


def detect(spark: SparkSession, paths: list[str] | str, factory: detection.Factory, classes: str = "0,1,7,8", confidence: float = CONFIDENCE, cover_edges: bool = False) -> DataFrame:
    """(image_id, geojson): a feature collection for each image; factory makes a detector on a worker from a confidence and an overlap."""
    p = Detect(classes, confidence)
    p.class_ids()
    began = time.time()
    info, _ = opened(spark, paths)
    found = detection.detect(geotiff.windows(spark, paths, p.tile, p.overlap, cover_edges), factory, p).join(info.select("image_id", "transform"), "image_id")
    features = boxes.features(found, "transform", F.substring_index("image_id", "/", -1))
    return geojson.collections(features, boxes.class_counts(found), info, time.time() - began)


def mosaic(spark: SparkSession, paths: list[str], folder: str, register: bool = True) -> DataFrame:
    """One image of all, later ones over earlier ones; the report."""
    if not paths:
        raise MosaicFailed("no image")
    order = [qualified(spark, p) for p in paths]
    _, rows = opened(spark, paths)
    by_id = {r.image_id: r for r in rows}
    first = by_id[order[0]]
    if odd := [r.image_id for r in rows if r.dtype != first.dtype]:
        raise MosaicFailed(f"{odd[0]} has another sample type than the first image")
    scenes = spark.createDataFrame(
        [(i, i, k, r.transform[2], r.transform[5], r.transform[0], r.width, r.height, r.crs, r.band_count) for k, i in enumerate(order) for r in [by_id[i]]],
        "image_id string, path string, priority int, west double, north double, res double, width int, height int, crs string, bands int",
    )
    mosaics.check(scenes)
    names = tuple(f"b{k}" for k in range(first.band_count))
    px = geotiff.pixels(geotiff.chunks(spark, paths), names).drop("extra")
    grid = mosaics.union_bounds(scenes).first()
    name = files.mosaic_name(scenes).first().name
    info = spark.createDataFrame([(name, grid.width, grid.height, first.band_count, first.dtype, first.crs, [grid.res, 0.0, grid.west, 0.0, -grid.res, grid.north], None, first.nodata, first.geokeys)], geotiff.SCENES)
    out = mosaics.mosaic(px, scenes, list(names), register).withColumn("image_id", F.lit(name))
    _written(out, info, names, folder, name)
    return _report(spark, [(",".join(map(_base, order)), name, f"{folder.rstrip('/')}/{name}", grid.width, grid.height, first.band_count, first.dtype, first.crs)])


def ortho(spark: SparkSession, path: str, folder: str, rpc: str | None = None, dem: str | None = None, height: float = 0.0, dst_crs: str = "auto", resolution: float | None = None, resampling: str = "bilinear") -> DataFrame:
    """One image on the ground, by its camera model in a file or in its own tags; the report, with the system it is in."""
    p = Ortho(height, dst_crs, resolution, resampling)
    info, rows = opened(spark, path)
    r = rows[0]
    if rpc:
        _listed(spark, rpc, RPC_EXTENSIONS)
        model = cameras.read(spark, [rpc])
    elif r.rpc:
        model = cameras.from_array(info)
    else:
        raise OrthoFailed(f"no camera model for {path}")
    names = tuple(f"b{k}" for k in range(r.band_count))
    px = geotiff.pixels(geotiff.chunks(spark, path), names).select("y", "x", *names)
    out, ground = orthos.orthorectify(px, model.drop("image_id"), r.height, r.width, names, p, _heights(spark, dem) if dem else None)
    name = _name(path, "ortho")
    west, north, res = ground["west"], ground["north"], ground["res"]
    low, high = _range(r.dtype)
    # Whole samples are rounded; a kernel with negative lobes may leave their range.
    whole = lambda n: F.greatest(F.lit(low), F.least(F.lit(high), F.rint(n))).alias(n)
    kept = out.select(F.lit(name).alias("image_id"), "y", "x", *(F.col(n) if low is None else whole(n) for n in names))
    placed = spark.createDataFrame([(name, ground["width"], ground["height"], r.band_count, r.dtype, ground["crs"], [res, 0.0, west, 0.0, -res, north], None, r.nodata, _keys(ground["crs"]))], geotiff.SCENES)
    _written(kept, placed, names, folder, name)
    return _report(spark, [(_base(path), name, f"{folder.rstrip('/')}/{name}", ground["width"], ground["height"], r.band_count, r.dtype, ground["crs"])])


def _keys(crs: str) -> list[int]:
    """Keys of what an image was projected to: degrees, or a zone in metres, whatever the range its code lies in."""
    code = int(crs.split(":")[1])
    return [1024, 2, 1025, 1, 2048, code] if code in orthos.DEGREES else [1024, 1, 1025, 1, 3072, code]


def _range(dtype: str) -> tuple[float | None, float | None]:
    import numpy as np

    kind = np.dtype(dtype)
    return (float(np.iinfo(kind).min), float(np.iinfo(kind).max)) if kind.kind in "ui" else (None, None)


def _heights(spark: SparkSession, path: str) -> DataFrame:
    """An elevation model in degrees as operators.ortho.looked_up() takes it."""
    _, rows = opened(spark, path)
    if rows[0].crs not in (None, *(f"EPSG:{c}" for c in orthos.DEGREES)):
        raise OrthoFailed(f"the elevation model must be in degrees, not in {rows[0].crs}")
    res, _, west, _, down, north = rows[0].transform
    px = geotiff.pixels(geotiff.chunks(spark, path), ("h",))
    lon, lat = F.lit(west) + (F.col("x") + 0.5) * F.lit(res), F.lit(north) + (F.col("y") + 0.5) * F.lit(down)
    return px.select(F.floor(lon / res).alias("lon_cell"), F.floor(lat / res).alias("lat_cell"), "h", F.lit(res).alias("res"))


def crop(spark: SparkSession, path: str, folder: str, size: int) -> DataFrame:
    """The middle of an image, size x size, where it lies; the report."""
    info, rows = opened(spark, path)
    tiles.check_crop(info, size)
    r = rows[0]
    names = tuple(f"b{k}" for k in range(r.band_count))
    a, b, c, d, e, f = r.transform
    dx, dy = (r.width - size) // 2, (r.height - size) // 2
    px = tiles.centre_crop(geotiff.pixels(geotiff.chunks(spark, path), names), info, size).drop("extra")
    placed = spark.createDataFrame([(r.image_id, size, size, r.band_count, r.dtype, r.crs, [a, b, c + a * dx + b * dy, d, e, f + d * dx + e * dy], None, r.nodata, r.geokeys)], geotiff.SCENES)
    _written(px, placed, names, folder, _base(path))
    return _report(spark, [(_base(path), _base(path), f"{folder.rstrip('/')}/{_base(path)}", size, size, r.band_count, r.dtype, r.crs)])
