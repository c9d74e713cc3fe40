"""The registered queries, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geodesy, tone
from ..operators import boxes, field, mosaic, ortho, registration, tiles, tone as tones
from ..params import MIN_RESPONSE, Enhance, EnhanceRegions
from ..sources import files, geojson, geotiff, rpc, shared, tables
from . import sqltext as q

FLAGSHIP = "enhance_linear"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Query = Callable[[SparkSession, str], DataFrame]


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


DIGITS = 9


def _cols(names: str) -> tuple:
    return tuple(F.col(c) for c in names)


def _round(df: DataFrame, names: str | tuple, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tones.normalised(tables.pixels(spark, sf_dir))


def _rgb(values: tuple) -> dict:
    return dict(zip("rgb", values, strict=True))


def _three(f: Callable[[str], str]) -> str:
    return ", ".join(f"{f(c)} AS {c}" for c in "rgb")


def _r(v: str, digits: int = DIGITS) -> str:
    return f"round({v}, {digits})"


# Tone: normalisation and the linear chain.

register("normalize_u8", f"SELECT * FROM {q.NORMAL}")(_normal)


@register("denormalize_u8", f"SELECT image_id, y, x, {_three(lambda c: q.truncated(f'{c} * 0.7e0'))} FROM {q.NORMAL}")
def _(spark, sf):
    df = _normal(spark, sf)
    return tones.denormalised(df.withColumns({c: F.col(c) * 0.7 for c in "rgb"}))


@register("normalize_minmax", f"SELECT image_id, y, x, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END AS v FROM (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM ({tables.FLOATS}))")
def _(spark, sf):
    df = tables.floats(spark, sf)
    span = df.groupBy("image_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return df.join(span, "image_id").select("image_id", "y", "x", tone.normalise(F.col("v"), "float32", F.col("lo"), F.col("hi")).alias("v"))


def _each(name: str, f: Callable, sql: Callable[[str], str], rounded: bool = False) -> None:
    text = lambda c: _r(sql(c)) if rounded else sql(c)

    @register(name, f"SELECT image_id, y, x, {_three(text)} FROM {q.NORMAL}")
    def _(spark, sf):
        out = _normal(spark, sf).withColumns({c: f(F.col(c)) for c in "rgb"})
        return _round(out, "rgb") if rounded else out


_each("brightness", lambda v: tone.brightness(v, 1.4), lambda v: q.brightness(v, 1.4))
_each("contrast", lambda v: tone.contrast(v, 1.7), lambda v: q.contrast(v, 1.7))
_each("gamma", lambda v: tone.gamma(v, 0.6), lambda v: q.gamma(v, 0.6), True)
_each("s_curve_pos", lambda v: tone.s_curve(v, 0.4), lambda v: q.s_curve(v, 0.4), True)
_each("s_curve_neg", lambda v: tone.s_curve(v, -0.3), lambda v: q.s_curve(v, -0.3), True)


@register("saturation", f"SELECT image_id, y, x, {_three(lambda c: q.saturation(c, 1.6))} FROM {q.NORMAL}")
def _(spark, sf):
    df = _normal(spark, sf)
    return df.withColumns(_rgb(tone.saturation(_cols("rgb"), 1.6)))


_linear = f"(SELECT image_id, y, x, {_three(lambda c: q.contrast(q.brightness(c, 1.2), 1.5))} FROM {q.NORMAL})"


@register("enhance_linear", f"SELECT image_id, y, x, {_three(lambda c: q.truncated(q.saturation(c, 1.3)))} FROM {_linear}")
def _(spark, sf):
    return tones.enhance(tables.pixels(spark, sf), Enhance(1.2, 1.5, 1.3))


@register("extra_bands", f"SELECT y, x, [{q.truncated(q.brightness('r', 1.2))}, {q.truncated(q.brightness('g', 1.2))}, {q.truncated(q.brightness('b', 1.2))}, CAST((y + x) % 256 AS INTEGER)] AS bands FROM {q.NORMAL}")
def _(spark, sf):
    df = tables.pixels(spark, sf).withColumn("extra", F.array(((F.col("y") + F.col("x")) % 256).cast("int")))
    return tones.enhance(df, Enhance(brightness=1.2)).select("y", "x", F.concat(F.array("r", "g", "b"), "extra").alias("bands"))


@register("grayscale", f"SELECT image_id, y, x, {q.LUMA} AS v FROM {q.NORMAL}")
def _(spark, sf):
    return _normal(spark, sf).select("image_id", "y", "x", tone.luma(*_cols("rgb")).alias("v"))


# Tone: hue, saturation and value.


@register("hsv_forward", f"SELECT image_id, y, x, h, s, v FROM {q.to_hsv(q.NORMAL)}")
def _(spark, sf):
    h, s, v = tone.to_hsv(*_cols("rgb"))
    return _normal(spark, sf).select("image_id", "y", "x", h.alias("h"), s.alias("s"), v.alias("v"))


@register("hsv_roundtrip", f"SELECT * FROM {q.from_hsv(q.to_hsv(q.NORMAL))}")
def _(spark, sf):
    return tones.tone_v1(_normal(spark, sf), 0.0, 0.0, 0.0)


@register("hsv_saturation", f"SELECT * FROM {q.tone_v1(q.NORMAL, 0.0, 0.0, 0.25)}")
def _(spark, sf):
    return tones.tone_v1(_normal(spark, sf), 0.0, 0.0, 0.25)


@register("tone_v1", f"SELECT * FROM {q.tone_v1(q.NORMAL, 0.3, 0.4, 0.25)}")
def _(spark, sf):
    return tones.tone_v1(_normal(spark, sf), 0.3, 0.4, 0.25)


# Regions.


@register("gli", f"SELECT image_id, y, x, {q.GLI} AS gli FROM {q.NORMAL}")
def _(spark, sf):
    return _normal(spark, sf).select("image_id", "y", "x", tone.gli(*_cols("rgb")).alias("gli"))


register("otsu_threshold", f"SELECT image_id, bin FROM {q.otsu()}")(lambda spark, sf: tones.otsu(_normal(spark, sf)))
register("vegetation_threshold", f"SELECT image_id, otsu, {_r('coverage')} AS coverage, {_r('p55')} AS p55, {_r('threshold')} AS threshold FROM {q.vegetation()}")(lambda spark, sf: _round(tones.vegetation(_normal(spark, sf)), ("coverage", "p55", "threshold")))


@register("coverage", f"SELECT image_id, {_r('coverage')} AS coverage FROM {q.vegetation()}")
def _(spark, sf):
    return _round(tones.vegetation(_normal(spark, sf)).select("image_id", "coverage"), ("coverage",))


@register("p55", f"SELECT image_id, {_r('p55')} AS p55 FROM {q.vegetation()}")
def _(spark, sf):
    return _round(tones.vegetation(_normal(spark, sf)).select("image_id", "p55"), ("p55",))


@register("water_mask", f"SELECT image_id, y, x, water FROM {q.masks()}")
def _(spark, sf):
    return tones.masks(_normal(spark, sf)).select("image_id", "y", "x", "water")


@register("vegetation_mask", f"SELECT image_id, y, x, vegetation FROM {q.masks()}")
def _(spark, sf):
    return tones.masks(_normal(spark, sf)).select("image_id", "y", "x", "vegetation")


@register("gaussian3x3", f"SELECT * FROM {q.blurred(q.NORMAL, 'r', 'image_id, y, x')}")
def _(spark, sf):
    return tones.blurred(_normal(spark, sf).select("image_id", "y", "x", "r"), "r")


_boost = f"(SELECT image_id, y, x, {q.clip('b * (1e0 + water * 0.2e0 * 0.5e0)')} AS b, {q.clip('r * (1e0 - water * 0.2e0 * 0.3e0)')} AS r, g, vegetation FROM {q.masks()})"
_green = f"(SELECT image_id, y, x, b, {q.clip('g * (1e0 + vegetation * 0.18e0 * 0.5e0)')} AS g, {q.clip('r * (1e0 - vegetation * 0.18e0 * 0.2e0)')} AS r FROM {_boost})"


@register("region_boost", f"SELECT image_id, y, x, {_r('b')} AS b, {_r('g')} AS g, {_r('r')} AS r FROM {_boost}")
def _(spark, sf):
    b, r = tone.region(F.col("b"), F.col("r"), F.col("water"), 0.2, 0.5, 0.3)
    return _round(tones.masks(_normal(spark, sf)).withColumns({"b": b, "r": r}).select("image_id", "y", "x", "b", "g", "r"), "bgr")


@register("enhance_regions", f"SELECT image_id, y, x, {_three(q.truncated)} FROM {q.tone_v1(_green, 0.2, 0.3, 0.1)}")
def _(spark, sf):
    return tones.enhance_regions(tables.pixels(spark, sf), EnhanceRegions(0.2, 0.3, 0.1))


# Windows.

_wide = f"(SELECT image_id, width * 40 AS width, height * 40 AS height FROM ({tables.SCENES}))"
_windows = f"""(SELECT image_id, CAST((row_off // 544) * ceil(width / 544e0) + col_off // 544 AS INTEGER) AS tile_id, CAST(row_off AS INTEGER) AS row_off, CAST(col_off AS INTEGER) AS col_off,
  CAST(least(640, width - col_off) AS INTEGER) AS tile_width, CAST(least(640, height - row_off) AS INTEGER) AS tile_height
  FROM (SELECT *, unnest(range(0, height, 544)) AS row_off FROM (SELECT *, unnest(range(0, width, 544)) AS col_off FROM {_wide})) WHERE least(640, width - col_off) >= 192 AND least(640, height - row_off) >= 192)"""


def _large_scenes(spark: SparkSession, sf: str) -> DataFrame:
    return tables.scenes(spark, sf).withColumns({"width": F.col("width") * 40, "height": F.col("height") * 40})


register("tile_windows", f"SELECT * FROM {_windows}")(lambda spark, sf: tiles.windows(_large_scenes(spark, sf)))


@register("tile_area", f"SELECT image_id, count(*) AS tiles, CAST(sum(tile_width * tile_height) AS BIGINT) AS seen FROM {_windows} GROUP BY image_id")
def _(spark, sf):
    return tiles.windows(_large_scenes(spark, sf)).groupBy("image_id").agg(F.count("*").alias("tiles"), F.sum(F.col("tile_width") * F.col("tile_height")).cast("long").alias("seen"))


def _extent(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


_size = f"(SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM ({tables.PIXELS}) GROUP BY image_id)"


@register("tile_coverage", f"""SELECT p.image_id, row_off, col_off, count(*) AS n, min(r) AS lo, max(r) AS hi FROM ({tables.PIXELS}) p JOIN (
  SELECT image_id, width, height, CAST(unnest(range(0, height, 54)) AS INTEGER) AS row_off, col_off FROM (SELECT *, CAST(unnest(range(0, width, 54)) AS INTEGER) AS col_off FROM {_size})) w
  ON p.image_id = w.image_id AND p.y >= row_off AND p.y < row_off + least(64, height - row_off) AND p.x >= col_off AND p.x < col_off + least(64, width - col_off)
  WHERE least(64, width - col_off) >= 0.3 * 64 AND least(64, height - row_off) >= 0.3 * 64 GROUP BY p.image_id, row_off, col_off""")
def _(spark, sf):
    px = tables.pixels(spark, sf)
    return tiles.tiled(px, _extent(px), 64, 0.15).groupBy("image_id", "row_off", "col_off").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))


@register("reflect_pad_index", f"SELECT image_id, CAST(i AS INTEGER) AS i, CAST(CASE WHEN i % (2 * (width - 1)) < width THEN i % (2 * (width - 1)) ELSE 2 * (width - 1) - i % (2 * (width - 1)) END AS INTEGER) AS src FROM (SELECT image_id, width, unnest(range(0, 120)) AS i FROM ({tables.SCENES}))")
def _(spark, sf):
    return tiles.pad_index(tables.scenes(spark, sf).select("image_id", F.col("width").alias("n")), 120)


@register("center_crop", f"SELECT p.image_id, CAST(y - (height - 12) // 2 AS INTEGER) AS y, CAST(x - (width - 12) // 2 AS INTEGER) AS x, r, g, b FROM ({tables.PIXELS}) p JOIN {_size} s ON p.image_id = s.image_id WHERE y BETWEEN (height - 12) // 2 AND (height - 12) // 2 + 11 AND x BETWEEN (width - 12) // 2 AND (width - 12) // 2 + 11")
def _(spark, sf):
    px = tables.pixels(spark, sf)
    return tiles.centre_crop(px, _extent(px), 12)


@register("band_select", f"SELECT y, x, [r, g, b] AS three, [r, g, 0] AS two, [r, r, r] AS one FROM ({tables.PIXELS})")
def _(spark, sf):
    r, g, b = _cols("rgb")
    return tables.pixels(spark, sf).select("y", "x", *(F.array(*tiles.three_bands(c)).alias(n) for n, c in (("three", [r, g, b, r]), ("two", [r, g]), ("one", [r]))))


@register("u16_to_u8", f"SELECT y, x, CAST((r * 257) >> 8 AS INTEGER) AS v FROM ({tables.PIXELS})")
def _(spark, sf):
    return tables.pixels(spark, sf).select("y", "x", tiles.to_byte(F.col("r") * 257, "uint16").alias("v"))


@register("window_minmax", f"SELECT y, x, CAST(CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 255e0) ELSE 0 END AS INTEGER) AS v FROM (SELECT *, min(v) OVER (PARTITION BY y // 16) AS lo, max(v) OVER (PARTITION BY y // 16) AS hi FROM ({tables.FLOATS}))")
def _(spark, sf):
    df = tables.floats(spark, sf).withColumn("w", F.floor(F.col("y") / 16))
    span = df.groupBy("w").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return df.join(span, "w").select("y", "x", tiles.to_byte(F.col("v"), "float32", F.col("lo"), F.col("hi")).alias("v"))


@register("area_downscale", f"SELECT image_id, CAST(y // 4 AS INTEGER) AS y, CAST(x // 4 AS INTEGER) AS x, {_three(lambda c: _r(f'avg({c})'))} FROM ({tables.PIXELS}) GROUP BY image_id, y // 4, x // 4")
def _(spark, sf):
    return _round(geojson.downscaled(tables.pixels(spark, sf), 4), "rgb")


# Files: the image is written as a tiled file into the shared folder, by many tasks, and read again in parts.

TILE_SIDE = 64


def _as_file(spark: SparkSession, sf: str) -> str:
    px = tables.pixels(spark, sf)
    size = _extent(px).select("image_id", "width", "height", F.lit(3).alias("band_count"), F.lit("uint8").alias("dtype"), F.lit("EPSG:4490").alias("crs"), F.array(*map(F.lit, (0.5, 0.0, 100.0, 0.0, -0.5, 40.0))).alias("transform"), F.lit("255").alias("nodata"), F.lit("orders.tif").alias("name"))
    return geotiff.written(geotiff.assembled(px, size, size=TILE_SIDE), size, shared.place(spark, "images"), TILE_SIDE)[0]


@register("geotiff_header", f"SELECT width, height, 3 AS band_count, 'uint8' AS dtype, 'EPSG:4490' AS crs, [0.5e0, 0e0, 100e0, 0e0, -0.5e0, 40e0] AS transform, '255' AS nodata FROM {_size}")
def _(spark, sf):
    return geotiff.scenes(spark, _as_file(spark, sf)).select("width", "height", "band_count", "dtype", "crs", "transform", "nodata")


@register("geotiff_scan", f"SELECT y, x, r, g, b FROM ({tables.PIXELS}) WHERE y >= {TILE_SIDE} AND x < {TILE_SIDE}")
def _(spark, sf):
    parts = geotiff.chunks(spark, _as_file(spark, sf), TILE_SIDE, rows=(TILE_SIDE, None), columns=(None, TILE_SIDE))
    return geotiff.pixels(parts).select("y", "x", *(F.col(c).cast("int").alias(c) for c in "rgb"))


@register("geotiff_windows", f"""SELECT CAST((row_off // 54) * ceil(width / 54e0) + col_off // 54 AS INTEGER) AS tile_id, row_off, col_off, CAST(least(64, width - col_off) AS INTEGER) AS tile_width, CAST(least(64, height - row_off) AS INTEGER) AS tile_height,
  CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b FROM ({tables.PIXELS}) p JOIN (
  SELECT width, height, CAST(unnest(range(0, height, 54)) AS INTEGER) AS row_off, col_off FROM (SELECT *, CAST(unnest(range(0, width, 54)) AS INTEGER) AS col_off FROM {_size})) w
  ON p.y >= row_off AND p.y < row_off + least(64, height - row_off) AND p.x >= col_off AND p.x < col_off + least(64, width - col_off)
  WHERE least(64, width - col_off) >= 0.3 * 64 AND least(64, height - row_off) >= 0.3 * 64 GROUP BY width, height, row_off, col_off""")
def _(spark, sf):
    return tiles.band_sums(geotiff.windows(spark, _as_file(spark, sf), 64, 0.15))


# Detections.

_names = "[" + ", ".join(f"'{c}'" for c in boxes.CLASSES) + "]"
_kept = f"(SELECT *, {_names}[cls + 1] AS class_name FROM ({tables.DETECTIONS}) WHERE confidence >= 0.25e0 AND cls IN (0, 1, 7, 8))"


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    return boxes.filtered(tables.detections(spark, sf), [0, 1, 7, 8, 99], 0.25)


register("class_filter", f"SELECT image_id, det_id, cls, confidence, class_name FROM {_kept}")(lambda spark, sf: _filtered(spark, sf).select("image_id", "det_id", "cls", "confidence", "class_name"))
register("det_shift", f"SELECT det_id, cx + col_off AS cx, cy + row_off AS cy FROM ({tables.DETECTIONS})")(lambda spark, sf: boxes.placed(tables.detections(spark, sf)).select("det_id", "cx", "cy"))


@register("obb_corners", f"SELECT det_id, {', '.join(f'{_r(f"{a}{k}", 6)} AS {a}{k}' for k in (1, 2, 3, 4) for a in 'xy')} FROM {q.corners(f'({tables.DETECTIONS})')}")
def _(spark, sf):
    cs = boxes.corner_columns()
    return tables.detections(spark, sf).select("det_id", *(F.round(c, 6).alias(f"{a}{k}") for k, p in enumerate(cs, 1) for a, c in zip("xy", p, strict=True)))


@register("obb_area", f"SELECT det_id, {_r('width * height', 6)} AS area FROM ({tables.DETECTIONS})")
def _(spark, sf):
    return boxes.with_corners(tables.detections(spark, sf)).select("det_id", F.round(boxes.area(F.col("corners")), 6).alias("area"))


register("class_counts", f"SELECT image_id, class_name, count(*) AS n, max(confidence) AS best FROM {_kept} GROUP BY image_id, class_name")(lambda spark, sf: boxes.class_counts(_filtered(spark, sf)))
register("detection_totals", f"SELECT image_id, count(*) AS total, count(*) FILTER (WHERE cls = 0) AS planes, count(*) FILTER (WHERE cls = 1) AS ships FROM {_kept} GROUP BY image_id")(lambda spark, sf: boxes.totals(_filtered(spark, sf)))

_boxed = q.corners(f"({tables.DETECTIONS})", "")
_bounded = f"(SELECT *, least(x1, x2, x3, x4) AS l, greatest(x1, x2, x3, x4) AS rr, least(y1, y2, y3, y4) AS t, greatest(y1, y2, y3, y4) AS bb FROM {_boxed})"
_pairs = f"""SELECT a.image_id, a.cls, a.det_id AS i, b.det_id AS j, [{{'x': a.x1, 'y': a.y1}}, {{'x': a.x2, 'y': a.y2}}, {{'x': a.x3, 'y': a.y3}}, {{'x': a.x4, 'y': a.y4}}] AS ci, [{{'x': b.x1, 'y': b.y1}}, {{'x': b.x2, 'y': b.y2}}, {{'x': b.x3, 'y': b.y3}}, {{'x': b.x4, 'y': b.y4}}] AS cj, a.width * a.height AS ai, b.width * b.height AS aj
  FROM d a JOIN d b ON a.image_id = b.image_id AND a.cls = b.cls AND (a.confidence > b.confidence OR (a.confidence = b.confidence AND a.det_id < b.det_id)) AND a.l <= b.rr AND b.l <= a.rr AND a.t <= b.bb AND b.t <= a.bb"""
_side = lambda c, k: f"({c}[{k % 4 + 1}].x - {c}[{k}].x) * (v.y - {c}[{k}].y) - ({c}[{k % 4 + 1}].y - {c}[{k}].y) * (v.x - {c}[{k}].x) >= 0"
_in = lambda c: " AND ".join(_side(c, k) for k in (1, 2, 3, 4))
_iou = f"""d AS MATERIALIZED (SELECT * FROM {_bounded}), pr AS MATERIALIZED ({_pairs}),
ed AS (SELECT i, j, ci[k] AS p, ci[k % 4 + 1] AS p2, cj[m] AS q, cj[m % 4 + 1] AS q2 FROM pr CROSS JOIN range(1, 5) r(k) CROSS JOIN range(1, 5) s(m)),
cr AS (SELECT i, j, p, p2, ((q.x - p.x) * (q2.y - q.y) - (q.y - p.y) * (q2.x - q.x)) / den AS t, ((q.x - p.x) * (p2.y - p.y) - (q.y - p.y) * (p2.x - p.x)) / den AS u
  FROM (SELECT *, (p2.x - p.x) * (q2.y - q.y) - (p2.y - p.y) * (q2.x - q.x) AS den FROM ed) WHERE abs(den) > 1e-10),
pts AS (SELECT i, j, v.x AS x, v.y AS y FROM (SELECT i, j, cj, unnest(ci) AS v FROM pr) WHERE {_in('cj')}
  UNION ALL SELECT i, j, v.x, v.y FROM (SELECT i, j, ci, unnest(cj) AS v FROM pr) WHERE {_in('ci')}
  UNION ALL SELECT i, j, p.x + t * (p2.x - p.x), p.y + t * (p2.y - p.y) FROM cr WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
an AS (SELECT *, atan2(y - avg(y) OVER w, x - avg(x) OVER w) AS a, count(*) OVER w AS n FROM pts WINDOW w AS (PARTITION BY i, j)),
ring AS (SELECT i, j, n, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM an WINDOW w AS (PARTITION BY i, j ORDER BY a, x, y)),
it AS (SELECT i, j, abs(sum(x * ny - y * nx)) / 2 AS inter FROM ring WHERE n >= 3 GROUP BY i, j),
iou AS (SELECT pr.image_id, pr.cls, pr.i, pr.j, coalesce(inter, 0) / (ai + aj - coalesce(inter, 0)) AS iou FROM pr LEFT JOIN it ON pr.i = it.i AND pr.j = it.j)"""


@register("obb_pairs", f"WITH d AS (SELECT * FROM {_bounded}) SELECT image_id, cls, i, j FROM ({_pairs})")
def _(spark, sf):
    return boxes.met(tables.detections(spark, sf))


@register("obb_iou", f"WITH {_iou} SELECT image_id, cls, i, j, {_r('iou', 6)} AS iou FROM iou")
def _(spark, sf):
    return boxes.met(tables.detections(spark, sf), iou=True, by_rings=True).select("image_id", "cls", "i", "j", (F.floor(F.col("iou") * 1e6 + 0.5) / 1e6).alias("iou"))


@register("nms_obb", f"""WITH RECURSIVE {_iou},
ranked AS MATERIALIZED (SELECT d.image_id, d.cls, d.det_id, row_number() OVER (PARTITION BY d.image_id, d.cls ORDER BY d.confidence DESC, d.det_id) AS k, coalesce(b.before, CAST([] AS BIGINT[])) AS before
  FROM d LEFT JOIN (SELECT j, list(i) AS before FROM iou WHERE iou > 0.5 GROUP BY j) b ON d.det_id = b.j),
fold AS (SELECT image_id, cls, k, [det_id] AS kept FROM ranked WHERE k = 1
  UNION ALL SELECT f.image_id, f.cls, r.k, CASE WHEN list_has_any(f.kept, r.before) THEN f.kept ELSE list_append(f.kept, r.det_id) END FROM fold f JOIN ranked r ON f.image_id = r.image_id AND f.cls = r.cls AND r.k = f.k + 1)
SELECT image_id, cls, unnest(kept) AS det_id FROM (SELECT image_id, cls, arg_max(kept, k) AS kept FROM fold GROUP BY image_id, cls)""")
def _(spark, sf):
    return boxes.nms(tables.detections(spark, sf), by_rings=True).select("image_id", "cls", "det_id")


_geo = (0.5, 0.0, 110.0, 0.0, -0.5, 40.0)
_half = lambda v, n: f"floor({v} * 1e{n} + 0.5e0) / 1e{n}"


@register("geojson_features", f"""SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, det_id) - 1 AS id, cls AS class_id, class_name, {_half('confidence', 4)} AS confidence,
  {_half('(110e0 + 0.5e0 * (cx + 0.5e0) + 0e0 * (cy + 0.5e0))', 6)} AS center_lon, {_half('(40e0 + 0e0 * (cx + 0.5e0) + -0.5e0 * (cy + 0.5e0))', 6)} AS center_lat, {_half('width', 2)} AS width_px, {_half('height', 2)} AS height_px,
  {_half('angle', 4)} AS angle_rad, {_half('degrees(angle)', 2)} AS angle_deg, 'a.tif' AS source_file, 5 AS points FROM {_kept}""")
def _(spark, sf):
    out = boxes.features(_filtered(spark, sf), _geo, "a.tif")
    return out.select("image_id", F.col("id").cast("long").alias("id"), "properties.*", F.size("ring").alias("points"))


_ring = "[" + ", ".join(f"({sx}e0, {sy}e0)" for sx, sy in ((-0.5, 0.5), (0.5, 0.5), (0.5, -0.5), (-0.5, -0.5), (-0.5, 0.5))) + "]"
_ring_x = "110e0 + 0.5e0 * (cx + width * k[1] * cos(angle) - height * k[2] * sin(angle) + 0.5e0)"
_ring_y = "40e0 + -0.5e0 * (cy + width * k[1] * sin(angle) + height * k[2] * cos(angle) + 0.5e0)"


@register("geojson_rings", f"""SELECT image_id, id, p, round({_ring_x}, 6) AS lon, round({_ring_y}, 6) AS lat
  FROM (SELECT *, unnest({_ring}) AS k, unnest(range(0, 5)) AS p FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, det_id) - 1 AS id FROM {_kept}))""")
def _(spark, sf):
    out = boxes.features(_filtered(spark, sf), _geo, "a.tif")
    return out.select("image_id", F.col("id").cast("long").alias("id"), F.posexplode("ring").alias("p", "at")).select("image_id", "id", F.col("p").cast("long").alias("p"), F.round(F.col("at")[0], 6).alias("lon"), F.round(F.col("at")[1], 6).alias("lat"))


# Mosaics.

_scene_px = f"(SELECT image_id, CAST(y AS INTEGER) AS y, CAST(unnest(range(0, width)) AS INTEGER) AS x FROM (SELECT image_id, width, unnest(range(0, height)) AS y FROM ({tables.SCENES})))"
_grid = f"(SELECT min(west) AS west, min(north - height * res) AS south, max(west + width * res) AS east, max(north) AS north, arg_min(res, priority) AS res FROM ({tables.SCENES}))"
_bounds = f"(SELECT *, CAST(round_even((east - west) / res, 0) AS INTEGER) AS width, CAST(round_even((north - south) / res, 0) AS INTEGER) AS height FROM {_grid})"
_offsets = f"(SELECT s.*, CAST(round_even((g.north - s.north) / g.res, 0) AS INTEGER) AS row_off, CAST(round_even((s.west - g.west) / g.res, 0) AS INTEGER) AS col_off, g.width AS grid_width, g.height AS grid_height FROM ({tables.SCENES}) s CROSS JOIN {_bounds} g)"
_value = "CAST((image_id * 13 + y * 7 + x * 3) % 256 AS INTEGER)"


def _scene_pixels(spark: SparkSession, sf: str) -> DataFrame:
    # A few bytes of a scene become a thousand pixels, so scenes are dealt before.
    s = tables.scenes(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id")
    rows = s.select("image_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    return rows.withColumn("v", ((F.col("image_id") * 13 + F.col("y") * 7 + F.col("x") * 3) % 256).cast("int"))


register("union_bounds", f"SELECT * FROM {_bounds}")(lambda spark, sf: mosaic.union_bounds(tables.scenes(spark, sf)))
register("mosaic_offsets", f"SELECT image_id, row_off, col_off FROM {_offsets}")(lambda spark, sf: mosaic.offsets(tables.scenes(spark, sf)).select("image_id", "row_off", "col_off"))
_overlay = f"(SELECT y + row_off AS y, x + col_off AS x, arg_max({_value}, priority * 1000000 + image_id) AS v FROM (SELECT p.image_id, p.y, p.x, row_off, col_off, priority, grid_width, grid_height FROM {_scene_px} p JOIN {_offsets} o ON p.image_id = o.image_id) WHERE y + row_off >= 0 AND x + col_off >= 0 AND y + row_off < grid_height AND x + col_off < grid_width GROUP BY y + row_off, x + col_off)"


@register("mosaic_overlay", f"SELECT y, x, v FROM {_overlay}")
def _(spark, sf):
    return mosaic.overlay(_scene_pixels(spark, sf), mosaic.offsets(tables.scenes(spark, sf)), ["v"])


@register("mosaic_filled", f"SELECT CAST(gy AS INTEGER) AS y, CAST(gx AS INTEGER) AS x, coalesce(v, 0) AS v FROM (SELECT gy, unnest(range(0, width)) AS gx FROM (SELECT width, unnest(range(0, height)) AS gy FROM {_bounds})) g LEFT JOIN {_overlay} o ON g.gy = o.y AND g.gx = o.x")
def _(spark, sf):
    return mosaic.mosaic(_scene_pixels(spark, sf), tables.scenes(spark, sf), ["v"], register=False)


@register("tight_bbox", f"SELECT min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM {_overlay}")
def _(spark, sf):
    return mosaic.tight_box(mosaic.overlay(_scene_pixels(spark, sf), mosaic.offsets(tables.scenes(spark, sf)), ["v"]))


@register("scene_overlaps", f"""SELECT a.image_id AS earlier, b.image_id AS later, greatest(a.row_off, b.row_off) AS y0, least(a.row_off + a.height, b.row_off + b.height) AS y1, greatest(a.col_off, b.col_off) AS x0, least(a.col_off + a.width, b.col_off + b.width) AS x1
  FROM {_offsets} a JOIN {_offsets} b ON (a.priority < b.priority OR (a.priority = b.priority AND a.image_id < b.image_id)) AND greatest(a.row_off, b.row_off) < least(a.row_off + a.height, b.row_off + b.height) AND greatest(a.col_off, b.col_off) < least(a.col_off + a.width, b.col_off + b.width)""")
def _(spark, sf):
    return mosaic.overlaps(mosaic.offsets(tables.scenes(spark, sf)))


@register("crs_check", f"SELECT count(*) FILTER (WHERE crs IS NULL) AS missing, count(DISTINCT crs) AS systems, count(DISTINCT res) AS resolutions FROM ({tables.SCENES})")
def _(spark, sf):
    s = tables.scenes(spark, sf)
    mosaic.check(s)
    return s.agg(F.count_if(F.col("crs").isNull()).alias("missing"), F.countDistinct("crs").alias("systems"), F.countDistinct("res").alias("resolutions"))


_shift = "SELECT event_id, ((event_id * 13) % 41) / 10e0 - 2e0 AS dr, ((event_id * 29) % 37) / 10e0 - 1.8e0 AS dc FROM events"


@register("shift_gate", f"SELECT event_id, CAST(CASE WHEN abs(dr) > 0.5 OR abs(dc) > 0.5 THEN round_even(dr, 0) ELSE 0 END AS INTEGER) AS d_row, CAST(CASE WHEN abs(dr) > 0.5 OR abs(dc) > 0.5 THEN round_even(dc, 0) ELSE 0 END AS INTEGER) AS d_col FROM ({_shift})")
def _(spark, sf):
    e = tables.table(spark, sf, "events").select("event_id", ((F.col("event_id") * 13 % 41) / 10.0 - 2.0).alias("dr"), ((F.col("event_id") * 29 % 37) / 10.0 - 1.8).alias("dc"))
    return e.select("event_id", mosaic.whole_shift(F.col("dr"), F.col("dc")).alias("d_row"), mosaic.whole_shift(F.col("dc"), F.col("dr")).alias("d_col"))


# Registration. Transforms are beyond SQL, but what they must find is known: by how much the pixels were moved.

MOVED = (-1, 2)


def _moved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int, int]:
    px = tables.pixels(spark, sf).select("y", "x", "r", "g", "b")
    height = px.agg(F.max("y") + 1).first()[0]
    return px, px.select((F.col("y") - MOVED[0]).alias("y"), (F.col("x") - MOVED[1]).alias("x"), "r", "g", "b").where(f"y < {height} and x >= 0"), height, 100


def _whole(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.rint("d_row").cast("int").alias("d_row"), F.rint("d_col").cast("int").alias("d_col"), (F.col("response") >= MIN_RESPONSE).alias("sure"))


@register("phase_shift", f"SELECT CAST({MOVED[0]} AS INTEGER) AS d_row, CAST({MOVED[1]} AS INTEGER) AS d_col, true AS sure")
def _(spark, sf):
    ref, src, h, w = _moved(spark, sf)
    side = lambda df, s: df.select(F.lit(0).alias("pair_id"), F.lit(s).alias("side"), F.col("y").alias("py"), F.col("x").alias("px"), F.lit(h).alias("height"), F.lit(w).alias("width"), "r", "g", "b")
    return _whole(registration.shifts(side(ref, "ref").unionByName(side(src, "src")), ["r", "g", "b"]))


_side = f"(SELECT h, greatest(least(64, h // 2, 50), 32) AS n FROM (SELECT {q.tall()} AS h))"


@register("block_shifts", f"""SELECT CAST(y + n // 2 AS INTEGER) AS y, CAST(x + n // 2 AS INTEGER) AS x, CAST({MOVED[0]} AS INTEGER) AS d_row, CAST({MOVED[1]} AS INTEGER) AS d_col, true AS sure
  FROM (SELECT h, n, unnest(range(0, CAST(h - n + 1 AS BIGINT), n // 2)) AS y FROM {_side} WHERE h >= n) CROSS JOIN (SELECT unnest(range(0, CAST(100 - n + 1 AS BIGINT), n // 2)) AS x FROM {_side})""")
def _(spark, sf):
    ref, src, h, w = _moved(spark, sf)
    return _whole(registration.block_shifts(ref, src, h, w, ["r", "g", "b"]), "y", "x")


@register("block_median", f"SELECT CAST(CASE WHEN h >= n THEN {MOVED[0]} ELSE 0 END AS INTEGER) AS d_row, CAST(CASE WHEN h >= n THEN {MOVED[1]} ELSE 0 END AS INTEGER) AS d_col, h >= n AS sure FROM {_side}")
def _(spark, sf):
    ref, src, h, w = _moved(spark, sf)
    return _whole(registration.median_shift(registration.block_shifts(ref, src, h, w, ["r", "g", "b"])))


#: The warp lands within this of the pixel it should be, as a shift is found to hundredths of a pixel.
NEAR = 24


@register("block_warp", f"""SELECT p.y, p.x, CASE WHEN h < n THEN abs(s.r - p.r) <= {NEAR} ELSE true END AS near
  FROM ({tables.PIXELS}) p JOIN ({tables.PIXELS}) s ON s.y = p.y + {MOVED[0]} AND s.x = p.x + {MOVED[1]} CROSS JOIN {_side} WHERE p.y BETWEEN 4 AND h - 5 AND p.x BETWEEN 4 AND 95""")
def _(spark, sf):
    ref, src, h, w = _moved(spark, sf)
    out = field.block_warp(ref, src, h, w, ["r", "g", "b"])[0].select("y", "x", F.col("r").alias("w"))
    inside = ref.where(F.col("y").between(4, h - 5) & F.col("x").between(4, w - 5))
    return inside.join(out, ["y", "x"]).select("y", "x", (F.abs(F.col("w") - F.col("r")) <= NEAR).alias("near"))


#: Two scenes of one ground: the second is laid 10 places off the first and shows what is SLIPPED places further.
GROUND, SCENE, SLIPPED = 170, 160, (3, -5)
_ground_px = f"(SELECT CAST(k // {GROUND} AS INTEGER) AS y, CAST(k % {GROUND} AS INTEGER) AS x, CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS INTEGER) AS v FROM range(0, {GROUND * GROUND}) g(k) JOIN orders ON o_orderkey = k % (SELECT count(*) FROM orders))"


@register("mosaic_registered", f"""SELECT y, x, CASE WHEN (y < {SCENE} AND x < {SCENE}) OR (y >= {10 + SLIPPED[0]} AND x BETWEEN {10 + SLIPPED[1]} AND {9 + SLIPPED[1] + SCENE}) THEN v ELSE 0 END AS v FROM {_ground_px}""")
def _(spark, sf):
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.pmod(F.floor("o_totalprice"), F.lit(256)).cast("int").alias("v"))
    n = o.count()
    at = lambda dy, dx, size: spark.range(size * size).select((F.col("id") / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x")).withColumn("k", F.pmod((F.col("y") + dy) * GROUND + F.col("x") + dx, F.lit(n)))
    first = at(0, 0, SCENE).withColumn("image_id", F.lit("a"))
    second = at(10 + SLIPPED[0], 10 + SLIPPED[1], SCENE).withColumn("image_id", F.lit("b"))
    px = first.unionByName(second).join(o, "k").select("image_id", "y", "x", "v")
    places = [("a", "a", 0, 0.0, float(GROUND)), ("b", "b", 1, 10.0, float(GROUND - 10))]
    scenes = spark.createDataFrame([(*p, 1.0, SCENE, SCENE, "EPSG:4490") for p in places], "image_id string, path string, priority int, west double, north double, res double, width int, height int, crs string")
    return mosaic.mosaic(px, scenes, ["v"])


# Fields.

_points = "(SELECT CAST((n_nationkey * 37) % 100 AS INTEGER) AS y, CAST((n_nationkey * 53) % 80 AS INTEGER) AS x, CAST(n_nationkey % 5 - 2 AS DOUBLE) AS dx, CAST(n_nationkey % 7 - 3 AS DOUBLE) AS dy FROM nation)"
_nodes = "(SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, i * 99 / 24e0 AS gy, j * 79 / 19e0 AS gx FROM range(0, 25) a(i) CROSS JOIN range(0, 20) b(j))"


def _idw(digits: int) -> str:
    pick = lambda v: f"round(CASE WHEN min(d2) < 0.25e0 THEN arg_min({v}, k) ELSE sum({v} / (d2 + 1e-10)) / sum(1e0 / (d2 + 1e-10)) END, {digits}) AS {v}"
    return f"(SELECT i, j, {pick('dx')}, {pick('dy')} FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY d2, y, x) AS k FROM (SELECT *, (y - gy) * (y - gy) + (x - gx) * (x - gx) AS d2 FROM {_nodes} CROSS JOIN {_points})) WHERE k <= 8 GROUP BY i, j)"


def _control(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return tables.table(spark, sf, "nation").select(((k * 37) % 100).cast("int").alias("y"), ((k * 53) % 80).cast("int").alias("x"), (k % 5 - 2).cast("double").alias("dx"), (k % 7 - 3).cast("double").alias("dy"))


register("idw_field", f"SELECT * FROM {_idw(6)}")(lambda spark, sf: _round(field.idw(_control(spark, sf), 100, 80), ("dx", "dy"), 6))


@register("idw_many", f"SELECT 1 AS image_id, * FROM {_idw(6)}")
def _(spark, sf):
    at = spark.range(25).select(F.lit(1).alias("image_id"), F.col("id").cast("int").alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("j")).withColumns({"gy": field.node_at(F.col("i"), 25, 100), "gx": field.node_at(F.col("j"), 20, 80)})
    return _round(field.interpolated(at, _control(spark, sf).withColumn("image_id", F.lit(1)), ("dx", "dy"), ("image_id",)), ("dx", "dy"), 6)


_coarse = "(SELECT CAST(i AS INTEGER) AS y, CAST(j AS INTEGER) AS x, CAST((i * 7 + j * 3) % 11 AS DOUBLE) AS v FROM range(0, 10) a(i) CROSS JOIN range(0, 8) b(j))"


@register("bilinear_resize", q.sampled("(SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, least(greatest((y + 0.5e0) * (10e0 / 40e0) - 0.5e0, 0e0), 9e0) AS sy, least(greatest((x + 0.5e0) * (8e0 / 32e0) - 0.5e0, 0e0), 7e0) AS sx FROM range(0, 40) a(y) CROSS JOIN range(0, 32) b(x))", _coarse, "10", "8", ("v",)))
def _(spark, sf):
    coarse = spark.range(10).select(F.col("id").cast("int").alias("i")).select("i", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")).withColumn("v", ((F.col("i") * 7 + F.col("j") * 3) % 11).cast("double"))
    return _round(field.resized(coarse, (10, 8), 40, 32, ("v",)), ("v",), 6)


_tall = q.tall()


def _height(spark: SparkSession, sf: str) -> int:
    return tables.pixels(spark, sf).agg(F.max("y") + 1).first()[0]


@register("translate_warp", q.sampled(f"(SELECT y, x, y - 1.25e0 AS sy, x - -2.5e0 AS sx FROM ({tables.PIXELS}))", f"({tables.PIXELS})", _tall, "100", ("r", "g")))
def _(spark, sf):
    return _round(field.translated(tables.pixels(spark, sf), 1.25, -2.5, _height(spark, sf), 100, ("r", "g")), "rg", 6)


@register("remap_bilinear", q.sampled(f"(SELECT y, x, y + -1e0 * ((y * 3 + x) % 5 / 4e0 - 0.5e0) AS sy, x + -1e0 * ((y + x * 2) % 7 / 4e0 - 0.75e0) AS sx FROM ({tables.PIXELS}))", f"({tables.PIXELS})", _tall, "100", ("r",)))
def _(spark, sf):
    px = tables.pixels(spark, sf)
    shift = px.select("y", "x", ((F.col("y") * 3 + F.col("x")) % 5 / 4.0 - 0.5).alias("dy"), ((F.col("y") + F.col("x") * 2) % 7 / 4.0 - 0.75).alias("dx"))
    return _round(field.remapped(px, shift, _height(spark, sf), 100, ("r",)), ("r",), 6)


def _cubic(t: str) -> str:
    t = f"abs({t})"
    return f"(CASE WHEN {t} <= 1 THEN (1.5e0 * {t} - 2.5e0) * {t} * {t} + 1e0 ELSE ((-0.5e0 * {t} + 2.5e0) * {t} - 4e0) * {t} + 2e0 END)"


_cubic_taps = f"""(SELECT y, x, CAST(least(greatest(floor(sy) + ky, 0), {_tall} - 1) AS INTEGER) AS ny, CAST(least(greatest(floor(sx) + kx, 0), 99) AS INTEGER) AS nx, {_cubic('sy - floor(sy) - ky')} * {_cubic('sx - floor(sx) - kx')} AS w
  FROM (SELECT y, x, y - 1.3e0 AS sy, x + 2.4e0 AS sx FROM ({tables.PIXELS})) CROSS JOIN range(-1, 3) a(ky) CROSS JOIN range(-1, 3) b(kx))"""


@register("resample_cubic", f"SELECT t.y, t.x, {_r('sum(t.w * p.r)', 6)} AS r FROM {_cubic_taps} t JOIN ({tables.PIXELS}) p ON p.y = t.ny AND p.x = t.nx GROUP BY t.y, t.x")
def _(spark, sf):
    px = tables.pixels(spark, sf)
    at = px.select("y", "x", (F.col("y") - 1.3).alias("sy"), (F.col("x") + 2.4).alias("sx"))
    return _round(field.sampled(at, px, _height(spark, sf), 100, ("r",), "cubic"), ("r",), 6)


# Ground.

_keys = [*rpc.SCALARS, *(f"{v}_{i}" for v in rpc.VECTORS for i in range(1, 21))]
_key_list = "[" + ", ".join(f"'{k}'" for k in _keys) + "]"


@register("rpc_parse", f"SELECT CAST(s_suppkey AS VARCHAR) AS image_id, k AS key, CAST((s_suppkey * 7 + n) % 100 / 8e0 AS DOUBLE) AS value FROM (SELECT s_suppkey, unnest({_key_list}) AS k, unnest(range(0, {len(_keys)})) AS n FROM supplier)")
def _(spark, sf):
    # A few bytes of a supplier become ninety lines, so suppliers are dealt before.
    own = tables.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("image_id"), "s_suppkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id")
    s = own.select("image_id", "s_suppkey", F.posexplode(F.array(*map(F.lit, _keys))).alias("n", "k"))
    value = ((F.col("s_suppkey") * 7 + F.col("n")) % 100 / 8).cast("string")
    line = F.when(F.col("n") % 2 == 0, F.concat(F.lit("  "), F.lower("k"), F.lit(" : "), value)).otherwise(F.concat(F.col("k"), F.lit("="), value, F.lit("  ")))
    noise = own.select("image_id", F.lit(-1).alias("n"), F.explode(F.array(F.lit("# LINE_OFF: 5"), F.lit(""), F.lit("; x"), F.lit("LINE_OFF: 77"))).alias("line"))
    model = rpc.checked(rpc.models(rpc.pairs(s.select("image_id", "n", line.alias("line")).unionByName(noise))))
    # Each vector is named once: named twenty times, it would be worked out twenty times.
    values = F.concat(F.array(*(F.col(k.lower()) for k in rpc.SCALARS)), *(F.col(v.lower()) for v in rpc.VECTORS))
    return model.select("image_id", F.explode(F.arrays_zip(F.array(*map(F.lit, _keys)).alias("key"), values.alias("value"))).alias("e")).select("image_id", "e.key", "e.value")


@register("rpc_vector", "SELECT s_suppkey, [s_suppkey / 4e0, 1.5e0, -2e0] AS v FROM supplier")
def _(spark, sf):
    s = tables.table(spark, sf, "supplier")
    return s.select("s_suppkey", rpc.vector(F.concat(F.lit("  "), (F.col("s_suppkey") / 4).cast("string"), F.lit("  1.5\t-2 "))).alias("v"))


_MODEL = {"height_off": 10.0, "height_scale": 500.0, "lat_off": 30.0, "lat_scale": 0.5, "long_off": 114.0, "long_scale": 0.5, "line_off": 60.0, "line_scale": 60.0, "samp_off": 50.0, "samp_scale": 50.0, "line_num_coeff": [0.01, 0.02, -1.0, 0.03] + [0.001 * i for i in range(16)], "line_den_coeff": [1.0, 0.001, 0.002, 0.0] + [0.0001] * 16, "samp_num_coeff": [0.0, 1.0, 0.02, 0.01] + [-0.001 * i for i in range(16)], "samp_den_coeff": [1.0, 0.0, 0.001, 0.002] + [0.0001] * 16}


def _model(spark: SparkSession, lines: int = 120) -> DataFrame:
    """The model of an image of so many lines."""
    model = _MODEL | {"line_off": lines / 2.0, "line_scale": lines / 2.0}
    kinds = ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'double'}" for k, v in model.items())
    return spark.createDataFrame([tuple(model.values())], kinds)


def _polynomial(name: str) -> str:
    return "(" + " + ".join(f"{q.num(c)} * {t}" for c, t in zip(_MODEL[name], q.terms("p", "l", "h"), strict=True)) + ")"


def _image_point(source: str, keep: str, lines: str = "120e0") -> str:
    m = {k: q.num(v) for k, v in _MODEL.items() if not isinstance(v, list)} | {"line_off": f"({lines} / 2e0)", "line_scale": f"({lines} / 2e0)"}
    at = f"(SELECT *, (lat - {m['lat_off']}) / {m['lat_scale']} AS p, (lon - {m['long_off']}) / {m['long_scale']} AS l, (hh - {m['height_off']}) / {m['height_scale']} AS h FROM {source})"
    return f"(SELECT {keep}, {_polynomial('line_num_coeff')} / {_polynomial('line_den_coeff')} * {m['line_scale']} + {m['line_off']} AS sy, {_polynomial('samp_num_coeff')} / {_polynomial('samp_den_coeff')} * {m['samp_scale']} + {m['samp_off']} AS sx FROM {at})"


_lonlat = "(SELECT p_partkey, 113.5e0 + (p_partkey % 100) / 100e0 AS lon, 29.5e0 + (p_partkey % 73) / 73e0 AS lat, CAST(p_size AS DOUBLE) AS hh FROM part)"


@register("rpc_eval", f"SELECT p_partkey, {_r('sy', 6)} AS line, {_r('sx', 6)} AS samp FROM {_image_point(_lonlat, 'p_partkey')}")
def _(spark, sf):
    k = F.col("p_partkey")
    p = tables.table(spark, sf, "part").select(k, (113.5 + (k % 100) / 100).alias("lon"), (29.5 + (k % 73) / 73).alias("lat"), F.col("p_size").cast("double").alias("h"))
    m = _model(spark)
    at = p.crossJoin(F.broadcast(m.select(F.struct(*m.columns).alias("rpc"))))  # one row
    line, samp = geodesy.image_point(*_cols(("rpc", "lon", "lat", "h")))
    return at.select("p_partkey", F.round(line, 6).alias("line"), F.round(samp, 6).alias("samp"))


_lons = "(SELECT p_partkey, 70e0 + (p_partkey % 141) / 2e0 AS lon, 20e0 + (p_partkey % 31) AS lat FROM part)"
_zoned = f"(SELECT *, CAST(greatest(25, least(45, round_even((lon - 1.5e0) / 3, 0))) AS INTEGER) AS zone FROM {_lons})"


def _lon(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return tables.table(spark, sf, "part").select(k, (70 + (k % 141) / 2).alias("lon"), (20 + k % 31).cast("double").alias("lat"))


register("gk_zone", f"SELECT p_partkey, lon, zone, zone + 4519 AS epsg FROM {_zoned}")(lambda spark, sf: _lon(spark, sf).select("p_partkey", "lon", geodesy.zone(F.col("lon")).alias("zone"), geodesy.gk_epsg(F.col("lon")).alias("epsg")))
_projected = q.gk_forward("lon", "lat", "(lon0)").format(source="(SELECT *, round_even(lon / 3e0, 0) * 3e0 AS lon0 FROM " + _lons + ")")


def _forward(spark: SparkSession, sf: str) -> DataFrame:
    at = _lon(spark, sf).withColumn("lon0", F.rint(F.col("lon") / 3) * 3)
    e, n = geodesy.gk_forward(*_cols(("lon", "lat", "lon0")))
    return at.withColumns({"east": e, "north": n})


register("gk_forward", f"SELECT p_partkey, {_r('east', 4)} AS east, {_r('north', 4)} AS north FROM ({_projected})")(lambda spark, sf: _round(_forward(spark, sf).select("p_partkey", "east", "north"), ("east", "north"), 4))


@register("gk_inverse", f"SELECT p_partkey, {_r('lon', 7)} AS lon, {_r('lat', 7)} AS lat FROM {_lons}")
def _(spark, sf):
    lon, lat = geodesy.gk_inverse(*_cols(("east", "north", "lon0")))
    return _forward(spark, sf).select("p_partkey", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


#: The ground under the whole image: a row of the grid for each line, 1.1 degrees in all.
_ground = _image_point(f"(SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, 114e0 - 50e0 * res + (x + 0.5e0) * res AS lon, 30.55e0 - (y + 0.5e0) * res AS lat, 10e0 AS hh FROM (SELECT 1.1e0 / {_tall} AS res, unnest(range(0, CAST({_tall} AS BIGINT))) AS y) a CROSS JOIN range(0, 100) b(x))", "y, x", _tall)
_inside = f"(SELECT * FROM {_ground} WHERE sy >= 0 AND sx >= 0 AND sy <= {_tall} - 1 AND sx <= 99)"


def _rectified(spark: SparkSession, sf: str, how: str) -> DataFrame:
    h = _height(spark, sf)
    res = 1.1 / h
    at = ortho.looked_up(ortho.ground_grid(spark, 114.0 - 50.0 * res, 30.55, res, h, 100), _model(spark, h), 10.0)
    return ortho.rectified(tables.pixels(spark, sf), at, h, 100, ("r",), how)


@register("ortho_nearest", f"SELECT g.y, g.x, coalesce(p.r, 0) AS r FROM {_ground} g LEFT JOIN (SELECT i.y, i.x, s.r FROM {_inside} i JOIN ({tables.PIXELS}) s ON s.y = CAST(round_even(i.sy, 0) AS INTEGER) AND s.x = CAST(round_even(i.sx, 0) AS INTEGER)) p ON g.y = p.y AND g.x = p.x")
def _(spark, sf):
    return _rectified(spark, sf, "nearest")


@register("ortho_bilinear", f"SELECT g.y, g.x, coalesce(p.r, 0) AS r FROM {_ground} g LEFT JOIN ({q.sampled(_inside, f'({tables.PIXELS})', _tall, '100', ('r',))}) p ON g.y = p.y AND g.x = p.x")
def _(spark, sf):
    return _round(_rectified(spark, sf, "bilinear"), ("r",), 6)


# Files.

_uploads = "(SELECT s_suppkey, '/in/a' || s_suppkey || CASE s_suppkey % 5 WHEN 0 THEN '.tif' WHEN 1 THEN '.TIFF' WHEN 2 THEN '.png' WHEN 3 THEN '' ELSE '.rpc' END AS path, s_suppkey * 10000000 AS length FROM supplier)"


@register("upload_validation", f"SELECT s_suppkey, CASE WHEN NOT contains(path, '.') OR NOT regexp_matches(lower(path), '\\.tiff?$') THEN 'unsupported' WHEN length > 536870912 THEN 'too large' ELSE 'ok' END AS verdict FROM {_uploads}")
def _(spark, sf):
    k = F.col("s_suppkey")
    ext = F.element_at(F.array(*map(F.lit, (".tif", ".TIFF", ".png", "", ".rpc"))), (k % 5 + 1).cast("int"))
    s = tables.table(spark, sf, "supplier").select(k, F.concat(F.lit("/in/a"), k.cast("string"), ext).alias("path"), (k * 10_000_000).alias("length"))
    return s.select("s_suppkey", files.verdict(F.col("path"), F.col("length")).alias("verdict"))


@register("output_names", f"SELECT image_id, 'scene' || image_id || '_Enhance.tiff' AS enhance, 'scene' || image_id || '_Ortho.tiff' AS ortho FROM ({tables.SCENES})")
def _(spark, sf):
    return tables.scenes(spark, sf).select("image_id", files.output_name(F.col("path"), "enhance").alias("enhance"), files.output_name(F.col("path"), "ortho").alias("ortho"))


@register("mosaic_name", f"SELECT string_agg('scene' || image_id, '_' ORDER BY priority, image_id) || '_Mosaic.tiff' AS name FROM ({tables.SCENES})")
def _(spark, sf):
    return files.mosaic_name(tables.scenes(spark, sf))
