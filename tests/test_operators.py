"""Operators on small inputs with known answers."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import errors
from gridloom.functions import geodesy, tone
from gridloom.operators import boxes, detect, field, mosaic, ortho, registration, tiles, tone as tones
from gridloom.params import Detect, Enhance, EnhanceRegions, Ortho, parse_classes
from gridloom.sources import files, geojson, geotiff, rpc, tiff
from gridloom.streaming import drop


def image(spark, values, dtype="int"):
    rows = [("a", y, x, *map(int if dtype == "int" else float, v)) for y, r in enumerate(values) for x, v in enumerate(r)]
    return spark.createDataFrame(rows, f"image_id string, y int, x int, r {dtype}, g {dtype}, b {dtype}")


def ramp(spark):
    return image(spark, [[(16 * y + x,) * 3 for x in range(16)] for y in range(16)])


def test_neutral_is_identity(spark):
    df = ramp(spark)
    assert sorted(map(tuple, tones.enhance(df).collect())) == sorted(map(tuple, df.collect()))


def test_dark_and_grey(spark):
    df = image(spark, [[(10, 200, 90), (255, 0, 3)]])
    assert {tuple(r)[3:] for r in tones.enhance(df, Enhance(brightness=0)).collect()} == {(0, 0, 0)}
    assert all(r.r == r.g == r.b for r in tones.enhance(df, Enhance(saturation=0)).collect())


def test_sixteen_bits_and_flat(spark):
    df = image(spark, [[(0, 65535, 300)]])
    assert tuple(tones.enhance(df, dtype="uint16").first())[3:] == (0, 65535, 300)
    flat = image(spark, [[(7, 7, 7)] * 2] * 2, "double")
    assert {r.r for r in tones.normalised(flat, "float32").collect()} == {0.0}
    wide = image(spark, [[(-5, 0, 5)]], "double")
    assert tuple(tones.enhance(wide, dtype="float32", rescale=True).first())[3:] == (-5.0, 0.0, 5.0)


def test_three_bands_needed(spark):
    with pytest.raises(errors.EnhancementFailed):
        tones.enhance(ramp(spark).drop("g"))


def test_params():
    for bad in (lambda: Enhance(brightness=3.1), lambda: Enhance(contrast=float("nan")), lambda: EnhanceRegions(brightness=-2), lambda: Detect(confidence=0), lambda: Ortho(resolution=0), lambda: Ortho(height=-1), lambda: parse_classes("1,x")):
        with pytest.raises(errors.ProcessingError):
            bad()
    assert parse_classes(" 1, ,7,") == [1, 7]
    assert errors.envelope(errors.MosaicFailed("x")) == {"code": 400, "message": "x"} and errors.envelope(KeyError())["code"] == 500


def test_hsv_of_primaries(spark):
    df = image(spark, [[(255, 0, 0), (0, 255, 0), (0, 0, 255), (77, 77, 77)]])
    h, s, v = tone.to_hsv(*(F.col(c) / 255 for c in "rgb"))
    rows = [tuple(round(255 * z) for z in r) for r in df.orderBy("x").select(h, s, v).collect()]
    assert rows == [(0, 255, 255), (60, 255, 255), (120, 255, 255), (0, 0, 77)]
    same = tones.tone_v1(tones.normalised(df), 0, 0, 0).orderBy("x").select("r", "g", "b").collect()
    assert [tuple(round(255 * z) for z in r) for r in same] == [(255, 0, 0), (0, 255, 0), (0, 0, 255), (77, 77, 77)]


def test_water_mask_is_soft(spark):
    px = [[(100, 100, 100)] * 6 for _ in range(6)]
    for y in range(2, 4):
        for x in range(2, 4):
            px[y][x] = (90, 92, 110)
    got = {(r.y, r.x): r.water for r in tones.masks(tones.normalised(image(spark, px))).collect()}
    assert got[2, 2] == pytest.approx(9 / 16) and got[1, 2] == pytest.approx(3 / 16) and got[0, 0] == 0


def test_blur_matches_convolution(spark):
    a = np.random.default_rng(1).random((7, 9))
    df = spark.createDataFrame([("a", y, x, float(a[y, x])) for y in range(7) for x in range(9)], "image_id string, y int, x int, v double")
    p = np.pad(a, 1, mode="reflect")
    k = np.outer([1, 2, 1], [1, 2, 1]) / 16
    for r in tones.blurred(df.withColumn("w", F.col("v") * 2), "v", "w").collect():
        assert r.v == pytest.approx((p[r.y : r.y + 3, r.x : r.x + 3] * k).sum()) and r.w == pytest.approx(2 * r.v)


def test_otsu_of_two_spikes(spark):
    df = image(spark, [[(100, 20, 100)] * 5 + [(20, 200, 20)] * 5], "double").withColumns({c: F.col(c) / 255 for c in "rgb"})
    low = (2 * 20 - 200) / (2 * 20 + 200)
    assert tones.otsu(df).first().bin == int((low + 1) / 2 * 255)


@pytest.mark.parametrize(("w", "h", "n"), [(640, 640, 1), (1000, 1000, 4), (4000, 4000, 64), (150, 5000, 0), (700, 640, 1)])
def test_window_counts(spark, w, h, n):
    s = spark.createDataFrame([("a", w, h)], "image_id string, width int, height int")
    assert tiles.windows(s).count() == n
    assert tiles.windows(s, cover_edges=True).count() >= n


def test_reflection(spark):
    got = [r.src for r in tiles.pad_index(spark.createDataFrame([("a", 4)], "image_id string, n int"), 12).orderBy("i").collect()]
    assert got == list(np.pad(np.arange(4), (0, 8), mode="reflect"))
    one = [r.src for r in tiles.pad_index(spark.createDataFrame([("a", 1)], "image_id string, n int"), 3).collect()]
    assert one == [0, 0, 0]
    a = np.arange(3 * 2 * 3, dtype=np.uint8).reshape(3, 2, 3)
    df = spark.createDataFrame([("a", 3, 2, bytearray(a.tobytes()))], "image_id string, tile_width int, tile_height int, data binary")
    out = np.frombuffer(tiles.padded(df, 7).first().data, np.uint8).reshape(3, 7, 7)
    assert (out == np.pad(a, ((0, 0), (0, 5), (0, 4)), mode="reflect")).all()


def test_crop_too_small(spark):
    with pytest.raises(errors.InvalidImage):
        tiles.check_crop(spark.createDataFrame([("a", 5, 9)], "image_id string, width int, height int"), 6)


def dets(spark, rows):
    return spark.createDataFrame([(r[0], k, *r[1:]) for k, r in enumerate(rows)], "image_id int, det_id long, cls int, confidence double, cx double, cy double, width double, height double, angle double")


@pytest.mark.parametrize(
    ("b", "iou"),
    [((0, 0, 2, 2, 0), 1.0), ((9, 0, 2, 2, 0), 0.0), ((0, 0, 1, 1, 0), 0.25), ((1, 0, 2, 2, 0), 1 / 3), ((0, 0, 2, 2, math.pi / 4), (8 * (math.sqrt(2) - 1)) / (8 - 8 * (math.sqrt(2) - 1)))],
)
def test_iou(spark, b, iou):
    df = dets(spark, [(1, 0, 0.9, 0.0, 0.0, 2.0, 2.0, 0.0), (1, 0, 0.8, *map(float, b))])
    got = boxes.with_iou(boxes.pairs(df)).collect()
    assert (got[0].iou if got else 0.0) == pytest.approx(iou, abs=1e-9)


def test_suppression(spark):
    chain = [(1, 0, 0.9, 0.0, 0.0, 10.0, 10.0, 0.0), (1, 0, 0.8, 3.0, 0.0, 10.0, 10.0, 0.0), (1, 0, 0.7, 6.0, 0.0, 10.0, 10.0, 0.0)]
    other = [(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0, 0.0), (2, 0, 0.1, 0.0, 0.0, 10.0, 10.0, 0.0)]
    tie = [(3, 0, 0.5, 0.0, 0.0, 4.0, 4.0, 0.0), (3, 0, 0.5, 0.0, 0.0, 4.0, 4.0, 0.0)]
    df = dets(spark, chain + other + tie)
    kept = {r.det_id for r in boxes.nms(df).collect()}
    assert kept == {0, 2, 3, 4, 5}
    assert {r.det_id for r in boxes.nms(df.where(F.col("det_id").isin(list(kept)))).collect()} == kept
    assert boxes.nms(df.limit(0)).count() == 0


def test_unknown_classes_want_none(spark):
    df = dets(spark, [(1, 0, 0.9, 0.0, 0.0, 1.0, 1.0, 0.0)])
    assert boxes.filtered(df, [99], 0.1).count() == 0 and boxes.filtered(df, None, 0.1).count() == 1
    assert boxes.classes(spark).count() == 15


def test_geojson(spark, tmp_path):
    df = boxes.filtered(dets(spark, [(1, 0, 0.5, 10.0, 10.0, 4.0, 2.0, 0.0), (1, 1, 0.9, 20.0, 10.0, 4.0, 2.0, 0.1)]), None, 0.1)
    scene = spark.createDataFrame([(1, 100, 50)], "image_id int, width int, height int")
    out = geojson.collections(boxes.features(df, (1, 0, 0, 0, -1, 50), "a.tif"), boxes.class_counts(df), scene, 1.26)
    doc = json.loads(out.first().geojson)
    assert doc["metadata"] == {"total_detections": 2, "class_counts": {"ship": 1, "plane": 1}, "elapsed_seconds": 1.3, "image_width": 100, "image_height": 50}
    assert list(doc["metadata"]["class_counts"]) == ["ship", "plane"]
    ring = doc["features"][1]["geometry"]["coordinates"][0]
    assert len(ring) == 5 and ring[0] == ring[-1]
    turn = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:], strict=False))
    assert turn > 0 and doc["features"][0]["properties"]["class_name"] == "ship"
    path = geojson.write(out, str(tmp_path / "out"))[0]
    text = open(path, encoding="utf-8").read()
    assert path.endswith(".geojson") and json.loads(text) == doc and text.startswith('{\n  "type"')


def test_detect(spark):
    data = bytearray(np.zeros((3, 8, 8), np.uint8).tobytes())
    wins = spark.createDataFrame([("a", 0, 0, 0, 8, 8, data), ("a", 1, 0, 8, 8, 8, data)], "image_id string, tile_id int, row_off int, col_off int, tile_width int, tile_height int, data binary")

    def factory(confidence, iou):
        return lambda batch: [[(0, 4.0, 4.0, 3.0, 3.0, 0.0, 0.9), (0, 4.0, 4.0, 3.0, 3.0, 0.8), (5, 1.0, 1.0, 1.0, 1.0, 0.0, 0.9)] for _ in batch]

    got = detect.detect(wins, factory, Detect(tile=8)).collect()
    assert sorted((r.cx, r.class_name) for r in got) == [(4.0, "plane"), (12.0, "plane")]
    assert detect.parsed([1, 2, 3, 4, 0.5]) == (1, 2, 3, 4, 0.0, 0.5)


def test_phase_correlation():
    a = np.random.default_rng(3).random((200, 200))
    ref, src = a[20:180, 20:180], a[23:183, 15:175]
    assert registration.correlate(ref, src)[:2] == pytest.approx((3, -5), abs=0.3)
    assert registration.correlate(np.zeros((40, 40)), np.zeros((40, 40))) == (0.0, 0.0, 0.0)


def scene(spark, rows):
    return spark.createDataFrame(rows, "image_id int, path string, priority int, west double, north double, res double, width int, height int, crs string")


def test_mosaic_of_one_and_two(spark):
    one = scene(spark, [(1, "/a.tif", 0, 0.0, 10.0, 1.0, 3, 2, "EPSG:4490")])
    px = spark.createDataFrame([(1, y, x, 10 * y + x + 1) for y in range(2) for x in range(3)], "image_id int, y int, x int, v int")
    assert sorted((r.y, r.x, r.v) for r in mosaic.mosaic(px, one, ["v"]).collect()) == sorted((y, x, 10 * y + x + 1) for y in range(2) for x in range(3))
    two = one.unionByName(scene(spark, [(2, "/b.tif", 1, 2.0, 10.0, 1.0, 2, 3, "EPSG:4490")]))
    both = px.unionByName(spark.createDataFrame([(2, y, x, 0) for y in range(3) for x in range(2)], "image_id int, y int, x int, v int"))
    got = {(r.y, r.x): r.v for r in mosaic.mosaic(both, two, ["v"]).collect()}
    assert len(got) == 12 and got[0, 2] == 0 and got[0, 1] == 2 and got[2, 0] == 0


def test_mosaic_registers(spark):
    a = np.random.default_rng(5).integers(0, 255, (160, 300))
    first = [(1, y, x, int(a[y, x])) for y in range(160) for x in range(160)]
    second = [(2, y, x, int(a[y, x + 23])) for y in range(160) for x in range(160)]  # stated to start at 20, in truth at 23
    px = spark.createDataFrame(first + second, "image_id int, y int, x int, v int")
    s = scene(spark, [(1, "/a.tif", 0, 0.0, 160.0, 1.0, 160, 160, "EPSG:4490"), (2, "/b.tif", 1, 20.0, 160.0, 1.0, 160, 160, "EPSG:4490")])
    got = {(r.y, r.x): r.v for r in mosaic.mosaic(px, s, ["v"]).where("y = 80").collect()}
    assert all(got[80, x] == a[80, x] for x in range(24, 178))


def test_mosaic_checks(spark):
    with pytest.raises(errors.MosaicFailed, match="b.tif"):
        mosaic.check(scene(spark, [(1, "/a.tif", 0, 0.0, 1.0, 1.0, 1, 1, "EPSG:4490"), (2, "/b.tif", 1, 0.0, 1.0, 1.0, 1, 1, None)]))
    with pytest.raises(errors.MosaicFailed, match="b.tif"):
        mosaic.check(scene(spark, [(1, "/a.tif", 0, 0.0, 1.0, 1.0, 1, 1, "EPSG:4490"), (2, "/b.tif", 1, 0.0, 1.0, 2.0, 1, 1, "EPSG:4490")]))


@pytest.mark.parametrize("n", [0, 1, 2, 4, 8, 9, 40])
def test_idw_any_number_of_points(spark, n):
    pts = spark.createDataFrame([((k * 7) % 30, (k * 11) % 30, 2.5, -1.0) for k in range(n)], "y int, x int, dx double, dy double")
    got = field.idw(pts, 32, 32).collect()
    want = (2.5, -1.0) if n else (0.0, 0.0)
    assert len(got) == 64 and all((r.dx, r.dy) == pytest.approx(want) for r in got)


def test_idw_against_brute_force(spark):
    r = np.random.default_rng(3)
    pts = [("a", float(y), float(x), float(k)) for k, (y, x) in enumerate(r.random((70, 2)) * (20, 300))] + [("b", 5.0, 6.0, 1.0), ("b", 200.0, 100.0, 3.0)]
    pts += [("d", float(y), float(x), float(k)) for k, (y, x) in enumerate([*(r.random((40, 2)) * 2), *(r.random((4, 2)) * 900)])]
    nodes = [(m, i, j, 40.0 * i, 37.5 * j) for m in "abcd" for i in range(7) for j in range(9)]
    at = spark.createDataFrame(nodes, "image_id string, i int, j int, gy double, gx double")
    got = {(g.image_id, g.i, g.j): g.v for g in field.interpolated(at, spark.createDataFrame(pts, "image_id string, y double, x double, v double"), ("v",), ("image_id",)).collect()}
    assert len(got) == len(nodes)
    for m, i, j, gy, gx in nodes:
        near = sorted(((y - gy) ** 2 + (x - gx) ** 2, y, x, v) for k, y, x, v in pts if k == m)[:8]
        w = [1 / (d[0] + 1e-10) for d in near]
        want = 0.0 if not near else near[0][3] if near[0][0] < 0.25 else sum(a * d[3] for a, d in zip(w, near, strict=True)) / sum(w)
        assert got[m, i, j] == pytest.approx(want)


def test_rpc(spark, tmp_path):
    keys = [*rpc.SCALARS, *(f"{v}_{i}" for v in rpc.VECTORS for i in range(1, 21))]
    lines = ["# model", "", *(f"{k}: {n}" if n % 2 else f"{k.lower()} = {n}.5" for n, k in enumerate(keys))]
    (tmp_path / "m.rpc").write_text("\n".join(lines))
    got = rpc.read(spark, [str(tmp_path / "m.rpc")]).first()
    assert got.height_off == 0.5 and got.samp_den_coeff[19] == len(keys) - 1
    (tmp_path / "n.rpc").write_text("\n".join(lines[:-1]))
    with pytest.raises(errors.OrthoFailed, match="SAMP_DEN_COEFF"):
        rpc.read(spark, [str(tmp_path / "n.rpc")])
    tags = {k: "1" for k in rpc.SCALARS} | {k: " ".join(["2"] * 20) for k in rpc.VECTORS}
    assert rpc.from_tags(spark.createDataFrame([("a", tags)], "image_id string, tags map<string, string>")).first().line_num_coeff == [2.0] * 20


@pytest.mark.parametrize(("lon", "zone"), [(74, 25), (75, 25), (76.5, 25), (113, 37), (114, 38), (116, 38), (117, 38), (136, 45)])
def test_zones(spark, lon, zone):
    want = max(25, min(45, round((lon - 1.5) / 3)))
    assert spark.range(1).select(geodesy.zone(F.lit(float(lon)))).first()[0] == want == zone
    assert ortho.resolved_crs("AUTO", lon) == f"EPSG:{4519 + zone}"


def test_ortho(spark):
    scale = {"height_off": 0.0, "height_scale": 1.0, "lat_off": 30.0, "lat_scale": 1.0, "long_off": 114.0, "long_scale": 1.0, "line_off": 10.0, "line_scale": 100.0, "samp_off": 10.0, "samp_scale": 100.0}
    one, lon, lat = ([1.0] + [0.0] * 19, [0.0, 1.0] + [0.0] * 18, [0.0, 0.0, -1.0] + [0.0] * 17)
    model = scale | {"line_num_coeff": lat, "line_den_coeff": one, "samp_num_coeff": lon, "samp_den_coeff": one}
    m = spark.createDataFrame([tuple(model.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'double'}" for k, v in model.items()))
    img = spark.createDataFrame([(y, x, float(100 * y + x)) for y in range(20) for x in range(20)], "y int, x int, v double")
    out, info = ortho.orthorectify(img, m, 20, 20, ("v",), Ortho(dst_crs="EPSG:4490", resolution=0.01))
    got = {(r.y, r.x): r.v for r in out.collect()}
    assert (info["height"], info["width"]) == (20, 20) and got[5, 5] == pytest.approx(100 * 5.5 + 5.5) and got[19, 19] == 0
    metric, info = ortho.orthorectify(img, m, 20, 20, ("v",), Ortho(resampling="nearest"))
    assert info["crs"] == "EPSG:4557" and metric.where("v > 0").count() > 100
    dem = spark.createDataFrame([(math.floor(113.95 / 1), 29, 0.0, 1.0)], "lon_cell bigint, lat_cell bigint, h double, res double")
    assert ortho.looked_up(ortho.ground_grid(spark, 113.9, 30.1, 0.01, 4, 4), m, 0.0, dem).count() == 16
    with pytest.raises(errors.OrthoFailed):
        ortho.resolved_crs("nowhere", 1.0)


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "float32"])
def test_geotiff_round_trip(spark, tmp_path, dtype):
    a = (np.random.default_rng(2).random((4, 70, 90)) * 200).astype(dtype)
    (tmp_path / "a.tif").write_bytes(tiff.encode(a, (0.5, 0.0, 100.0, 0.0, -0.5, 40.0), "EPSG:4490"))
    info = geotiff.scenes(spark, str(tmp_path / "a.tif"))
    r = info.first()
    assert (r.width, r.height, r.band_count, r.dtype, r.crs, r.transform) == (90, 70, 4, dtype, "EPSG:4490", [0.5, 0.0, 100.0, 0.0, -0.5, 40.0])
    parts = geotiff.chunks(spark, str(tmp_path / "a.tif"), 32)
    assert parts.count() == 9 and geotiff.chunks(spark, str(tmp_path / "a.tif"), 64, [2]).first().bands == 1
    px = geotiff.pixels(parts).where("y = 65 and x = 88").first()
    assert (px.r, px.extra[0]) == (float(a[0, 65, 88]), float(a[3, 65, 88]))
    out = geotiff.written(parts, info, str(tmp_path / "out"), 32)
    assert (tiff.Tiff(open(out[0], "rb").read()).read(0, 0, 70, 90) == a).all()


def test_lzw():
    r = np.random.default_rng(1)
    for data in (b"", b"a", b"ab" * 9000, r.integers(0, 256, 40000, dtype=np.uint8).tobytes()):
        assert tiff.unlzw(tiff.lzw(data)) == data
    with pytest.raises(errors.InvalidImage):
        tiff.Tiff(b"no image")


def test_png():
    img = geojson.overlay(np.zeros((5, 6, 3), np.uint8), [[(1, 1), (4, 1), (4, 3), (1, 3)]])
    assert img[1, 2].tolist() == [255, 64, 0] and img[2, 2].tolist() == [0, 0, 0]
    assert geojson.png(img)[:8] == b"\x89PNG\r\n\x1a\n"


def test_files(spark):
    bad = spark.createDataFrame([("/x/a.tif", 5), ("/x/b.png", 5)], "path string, length long")
    with pytest.raises(errors.UnsupportedFormat, match="b.png"):
        files.checked(bad)
    with pytest.raises(errors.FileTooLarge):
        files.checked(spark.createDataFrame([("/x/a.TIF", 1 << 30)], "path string, length long"))
    assert [r.priority for r in files.listed(spark, ["b", "a"]).orderBy("priority").collect()] == [0, 1]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}.tif").write_bytes(tiff.encode(np.full((3, 4, 4), k, np.uint8), (1, 0, 0, 0, -1, 0), None))
    q = drop.process(drop.arrivals(spark, str(src), 2), lambda b: b.select("path", "length"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


@pytest.mark.parametrize(("few", "block"), [(256, 64), (0, 3)])
def test_nearest_points_by_cells_and_blocks(spark, monkeypatch, few, block):
    monkeypatch.setattr(field, "FEW", few)
    monkeypatch.setattr(field, "BLOCK", block)
    r = np.random.default_rng(8)
    pts = np.concatenate([r.random((30, 2)) * 5 + 40, r.random((10, 2)) * 90])  # most of them in a corner of one cell
    v = r.random(40)
    df = spark.createDataFrame([(float(y), float(x), float(z)) for (y, x), z in zip(pts, v, strict=True)], "y double, x double, dx double")
    for t in field.idw(df, 90, 90, ("dx",), (9, 9)).collect():
        d2 = (t.i * 89 / 8 - pts[:, 0]) ** 2 + (t.j * 89 / 8 - pts[:, 1]) ** 2
        k = np.argsort(d2)[:8]
        w = 1 / (d2[k] + 1e-10)
        assert t.dx == pytest.approx(v[k[0]] if d2[k[0]] < 0.25 else (w * v[k]).sum() / w.sum(), abs=1e-9)


def test_nodes_of_a_long_image(spark):
    points = spark.createDataFrame([(0, 0, 1.0), (599_999, 7, 3.0)], "y int, x int, dx double")
    got = {(r.i, r.j): r.dx for r in field.idw(points, 600_000, 8, ("dx",), nodes=(5000, 2)).where("i in (0, 4999)").collect()}
    assert got == pytest.approx({(0, 0): 1.0, (0, 1): 1.0, (4999, 0): 3.0, (4999, 1): 3.0}, abs=1e-6)
