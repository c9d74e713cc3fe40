"""Operations on files, from file to file."""

import json

import numpy as np
import pytest

from gridloom import api, errors
from gridloom.operators import field
from gridloom.sources import geotiff, tiff

GEO = (0.5, 0.0, 100.0, 0.0, -0.5, 40.0)


def put(path, a, transform=GEO, crs="EPSG:4490"):
    path.write_bytes(tiff.encode(a, transform, crs))
    return str(path)


def get(path):
    t = tiff.Tiff(open(path, "rb").read())
    return t.read(0, 0, t.height, t.width), t


def noise(bands, h, w, dtype=np.uint8, seed=1):
    return (np.random.default_rng(seed).random((bands, h, w)) * 255).astype(dtype)


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_enhance(spark, tmp_path, dtype):
    a = noise(4, 20, 30, dtype)
    src = put(tmp_path / "a.b.tif", a)
    same = api.enhance(spark, src, str(tmp_path / "same")).first()
    assert (same.original, same.output, same.width, same.height, same.bands) == ("a.b.tif", "a.b_Enhance.tiff", 30, 20, 4)
    got, t = get(same.path)
    assert (got == a).all() and t.crs() == "EPSG:4490" and t.transform() == GEO
    dark, _ = get(api.enhance(spark, [src], str(tmp_path / "dark"), brightness=0.0).first().path)
    assert not dark[:3].any() and (dark[3] == a[3]).all()
    with pytest.raises(errors.EnhancementFailed):
        api.enhance(spark, src, str(tmp_path), brightness=9.0)
    with pytest.raises(errors.EnhancementFailed, match="three bands"):
        api.enhance(spark, put(tmp_path / "two.tif", a[:2]), str(tmp_path / "x"))
    with pytest.raises(errors.InvalidImage):
        api.enhance(spark, str(tmp_path / "none.tif"), str(tmp_path / "x"))


def test_enhance_floats_stretch_all_bands(spark, tmp_path):
    a = noise(4, 6, 7, np.float32)
    src = put(tmp_path / "f.tif", a)
    got, _ = get(api.enhance(spark, src, str(tmp_path / "out")).first().path)
    assert np.allclose(got, (a - a.min()) / (a.max() - a.min()), atol=1e-6)
    back, _ = get(api.enhance(spark, src, str(tmp_path / "back"), rescale=True).first().path)
    assert np.allclose(back, a, atol=1e-3)


def test_enhance_regions(spark, tmp_path):
    r = api.enhance_regions(spark, put(tmp_path / "a.tif", noise(3, 12, 12)), str(tmp_path / "out"), brightness=0.2).first()
    assert get(r.path)[0].shape == (3, 12, 12)


def test_windows_by_bands_and_types(spark, tmp_path):
    for n, a in (("one", noise(1, 30, 40)), ("two", noise(2, 30, 40, np.uint16)), ("flat", np.full((3, 30, 40), 2.5, np.float32))):
        rows = geotiff.windows(spark, put(tmp_path / f"{n}.tif", a), 16, 0.25).collect()
        assert [(r.tile_id, r.row_off, r.col_off) for r in rows[:3]] == [(0, 0, 0), (1, 0, 12), (2, 0, 24)]
        first = np.frombuffer(rows[1].data, np.uint8).reshape(3, rows[1].tile_height, rows[1].tile_width)
        part = a[:, :16, 12:28]
        want = {"one": lambda: np.repeat(part, 3, axis=0), "two": lambda: np.stack([part[0] >> 8, part[1] >> 8, 0 * part[0]]), "flat": lambda: 0 * part}[n]()
        assert (first == want.astype(np.uint8)).all()


def test_detect(spark, tmp_path):
    a = np.zeros((3, 700, 700), np.uint8)
    a[:, 100, 100] = 255

    def factory(confidence, iou):
        assert (confidence, iou) == (0.25, 0.45)

        def found(batch):
            out = []
            for tile in batch:
                y, x = np.nonzero(tile[0] == 255)
                out.append([(0, float(j), float(i), 10.0, 6.0, 0.9) for i, j in zip(y, x, strict=True)])
            return out

        return found

    paths = [put(tmp_path / "a.tif", a), put(tmp_path / "empty.tif", 0 * a)]
    docs = {r.image_id.rsplit("/", 1)[-1]: json.loads(r.geojson) for r in api.detect(spark, paths, factory).collect()}
    one, none = docs["a.tif"], docs["empty.tif"]
    assert one["metadata"]["class_counts"] == {"plane": 1} and one["metadata"]["image_width"] == 700
    p = one["features"][0]["properties"]
    assert (p["center_lon"], p["center_lat"], p["source_file"]) == (150.25, -10.25, "a.tif")
    assert none["features"] == [] and none["metadata"]["total_detections"] == 0 and none["metadata"]["class_counts"] == {}


def test_mosaic(spark, tmp_path):
    a, b = noise(2, 20, 20), noise(2, 20, 20, seed=2)
    paths = [put(tmp_path / "a.tif", a), put(tmp_path / "b.tif", b, (0.5, 0.0, 105.0, 0.0, -0.5, 40.0))]
    r = api.mosaic(spark, paths, str(tmp_path / "out")).first()
    assert (r.original, r.output) == ("a.tif,b.tif", "a_b_Mosaic.tiff")
    got, t = get(r.path)
    assert (got == np.concatenate([a[:, :, :10], b], axis=2)).all() and t.transform() == GEO
    with pytest.raises(errors.MosaicFailed):
        api.mosaic(spark, [paths[0], put(tmp_path / "c.tif", a, GEO, "EPSG:4326")], str(tmp_path / "x"))


def test_ortho(spark, tmp_path):
    a = noise(2, 20, 20)
    src = put(tmp_path / "a.tif", a)
    fields = {"HEIGHT_OFF": 0, "HEIGHT_SCALE": 1, "LAT_OFF": 30, "LAT_SCALE": 1, "LONG_OFF": 114, "LONG_SCALE": 1, "LINE_OFF": 10, "LINE_SCALE": 100, "SAMP_OFF": 10, "SAMP_SCALE": 100}
    for name, hot, v in (("LINE_NUM", 3, -1), ("LINE_DEN", 1, 1), ("SAMP_NUM", 2, 1), ("SAMP_DEN", 1, 1)):
        fields |= {f"{name}_COEFF_{i}": v if i == hot else 0 for i in range(1, 21)}
    (tmp_path / "a.rpc").write_text("\n".join(f"{k}: {v}" for k, v in fields.items()))
    with pytest.raises(errors.OrthoFailed, match="no camera model"):
        api.ortho(spark, src, str(tmp_path / "out"))
    dem = put(tmp_path / "dem.tif", np.zeros((1, 10, 10), np.float32), (0.1, 0.0, 113.5, 0.0, -0.1, 30.5), "EPSG:4326")
    r = api.ortho(spark, src, str(tmp_path / "out"), str(tmp_path / "a.rpc"), dem, 5.0, "EPSG:4490", 0.01).first()
    assert (r.output, r.crs, r.width, r.height) == ("a_Ortho.tiff", "EPSG:4490", 20, 20)
    got, _ = get(r.path)
    want = (a[:, 5, 5] * 1.0 + a[:, 5, 6] + a[:, 6, 5] + a[:, 6, 6]) / 4
    assert (np.abs(got[:, 5, 5] - want) <= 0.5 + 1e-6).all()
    sharp, _ = get(api.ortho(spark, src, str(tmp_path / "cubic"), str(tmp_path / "a.rpc"), None, 0.0, "EPSG:4490", 0.01, "cubic").first().path)
    assert sharp.shape == got.shape and (sharp != got).any()


def test_crop(spark, tmp_path):
    a = noise(5, 21, 30)
    r = api.crop(spark, put(tmp_path / "a.tif", a), str(tmp_path / "out"), 10)
    got, t = get(r.first().path)
    assert (got == a[:, 5:15, 10:20]).all() and t.transform() == (0.5, 0.0, 105.0, 0.0, -0.5, 37.5)
    with pytest.raises(errors.InvalidImage):
        api.crop(spark, str(tmp_path / "a.tif"), str(tmp_path / "out"), 22)


@pytest.mark.parametrize("kernel", ["bilinear", "cubic", "lanczos"])
def test_kernels_keep_places_and_constants(spark, kernel):
    img = spark.createDataFrame([(y, x, float(y * 10 + x), 7.0) for y in range(8) for x in range(8)], "y int, x int, v double, c double")
    at = spark.createDataFrame([(0, 0, 3.0, 4.0), (0, 1, 3.5, 3.25), (0, 2, 0.0, 7.0)], "y int, x int, sy double, sx double")
    got = {r.x: r for r in field.sampled(at, img, 8, 8, ("v", "c"), kernel).collect()}
    assert got[0].v == pytest.approx(34.0) and got[2].v == pytest.approx(7.0)
    assert [got[k].c for k in range(3)] == pytest.approx([7.0] * 3)
    t = 0.25 - np.arange(-2, 4)
    w = np.sinc(t) * np.sinc(t / 3)  # this kernel alone bends straight lines a little
    x = (w * np.arange(1, 7)).sum() / w.sum() if kernel == "lanczos" else 3.25
    assert got[1].v == pytest.approx(35 + x)


def test_samples_of_many_images_at_once(spark):
    rows = [(i, y, x, 1000.0 * k + 10 * y + x) for k, i in enumerate("ab") for y in range(150) for x in range(140)]
    img = spark.createDataFrame(rows, "image_id string, y int, x int, v double")
    got = field.translated(img, 0.5, -1.0, 150, 140, ("v",), by=("image_id",))
    assert got.count() == len(rows)
    at = {(r.image_id, r.y, r.x): r.v for r in got.where("y in (0, 127, 128, 149) and x in (0, 128, 139)").collect()}
    assert at["a", 128, 128] == 10 * 127.5 + 129 and at["b", 127, 0] == 1000 + 10 * 126.5 + 1 and at["a", 0, 139] == 139 and at["b", 149, 128] == 1000 + 1485 + 129


def test_samples_leave_out_missing_pixels(spark):
    img = spark.createDataFrame([(0, 0, 4.0, None), (0, 1, 8.0, 2.0)], "y int, x int, v double, w double")
    at = spark.createDataFrame([(0, 0, 0.0, 0.25), (9, 9, 0.0, 5.0), (8, 8, None, 1.0)], "y int, x int, sy double, sx double")
    got = {(r.y, r.x): (r.v, r.w) for r in field.sampled(at, img, 1, 6, ("v", "w")).collect()}
    assert got == {(0, 0): (5.0, 0.5)}
    assert field.sampled(at.limit(0), img, 1, 6, ("v",)).count() == 0


def test_elevation_is_interpolated(spark):
    dem = spark.createDataFrame([(y, x, float(10 * y + x), 0.5) for y in range(60, 64) for x in range(220, 224)], "lat_cell bigint, lon_cell bigint, h double, res double")
    grid = spark.createDataFrame([(0, 0, 110.5, 31.0), (0, 1, 110.25, 30.25), (1, 0, 10.0, 31.0)], "y int, x int, lon double, lat double")
    got = {(r.y, r.x): r.h for r in api.orthos.heights(grid, dem, -7.0).collect()}
    assert got == {(0, 0): 10 * 61.5 + 220.5, (0, 1): 10 * 60.0 + 220.0, (1, 0): -7.0}


def test_no_data_stays(spark, tmp_path):
    (tmp_path / "n.tif").write_bytes(tiff.encode(noise(3, 8, 9), GEO, "EPSG:4490", nodata="-9999"))
    assert get(api.enhance(spark, str(tmp_path / "n.tif"), str(tmp_path / "out")).first().path)[1].nodata() == "-9999"
    assert get(api.crop(spark, str(tmp_path / "n.tif"), str(tmp_path / "cut"), 4).first().path)[1].nodata() == "-9999"
    assert get(put(tmp_path / "m.tif", noise(1, 4, 4)))[1].nodata() is None


def test_codes_of_degrees_and_metres():
    kinds = {code: tiff.Tiff(tiff.encode(noise(1, 4, 4), GEO, f"EPSG:{code}")) for code in (4326, 4490, 4491, 4499, 4513, 4554, 4555, 3857)}
    model = {code: dict(zip(t.tags[tiff.GEOKEYS][4::4], t.tags[tiff.GEOKEYS][7::4], strict=True)) for code, t in kinds.items()}
    assert {code: m[1024] for code, m in model.items()} == {4326: 2, 4490: 2, 4491: 1, 4499: 1, 4513: 1, 4554: 1, 4555: 2, 3857: 1}
    assert all(t.crs() == f"EPSG:{code}" for code, t in kinds.items())


@pytest.mark.parametrize(("dtype", "bands"), [(np.float32, 1), (np.float64, 3)])
def test_floating_point_predictor(dtype, bands):
    a = np.random.default_rng(4).standard_normal((bands, 12, 10)).astype(dtype)
    t = tiff.Tiff(tiff.encode(a, GEO, None, compress=False))
    size, n = a.itemsize, 10 * bands
    big = np.ascontiguousarray(a.transpose(1, 2, 0)).astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(12, n, size)
    planes = big.transpose(0, 2, 1).reshape(12, n * size).copy()
    planes[:, bands:] -= planes[:, :-bands].copy()
    at = t.tags[tiff.OFFSETS][0]
    t.data, t.predictor = t.data[:at] + planes.tobytes() + t.data[at + planes.size :], 3
    assert (t.read(0, 0, 12, 10) == a).all()


def test_embedded_model(spark):
    tag = [0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0] + [float(i) for i in range(80)]
    r = api.cameras.from_array(spark.createDataFrame([("a", tag)], "image_id string, rpc array<double>")).first()
    assert (r.line_off, r.samp_off, r.lat_off, r.long_off, r.height_off) == (1, 2, 3, 4, 5) and (r.line_scale, r.height_scale) == (6, 10)
    assert r.line_num_coeff[0] == 0 and r.line_den_coeff[0] == 20 and r.samp_den_coeff[19] == 79
