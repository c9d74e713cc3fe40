"""Files in parts: planning, pruning, headers, tiled files by many tasks."""

import struct

import numpy as np
import pytest
from gridloom.operators import tiles
from gridloom.sources import geotiff, scan, shared, tiff

GEO = (0.5, 0.0, 100.0, 0.0, -0.5, 40.0)


def image(bands, height, width, dtype=np.uint8, seed=1):
    return (np.random.default_rng(seed).random((bands, height, width)) * 250).astype(dtype)


def put(path, a, **more):
    path.write_bytes(tiff.encode(a, GEO, "EPSG:4490", **more))
    return str(path)


def rebuilt(rows, shape, dtype):
    out = np.zeros(shape, dtype)
    for r in rows:
        out[:, r.row_off : r.row_off + r.height, r.col_off : r.col_off + r.width] = np.frombuffer(r.data, r.dtype).reshape(r.bands, r.height, r.width)
    return out


def test_a_file_is_many_partitions(spark, tmp_path):
    a = image(3, 300, 200)
    path = put(tmp_path / "a.tif", a, rows=16)
    parts = geotiff.chunks(spark, path, 32, area=3 * 200 * 64)
    assert parts.rdd.getNumPartitions() == 5
    assert (rebuilt(parts.collect(), a.shape, a.dtype) == a).all()
    assert geotiff.chunks(spark, path, 32).rdd.getNumPartitions() == 1
    small = [put(tmp_path / f"s{k}.tif", image(1, 8, 8, seed=k)) for k in range(6)]
    few = geotiff.chunks(spark, small, 32, area=3 * 64)  # small files share partitions
    assert few.rdd.getNumPartitions() == 6 and geotiff.chunks(spark, small, 32).rdd.getNumPartitions() == 1 and few.count() == 6


def test_wide_tiled_files_are_cut_along_both_sides(spark, tmp_path):
    a = image(1, 64, 512, np.uint16)
    path = put(tmp_path / "w.tif", a)
    (wide,) = geotiff.written(geotiff.chunks(spark, path, 32), geotiff.scenes(spark, path), str(tmp_path / "out"), 32)
    parts = geotiff.chunks(spark, wide, 32, area=2 * 32 * 32 * 4)
    assert parts.rdd.getNumPartitions() == 8
    assert (rebuilt(parts.collect(), a.shape, a.dtype) == a).all()


def test_bands_rows_and_columns_are_chosen_before_reading(spark, tmp_path):
    a = image(2, 100, 90)
    path = put(tmp_path / "a.tif", a, rows=32)
    every, some = geotiff.chunks(spark, path, 32, [1], area=1), geotiff.chunks(spark, path, 32, [1], area=1, rows=(32, 96), columns=(None, 64))
    assert (every.rdd.getNumPartitions(), some.rdd.getNumPartitions()) == (4, 2)
    rows = some.collect()
    assert sorted((r.chunk_row, r.chunk_col) for r in rows) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    for r in rows:
        assert r.bands == 1 and (np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) == a[1, r.row_off : r.row_off + r.height, r.col_off : r.col_off + r.width]).all()
    assert geotiff.chunks(spark, path, 32, rows=(1000, None)).count() == 0
    # Scans of one frame in one plan keep their own conditions.
    assert every.where("row_off = 0").unionByName(every).count() == 3 + 12 and every.count() == 12


def test_headers_and_windows_fetch_no_more_than_they_need(tmp_path):
    a = image(3, 2000, 1000)
    path = put(tmp_path / "a.tif", a, compress=False, rows=10)
    source = scan.Ranges(f"file://{path}")
    t = tiff.Tiff(source)
    assert (t.width, t.height, t.bands) == (1000, 2000, 3) and source.read < 3 * scan.HEADER < len(source) / 20
    before = source.read
    assert (t.read(995, 10, 20, 30) == a[:, 995:1015, 10:40]).all()
    assert source.read - before == 3 * 10 * 1000 * 3
    t.read(1000, 900, 10, 100)  # kept parts are not fetched again
    assert source.read - before == 3 * 10 * 1000 * 3


@pytest.mark.parametrize(("tile", "overlap", "edges"), [(64, 0.25, False), (64, 0.15, True), (16, 0.0, False)])
def test_windows_are_those_of_the_table(spark, tmp_path, tile, overlap, edges):
    a = image(3, 150, 110)
    path = put(tmp_path / "a.tif", a, rows=7)
    got = geotiff.windows(spark, path, tile, overlap, edges, area=3 * 110 * 70).collect()
    info = geotiff.scenes(spark, path)
    want = tiles.windows(info, tile, overlap, edges).drop("image_id").collect()
    assert sorted((r.tile_id, r.row_off, r.col_off, r.tile_width, r.tile_height) for r in got) == sorted(map(tuple, want))
    for r in got:
        assert (np.frombuffer(r.data, np.uint8).reshape(3, r.tile_height, r.tile_width) == a[:, r.row_off : r.row_off + r.tile_height, r.col_off : r.col_off + r.tile_width]).all()


@pytest.mark.parametrize("compress", ["lzw", "deflate", None])
@pytest.mark.parametrize("big", [True, False])
@pytest.mark.parametrize("append", [True, False])
def test_tiled_files(spark, tmp_path, compress, big, append):
    images = {"a.tif": image(4, 100, 70, np.float32), "b.tif": image(1, 16, 16, np.int16), "c.tif": image(3, 33, 200, np.uint16)}
    paths = [put(tmp_path / n, a, nodata="-9") for n, a in images.items()]
    out = geotiff.written(geotiff.chunks(spark, paths, 32), geotiff.scenes(spark, paths), f"{tmp_path}/out", 32, compress, big, append)
    assert [p.rsplit("/", 1)[1] for p in out] == list(images) and len(list((tmp_path / "out").iterdir())) == 3
    for p in out:
        t, a = tiff.Tiff(open(p, "rb").read()), images[p.rsplit("/", 1)[1]]
        assert (t.read(0, 0, *a.shape[1:]) == a).all() and t.tiled and t.block == (32, 32)
        assert (t.transform(), t.crs(), t.nodata(), t.dtype.name) == (GEO, "EPSG:4490", "-9", a.dtype.name)
        assert struct.unpack_from("<H", t.data, 2)[0] == (43 if big else 42)


def test_chunks_that_are_missing_are_zeros(spark, tmp_path):
    a = image(2, 70, 70)
    path = put(tmp_path / "a.tif", a)
    parts = geotiff.chunks(spark, path, 32).where("chunk_row <> 1 or chunk_col <> 1")
    (out,) = geotiff.written(parts, geotiff.scenes(spark, path), str(tmp_path / "out"), 32)
    a[:, 32:64, 32:64] = 0
    assert (tiff.Tiff(open(out, "rb").read()).read(0, 0, 70, 70) == a).all()
    none = geotiff.written(parts.where("bands > 9"), geotiff.scenes(spark, path), str(tmp_path / "none"), 32)
    assert not tiff.Tiff(open(none[0], "rb").read()).read(0, 0, 70, 70).any()
    with pytest.raises(geotiff.InvalidImage):
        geotiff.written(parts, geotiff.scenes(spark, path), str(tmp_path / "odd"), 33)


def test_places_are_sums_of_the_sizes_before(spark):
    rows = [(i, k, (k * 7 + len(i)) % 11 + 1) for i in ("a", "bb") for k in range(137)]
    df = spark.createDataFrame(rows, "image_id string, k long, n long")
    got = {(r.image_id, r.k): r["at"] for r in geotiff.ahead(df, 5).collect()}
    assert got == {(i, k): sum(n for j, m, n in rows if j == i and m < k) for i, k, _ in rows}
    assert geotiff.ahead(df.limit(0), 5).count() == 0


def test_keys_of_projected_codes_inside_ranges_of_degrees():
    for code, kind in ((4326, 2), (4490, 2), (4484, 1), (4489, 1), (4568, 1), (4652, 1), (4766, 1), (4800, 1), (4513, 1)):
        t = tiff.Tiff(tiff.encode(image(1, 4, 4), GEO, f"EPSG:{code}"))
        assert dict(t.geokeys())[1024] == kind and t.crs() == f"EPSG:{code}"
    own = tiff.Tiff(tiff.encode(image(1, 4, 4), GEO, "EPSG:4555", geokeys=[(1024, 1), (1025, 2), (3072, 4555)]))
    assert own.geokeys() == [(1024, 1), (1025, 2), (3072, 4555)]


def test_shared_folder(spark):
    df = shared.saved(spark.range(3), "x")
    assert df.count() == 3
    shared.drop(df)
    shared.drop(spark.range(1))
    with pytest.raises(Exception, match="(?i)path|file"):
        df.count()
