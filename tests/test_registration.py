"""Correlation by bands against correlation of whole arrays."""

import numpy as np
import pytest

from gridloom.operators import registration


@pytest.mark.parametrize("area", [1 << 20, 150, 1])
def test_correlation_by_bands(spark, area):
    r = np.random.default_rng(5)
    ground = r.random((60, 70))
    pairs = {
        "moved": (ground[5:45, 8:58], ground[2:42, 13:63]), "still": (ground[:17, :23], ground[:17, :23]), "empty": (np.zeros((12, 9)), np.zeros((12, 9))),
        "thin": (ground[:1, :30], ground[:1, :30]), "odd": (ground[:31, :7], ground[1:32, :7].copy()), "none": (np.full((8, 8), np.nan), ground[:8, :8]),
    }
    rows = [(p, s, y, x, *a.shape, float(a[y, x])) for p, both in pairs.items() for s, a in zip(("ref", "src"), both, strict=True) for y in range(a.shape[0]) for x in range(a.shape[1])]
    df = spark.createDataFrame(rows, "pair_id string, side string, py int, px int, height int, width int, v double").where("not (pair_id = 'odd' and side = 'src' and py between 3 and 5)")
    pairs["odd"][1][3:6] = 0  # pixels that are missing
    found = registration.shifts(df, ["v"], area)
    got = {x.pair_id: (x.d_row, x.d_col, x.response) for x in found.collect()}
    assert set(got) == set(pairs)
    for p, (ref, src) in pairs.items():
        want = registration.correlate(ref, src)
        assert got[p] == pytest.approx(want, abs=1e-9), p
    assert got["moved"][:2] == pytest.approx((-3, 5), abs=0.3)


def test_three_bands_are_grey(spark):
    r = np.random.default_rng(6)
    a = r.random((3, 40, 40))
    rows = [(7, s, y, x, 40, 40, *map(float, (a if s == "ref" else np.roll(a, (2, -1), (1, 2)))[:, y, x])) for s in ("ref", "src") for y in range(40) for x in range(40)]
    df = spark.createDataFrame(rows, "pair_id int, side string, py int, px int, height int, width int, r double, g double, b double")
    (got,) = registration.shifts(df, ["r", "g", "b"], 200).collect()
    want = registration.correlate(registration.grey(list(a)), registration.grey(list(np.roll(a, (2, -1), (1, 2)))))
    assert (got.d_row, got.d_col, got.response) == pytest.approx(want, abs=1e-9)
    assert registration.shifts(df.limit(0), ["r", "g", "b"]).count() == 0


def test_blocks_are_measured_again_on_what_both_show():
    r = np.random.default_rng(3)
    ground = r.integers(0, 256, (400, 80)).astype(float)
    far = {f: 0.0 for f in (registration.correlate, registration.refined)}
    for y in range(10, 330, 25):
        ref, src = ground[y : y + 50, 10:60], ground[y - 1 : y + 49, 12:62]
        for f in far:
            far[f] = max(far[f], *(abs(a - b) for a, b in zip(f(ref, src)[:2], (-1, 2), strict=True)))
    assert far[registration.correlate] > 0.03 and far[registration.refined] < 1e-6
    assert registration.refined(ref, src)[2] == registration.correlate(ref, src)[2]
    assert registration.refined(np.zeros((40, 40)), np.zeros((40, 40))) == (0.0, 0.0, 0.0)
