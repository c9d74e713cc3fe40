"""Percentiles and blurs against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import tone
from gridloom.operators.quantile import quantile


@pytest.mark.parametrize("p", [0.55, 1.0])
@pytest.mark.parametrize(("bins", "few"), [(4096, 4096), (256, 2)])
def test_percentiles(spark, p, bins, few):
    r = np.random.default_rng(3)
    groups = {
        "uniform": r.random(500), "one": np.array([7.0]), "same": np.full(40, -2.5), "two": np.array([1.0, 2.0]), "ties": r.integers(0, 4, 300).astype(float),
        "far": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, 1e-300, -1e-300]), "skewed": np.concatenate([np.full(400, 1e-9), r.random(9) * 1e9]), "close": 1 + np.arange(50) * 2.3e-16,
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("uniform", None), ("none", None)]
    got = {x.g: x.q for x in quantile(spark.createDataFrame(rows, "g string, v double"), "g", "v", p, bins, few).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s = np.sort(vs)
        at = p * (len(s) - 1)
        k = int(at)
        want = s[k] if at == k else s[k] + (s[k + 1] - s[k]) * (at - k)
        assert got[g] == want, g


def test_percentiles_of_odd_values(spark):
    rows = [("a", float("inf")), ("a", 1.0), ("a", 2.0), ("b", float("nan")), ("b", 3.0), ("b", 4.0), ("c", float("nan")), ("c", float("nan"))]
    got = {x.g: x.q for x in quantile(spark.createDataFrame(rows, "g string, v double"), "g", "v", 0.5, 256, 1).collect()}
    assert got["a"] == 2.0 and got["b"] == 4.0 and np.isnan(got["c"])
    assert quantile(spark.createDataFrame([], "g string, v double"), "g", "v", 0.5).count() == 0


def blurred(v, there):
    """By places, with the opposite neighbour for one that is missing."""

    def along(v, axis):
        out = np.zeros_like(v)
        for i in np.ndindex(v.shape):
            side = []
            for d in (-1, 1):
                j = list(i)
                j[axis] += d
                side.append(v[tuple(j)] if 0 <= j[axis] < v.shape[axis] and there[tuple(j)] else None)
            b, a = side
            b, a = (b if b is not None else a if a is not None else v[i]), (a if a is not None else b if b is not None else v[i])
            out[i] = (b + 2 * v[i] + a) / 4
        return out

    return along(along(v, 1), 0)


@pytest.mark.parametrize(("chunk", "gaps"), [(128, False), (8, False), (8, True), (1, False)])
def test_blur_across_chunks(spark, monkeypatch, chunk, gaps):
    monkeypatch.setattr(tone, "CHUNK", chunk)
    r = np.random.default_rng(1)
    v, there = r.random((19, 25)), np.ones((19, 25), bool)
    if gaps:
        there[3, 4:9] = there[8, 8] = False
    rows = [("a", y, x, float(v[y, x]), "kept", float(y)) for y in range(19) for x in range(25) if there[y, x]] + [("b", 5, 5, 2.0, "alone", 5.0)]
    df = spark.createDataFrame(rows, "image_id string, y int, x int, v double, other string, w double")
    soft = tone.blurred(df, "v", "w")
    assert "Window" not in soft._jdf.queryExecution().executedPlan().toString() and soft.columns == df.columns
    got = {(t.image_id, t.y, t.x): t for t in soft.collect()}
    want = blurred(v, there)
    assert len(got) == len(rows) and got["b", 5, 5].v == 2.0
    for (i, y, x), t in got.items():
        assert i == "b" or (t.v == pytest.approx(want[y, x], abs=1e-12) and t.other == "kept")


def test_plans_hold_no_pixel_windows_and_no_percentile_buffers(spark):
    px = spark.range(400).select(F.lit("a").alias("image_id"), (F.col("id") % 20).cast("int").alias("x"), F.floor(F.col("id") / 20).cast("int").alias("y"), *((F.col("id") * k % 256).alias(c) for k, c in ((7, "r"), (11, "g"), (13, "b"))))
    plan = tone.enhance_regions(px)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "lag(" not in plan
