"""Pairs of boxes by blocks of a cell, and their overlaps by edges."""

import duckdb
import numpy as np
from pyspark.sql import GroupedData

from gridloom.operators import boxes
from gridloom.plans.catalog import ORACLES, QUERIES

from .compare import both


def some(n, seed):
    r = np.random.default_rng(seed)
    turns = np.array([0.0, 0.5, np.pi / 2, 0.5 + 1e-8, 0.5 + np.pi / 2, 2.0, 1.0])
    return {"cx": r.integers(0, 60, n) * 1.0, "cy": r.integers(0, 60, n) * 1.0, "width": r.integers(0, 50, n) * 1.0, "height": r.integers(1, 30, n) * 1.0, "angle": np.where(r.random(n) < 0.5, turns[r.integers(0, len(turns), n)], r.random(n) * 3)}


def test_overlaps_by_edges():
    c = some(150, 1)
    i, j = np.triu_indices(150)
    got = boxes.common_areas(c, (np.cos(c["angle"]), np.sin(c["angle"])), i, j)
    a, b = (boxes.rings(*(c[k][w] for k in boxes.SHAPE)) for w in (i, j))
    want = np.where(boxes.apart(a, b), 0.0, boxes.overlap_areas(a, b))
    assert np.abs(got - want).max() < 1e-5 and (want > 0).sum() > 1000


def test_pairs_of_a_crowded_cell_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(boxes, "DEALT", 9, raising=False)
    monkeypatch.setattr(boxes, "AT_ONCE", 13, raising=False)
    c = some(70, 2)
    rows = [(k % 2, k, 3, float(k % 5), *(float(c[s][k]) for s in boxes.SHAPE)) for k in range(70)] + [(None, 70, 3, 1.0, 9.0, 9.0, 9.0, 9.0, 0.0)]
    df = spark.createDataFrame(rows, "image_id int, det_id long, cls int, confidence double, " + ", ".join(f"{s} double" for s in boxes.SHAPE))
    edge = {r.det_id: r for r in df.where("image_id is not null").select("image_id", "det_id", "confidence", *(f(*(p[k] for p in boxes.corner_columns())).alias(n) for n, f, k in (("x0", boxes.F.least, 0), ("x1", boxes.F.greatest, 0), ("y0", boxes.F.least, 1), ("y1", boxes.F.greatest, 1)))).collect()}
    meet = lambda a, b: a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1
    want = {(a.det_id, b.det_id) for a in edge.values() for b in edge.values() if a.image_id == b.image_id and (-a.confidence, a.det_id) < (-b.confidence, b.det_id) and meet(a, b)}
    got = [(r.i, r.j) for r in boxes.met(df, cell=32.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    share = {(r.i, r.j): r.iou for r in boxes.with_iou(boxes.pairs(df)).collect()}
    ours = {(r.i, r.j): r.iou for r in boxes.met(df, iou=True).collect()}
    assert set(ours) == set(share) == want and all(abs(ours[k] - share[k]) < 1e-8 for k in want)
    assert {(r.i, r.j) for r in boxes.met(df, over=0.3, iou=True, least=0.3).collect()} == {k for k, v in share.items() if v > 0.3}


def odd_events(spark, folder, rows):
    """A folder with a table of events (event_id, user_id, event_type, value)."""
    df = spark.createDataFrame([(i, None, u, e, v, None) for i, u, e, v in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(str(folder / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con


#: Boxes with edges on one line, of which SQL loses corners by rounding; then shares in the middle of a step of 1e-6.
ON_A_LINE = [(538124, 7940, "click", 30.91), (67124, 1140, "click", 220.58)]
MID_STEP = [(541602, 8560, "view", 40.51), (156548, 2360, "view", 181.54), (133591, 2892, "view", 0.23), (4537, 492, "view", 54.85), (414342, 6968, "error", 35.79), (227288, 3768, "error", 0.81)]


def test_shares_are_those_of_sql_to_the_last_step(spark, tmp_path):
    con = odd_events(spark, tmp_path, ON_A_LINE + MID_STEP)
    ours, theirs = both(spark, con, QUERIES["obb_iou"], ORACLES["obb_iou"], str(tmp_path))
    assert ours == theirs and len(ours) >= 4


def test_suppression_is_that_of_sql_where_edges_lie_on_a_line(spark, tmp_path):
    con = odd_events(spark, tmp_path, ON_A_LINE)
    ours, theirs = both(spark, con, QUERIES["nms_obb"], ORACLES["nms_obb"], str(tmp_path))
    assert ours == theirs and len(ours) == 2


def test_pairs_of_a_crowd_are_returned_in_parts(spark, monkeypatch):
    n, taken = 2500, []
    df = spark.range(n).selectExpr("1 image_id", "id det_id", "3 cls", "id / 9999 confidence", "50.0D cx", "50.0D cy", "20.0D width", "10.0D height", "id / 1000 angle")
    monkeypatch.setattr(GroupedData, "applyInArrow", lambda self, f, kinds: taken.append((self._df, f)))
    boxes.met(df)
    rows, run = taken.pop()
    rows = rows.toArrow()
    assert len(rows) == n  # a crowd of one block is exchanged once
    parts = [len(b) for b in run(iter(rows.to_batches()))]
    assert sum(parts) == n * (n - 1) // 2 and max(parts) <= boxes.RETURNED + boxes.AT_ONCE
