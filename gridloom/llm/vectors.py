"""Embedding near-dedup by an epsilon grid order join.

Unit vectors at a cosine of at least COSINE lie within EPS of each other. They are rotated to their principal axes,
sorted by the cells that a grid of that width has on the leading axes, and cut into blocks of the sorted sequence,
each with its bounding box. The join goes down from intervals of blocks to blocks, eight at a time: a pair of
intervals whose boxes are more than EPS apart on the leading axes can hold no link and is dropped whole. What is left
are pairs of blocks; inside them the same recursion goes on by halves, down to leaves. There every pair of points gets
a bound from FIRST leading axes and the length of what is left of both vectors, which is at least their cosine; only
pairs whose bound reaches COSINE are multiplied out.

A block meets its partners TILE at a time, so that it is sent once for as many of them, and a tile is what tasks share
out.

Exact copies are one point with a weight. A pair of blocks returns counts and a spanning forest of its links, not the
links: both grow with the blocks, not with the square of a cluster.

Defined cases: vectors that are null, empty or all zero or hold null or non-finite components link with nothing, not
even their copies; shorter vectors count as filled up with zeros; a null id is carried through and never names a
component; rows that share a vector are linked to each other; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .store import drop, free, save

COSINE = 0.9
#: Leading axes of the grid and the boxes, and of the bounds of pairs; points in a leaf; partners in a tile.
AXES, FIRST, LEAF, TILE = 12, 24, 512, 8
#: Bytes of a block's vectors in double precision, about.
BLOCK = 4 << 20
#: Cosines that near the threshold are taken again, exactly summed.
CLOSE = 1e-9


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved (vec_id, k1, k2), null keys for what links with nothing; and (node, k1, k2, v, n, least), a row for each distinct vector."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    keyed = vectors.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))
    keyed = keyed.withColumns({"k1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "k2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))})
    rows = save(keyed.select("vec_id", "k1", "k2"), "ego-rows")
    each = keyed.where("v is not null").groupBy("k1", "k2").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    return rows, save(each.withColumn("node", F.monotonically_increasing_id()), "ego-points")


def _raw(batch: pa.RecordBatch, width: int) -> np.ndarray:
    out = np.zeros((batch.num_rows, width))
    for i, v in enumerate(batch.column("v").to_pylist()):
        out[i, : len(v)] = v
    return out


def _units(raw: np.ndarray) -> np.ndarray:
    out = raw.astype(float)
    out /= np.abs(out).max(axis=1, keepdims=True)  # else squares may be beyond the range
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def rotation(points: DataFrame, width: int) -> np.ndarray:
    """The principal axes, by variance: from sums of products, which are as many as the square of the width."""
    at = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            x = _units(_raw(batch, width))
            total += x.T @ x
            first += x.sum(axis=0)
        values = np.concatenate([total[at], first])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["i", "s"])

    sums = np.zeros(len(at[0]) + width)
    for r in points.select("v").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        sums[r.i] = r.s
    n = max(points.count(), 1)
    cov = np.zeros((width, width))
    cov[at] = sums[: len(at[0])] / n
    cov = np.triu(cov) + np.triu(cov, 1).T
    mean = sums[len(at[0]) :] / n
    return np.linalg.eigh(cov - np.outer(mean, mean))[1][:, ::-1].copy()


def blocks(points: DataFrame, axes: np.ndarray, eps: float, kind: str) -> DataFrame:
    """(block, lo, hi, nodes, weights, x): the points in grid order, BLOCK bytes at a time; block counts up along the order.

    x: the vectors as they came, in numpy's type kind.
    """
    width = len(axes)
    lead, most = min(AXES, width), max(LEAF, BLOCK // (8 * width))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _raw(batch, width)
            y = (_units(raw) @ axes)[:, :lead]
            c = np.floor(y / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), *(pa.array(c[:, k]) for k in range(lead)), pa.array([r.tobytes() for r in raw.astype(kind)], pa.binary()), pa.array([r.tobytes() for r in y], pa.binary())], names=["node", "n", *(f"c{k}" for k in range(lead)), "x", "y"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, kept = TaskContext.get().partitionId(), 0, []

        def flush(table: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            y = np.frombuffer(b"".join(table.column("y").to_pylist())).reshape(-1, lead)
            row = [task, seq, y.min(axis=0).tolist(), y.max(axis=0).tolist(), table.column("node").to_numpy().tobytes(), table.column("n").to_numpy().tobytes(), b"".join(table.column("x").to_pylist())]
            seq += 1
            types = (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 3)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["task", "seq", "lo", "hi", "nodes", "weights", "x"])

        for batch in batches:
            kept.append(batch)
            while sum(b.num_rows for b in kept) >= most:
                table = pa.Table.from_batches(kept)
                yield flush(table.slice(0, most))
                kept = table.slice(most).to_batches()
        if sum(b.num_rows for b in kept):
            yield flush(pa.Table.from_batches(kept))

    keys = [f"c{k}" for k in range(lead)]
    placed = points.select("node", "n", "v").mapInArrow(cells, "node bigint, n bigint, " + ", ".join(f"{k} int" for k in keys) + ", x binary, y binary")
    n = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = placed.repartitionByRange(n, *keys, "node").sortWithinPartitions(*keys, "node")
    cutted = save(ordered.mapInArrow(cut, "task int, seq int, lo array<double>, hi array<double>, nodes binary, weights binary, x binary"), "ego-blocks")
    # Blocks of a task follow those of the tasks before; the tasks are as many as partitions.
    sizes = cutted.groupBy("task").agg(F.count("*").alias("b"))
    ahead = sizes.select("task", F.coalesce(F.sum("b").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return cutted.join(ahead, "task").withColumn("block", F.col("ahead") + F.col("seq")).drop("task", "seq", "ahead")


FAN = 3


def block_pairs(headers: DataFrame, count: int, eps: float) -> DataFrame:
    """(i, j), i <= j: the pairs of blocks whose boxes are within eps, from (block, lo, hi)."""
    levels = max(1, math.ceil(math.log2(max(count, 2)) / FAN))
    pairs = headers.sparkSession.createDataFrame([(0, 0)], "i bigint, j bigint")
    # A little is allowed for rounding in the rotation: the boxes only decide what is looked at.
    for level in range(levels - 1, -1, -1):
        interval = F.shiftright("block", FAN * level)
        wide = headers.select(interval.alias("b"), F.posexplode(F.arrays_zip("lo", "hi")).alias("d", "z")).groupBy("b", "d").agg(F.min("z.lo").alias("lo"), F.max("z.hi").alias("hi"))
        box = wide.groupBy("b").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "lo", "hi"))), lambda z: F.struct(z["lo"].alias("lo"), z["hi"].alias("hi"))).alias("box"))
        kids = F.sequence(F.lit(0), F.lit((1 << FAN) - 1))
        down = pairs.select((F.col("i") * (1 << FAN)).alias("i0"), (F.col("j") * (1 << FAN)).alias("j0")).select("i0", "j0", F.explode(kids).alias("a")).select((F.col("i0") + F.col("a")).alias("i"), "j0", F.explode(kids).alias("c")).select("i", (F.col("j0") + F.col("c")).alias("j")).where("i <= j")
        both = down.join(box.select(F.col("b").alias("i"), F.col("box").alias("bi")), "i").join(box.select(F.col("b").alias("j"), F.col("box").alias("bj")), "j")
        gap = F.zip_with("bi", "bj", lambda p, q: F.greatest(p["lo"] - q["hi"], q["lo"] - p["hi"], F.lit(0.0)))
        pairs = both.where(F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= eps * eps + 1e-9).select("i", "j")
    return pairs


class Block:
    """A block's points: nodes, weights, unit vectors x, their leading axes y, and what bounds their cosines."""

    def __init__(self, nodes: bytes, weights: bytes, x: bytes, axes: np.ndarray, kind: str):
        self.nodes, self.weights = np.frombuffer(nodes, np.int64), np.frombuffer(weights, np.int64)
        self.x = _units(np.frombuffer(x, kind).reshape(-1, len(axes)))
        first = self.x @ axes[:, :FIRST]
        rest = np.sqrt(np.maximum(0.0, 1.0 - (first * first).sum(axis=1)))
        self.y, self.bound = first[:, :AXES], np.column_stack([first, rest]).astype(np.float32)


def near(p: Block, q: Block, cosine: float, eps: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(a, c, links): for each pair of leaves that has links, where they start and which of their points are linked."""
    unsure = np.float32(cosine - 4e-7 * (FIRST + 9))  # the bounds are in single precision

    def go(a: int, b: int, c: int, d: int) -> Iterator[tuple[int, int, np.ndarray]]:
        s, t = p.y[a:b], q.y[c:d]
        gap = np.maximum(0, np.maximum(s.min(0) - t.max(0), t.min(0) - s.max(0)))
        if (gap * gap).sum() > eps * eps + 1e-9:
            return
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(p.bound[a:b] @ q.bound[c:d].T >= unsure)
            if not len(i):
                return
            links = np.zeros((b - a, d - c), bool)
            for k in range(0, len(i), 1 << 14):
                u, v = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                exact = np.einsum("ij,ij->i", p.x[a + u], q.x[c + v])
                links[u, v] = exact >= cosine
                for z in np.flatnonzero(np.abs(exact - cosine) < CLOSE):
                    links[u[z], v[z]] = math.fsum(p.x[a + u[z]] * q.x[c + v[z]]) >= cosine
            if p is q and a == c:
                np.fill_diagonal(links, False)
            if links.any():
                yield a, c, links
            return
        m, n = (a + b) // 2 if b - a > LEAF else b, (c + d) // 2 if d - c > LEAF else d
        for e, f in ((a, m), (m, b)):
            for g, h in ((c, n), (n, d)):
                # Within a block a pair of leaves is met once.
                if e < f and g < h and not (p is q and h <= e):
                    yield from go(e, f, g, h)

    yield from go(0, len(p.x), 0, len(q.x))


def forest(links: np.ndarray) -> list[tuple[int, int, bool]]:
    """(row, other, other is a column): edges from one row of each component of a bipartite table to all its others."""
    out, rows_left = [], links.any(axis=1)
    cols_left = np.ones(links.shape[1], bool)
    for root in np.flatnonzero(rows_left):
        if not rows_left[root]:
            continue
        rows_left[root], front = False, np.array([root])
        while len(front):
            cols = np.flatnonzero(links[front].any(axis=0) & cols_left)
            cols_left[cols] = False
            out += [(root, c, True) for c in cols]
            front = np.flatnonzero(links[:, cols].any(axis=1) & rows_left) if len(cols) else cols
            rows_left[front] = False
            out += [(root, r, False) for r in front]
    return out


def met(p: Block, q: Block, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The weights of the links of p's and of q's points, and edges that join what the links join."""
    got = np.zeros(len(p.nodes), np.int64), np.zeros(len(q.nodes), np.int64)
    parent: dict[int, int] = {}

    def root(n: int) -> int:
        while parent.setdefault(n, n) != n:
            parent[n] = n = parent[parent[n]]
        return n

    edges = []
    for a, c, links in near(p, q, cosine, eps):
        e, f = links.shape
        got[0][a : a + e] += links @ q.weights[c : c + f]
        if not (p is q and a == c):
            got[1][c : c + f] += links.T @ p.weights[a : a + e]
        for r, o, column in forest(links):
            u, v = int(p.nodes[a + r]), int(q.nodes[c + o] if column else p.nodes[a + o])
            ru, rv = root(u), root(v)
            if ru != rv:
                parent[ru] = rv
                edges.append((u, v))
    return *got, edges


def joined(table: DataFrame, pairs: DataFrame, axes: np.ndarray, kind: str, cosine: float, eps: float) -> DataFrame:
    """(a, b, n): b null: a has n more links; else a and b are in one component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = at = None
        for batch in batches:
            for row in batch.to_pylist():
                other = Block(row["nodes"], row["weights"], row["x"], axes, kind)
                if row["j"] is None:  # a tile's own block comes first
                    own, at = other, (row["i"], row["tile"])
                    continue
                if at != (row["i"], row["tile"]):
                    raise RuntimeError("a tile's own block must come first")
                if row["i"] == row["j"]:
                    other = own
                left, right, edges = met(own, other, cosine, eps)
                gained = [(own.nodes, left), (other.nodes, right)]
                a = np.concatenate([n[g > 0] for n, g in gained] + [np.array([u for u, _ in edges], np.int64)])
                n = np.concatenate([g[g > 0] for _, g in gained] + [np.zeros(len(edges), np.int64)])
                b = [None] * (len(a) - len(edges)) + [v for _, v in edges]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    n = max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tiles = pairs.select("i", F.floor(F.col("j") / TILE).alias("tile"), "j")
    own = tiles.select("i", "tile").distinct().select("i", "tile", F.lit(None).cast("long").alias("j"), F.col("i").alias("block"))
    rows = own.unionByName(tiles.withColumn("block", F.col("j"))).join(table.select("block", "nodes", "weights", "x"), "block")
    ordered = rows.repartition(n, "i", "tile").sortWithinPartitions("i", "tile", F.col("j").asc_nulls_first())
    return ordered.select("i", "tile", "j", "nodes", "weights", "x").mapInArrow(run, "a bigint, b bigint, n bigint")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows, points = classes(vectors.select("vec_id", "embedding"))
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    width = points.agg(F.max(F.size("v"))).first()[0] or 1
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    axes = rotation(points, width)
    table = blocks(points, axes, eps, kind)
    count = table.count()
    pairs = save(block_pairs(table.select("block", "lo", "hi"), count, eps), "ego-pairs")
    found = save(joined(table, pairs, axes, kind, cosine, eps), "ego-links")
    free(vectors.sparkSession)
    links = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b"))
    all_ = points.select("node", "k1", "k2", "n", "least").join(links, F.col("node") == F.col("a"), "left").drop("a").join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").drop("at")
    named = save(all_.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"), "least"), "ego-named")
    for done in (points, pairs, found):
        drop(done)
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = named.join(ids, "root").select("k1", "k2", "n_links", "component_id")
    out = rows.join(final, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
