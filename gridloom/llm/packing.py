"""Best-fit packing of token sequences after dominance reduction.

Lengths are whole numbers up to the capacity, so the whole instance is a histogram of at most CAPACITY counts, however
many documents there are; the driver sees only that. Martello and Toth's reduction fixes bins that no other way to
pack their largest item can beat, for as many copies at once as the counts allow; what is left is packed best fit,
longest first, again whole counts at a time. The outcome is a short list of bin patterns. Each piece finds its place
from its rank among the pieces of its length, which is its rank in its task plus the tasks' counts before.

Defined cases: a null text is an empty one, which is its end token alone; a text of any length is encoded whole, by
itself if it is long; repeated rows are packed each; a null id is carried through; other columns are not read; an empty
table packs nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .store import save
from .tokens import encoder
from .words import slices

#: Fixed values of the contract: tokens in a sequence, the id that ends a document.
CAPACITY, END = 1024, 2

#: A bin pattern: its lengths, and how many bins have it.
Pattern = tuple[tuple[int, ...], int]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# The plan: on the driver, over the histogram.


def reduce(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Bins fixed by dominance; counts[n] is lowered by what they take."""
    fixed: list[Pattern] = []

    def fix(items: tuple[int, ...], times: int) -> None:
        fixed.append((items, times))
        for x in items:
            counts[x] -= times

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j]:
                bin_ = _dominant(counts, j, capacity)
                if bin_ is None:
                    break
                copies = min(int(counts[x]) // bin_.count(x) for x in set(bin_))
                # With all but one copy gone what fits may change; it is looked at again then.
                fix(bin_, copies if len(bin_) < 3 else max(1, copies - 1))
                changed = True
    return fixed


def _dominant(counts: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with j that dominates every feasible set with j, if one of at most three items does."""
    room = capacity - j
    there = np.flatnonzero(counts[: room + 1])
    free = counts[there] - (there == j)
    there, free = there[free > 0], free[free > 0]
    if not len(there):
        return (j,)
    widest = int(there[-1])
    if widest == room:
        return (j, widest)
    # Two more items: for each, the largest partner that still fits.
    partner = np.searchsorted(there, room - there, side="right") - 1
    same = (partner == np.arange(len(there))) & (free < 2)
    partner = np.where(same, partner - 1, partner)
    ok = partner >= 0
    if not ok.any():
        return (j, widest)
    sums = there[ok] + there[partner[ok]]
    if sums.max() <= widest:
        return (j, widest)
    least = np.repeat(there[:3], np.minimum(free[:3], 3))[:3]
    if len(least) == 3 and least.sum() <= room:
        return None
    a = int(np.maximum(there[ok], there[partner[ok]]).max())
    b = int(np.minimum(there[ok], there[partner[ok]]).max())
    if a + b <= room and widest <= a and (a != b or free[np.searchsorted(there, a)] >= 2):
        return (j, a, b)
    return None


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Best fit, longest first; as many bins at a time as are alike."""
    open_: dict[int, list[list]] = {}  # room -> [items, bins]

    def put(items: tuple[int, ...], bins: int) -> None:
        if bins:
            open_.setdefault(capacity - sum(items), []).append([items, bins])

    for n in range(capacity, 0, -1):
        left = int(counts[n])
        while left:
            room = min((r for r in open_ if r >= n), default=None)
            if room is None:
                per = capacity // n
                put((n,) * per, left // per)
                put((n,) * (left % per), int(left % per > 0))
                break
            items, bins = open_[room].pop()
            if not open_[room]:
                del open_[room]
            per = room // n
            full = min(bins, left // per)
            put(items + (n,) * per, full)
            left -= full * per
            bins -= full
            if bins and left:  # fewer than per are left
                put(items + (n,) * left, 1)
                left, bins = 0, bins - 1
            put(items, bins)
    return [(items, bins) for group in open_.values() for items, bins in group]


def pack(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    rest = counts.astype(np.int64).copy()
    return reduce(rest, capacity) + best_fit(rest, capacity)


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, copies in a bin, first bin, offset), sorted; a rank's row is the last that isn't above it."""
    rows, used, base = [], {}, 0
    for items, bins in patterns:
        at = 0
        for n in dict.fromkeys(items):
            per = items.count(n)
            rows.append((n, used.get(n, 0), per, base, at))
            used[n] = used.get(n, 0) + per * bins
            at += per * n
        base += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# The pieces: on the workers.


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, place): place is the rank among the task's pieces of that length."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text"):
            src, out = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode.ids(text) if text else np.empty(0, np.uint32), np.uint32(end)).astype("<u4")
                stops = [*range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (start, stop) in enumerate(zip([0, *stops], stops, strict=False)):
                    n = stop - start
                    out.append((k, start, n, zlib.crc32(ids[start:stop].tobytes()), task, seen[n]))
                    seen[n] += 1
                    src.append(row)
            cols = zip(*out, strict=True) if out else [()] * 6
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(src, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, place bigint")


def place(table: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """The pieces with sequence_id and offset."""
    grid = slots(patterns)
    ahead = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = table.groupBy("task", "length").agg(F.count("*").alias("n")).select("task", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    ranked = table.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = {int(n): np.searchsorted(grid[:, 0], n) for n in np.unique(grid[:, 0])}
        last = {int(n): np.searchsorted(grid[:, 0], n, "right") for n in first}
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.empty(len(n), np.int64)
            for x in np.unique(n):
                on, lo, hi = n == x, first[int(x)], last[int(x)]
                at[on] = lo + np.searchsorted(grid[lo:hi, 1], rank[on], "right") - 1
            inside, per = rank - grid[at, 1], grid[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(grid[at, 3] + inside // per), pa.array(grid[at, 4] + inside % per * n)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def packed(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece of each document, and its place. path: the vocabulary file, at the same place on every machine."""
    table = save(pieces(docs, path or vocabulary(), id_col, text_col, capacity, end), "pack-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in table.groupBy("length").count().collect():  # at most capacity rows
        counts[r.length] = r["count"]
    return place(table, pack(counts, capacity))


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
