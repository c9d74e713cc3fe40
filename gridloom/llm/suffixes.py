"""Removal of byte strings that repeat, by a common-prefix-aware distributed merge sort of suffixes.

A string of LENGTH bytes that also starts earlier is removed. Each such string holds an anchor: the least hash of its
GRAM-byte windows, which its content alone decides, so equal strings have anchors at equal places, and only suffixes
at anchors are sorted. Those whose first GRAM bytes are found once cannot repeat; hashes find them out before anything
long is exchanged, as in prefix-doubling string sorts. The others, with all bytes before and after that a string of
LENGTH around them can hold, are sorted by each task into runs, front-coded (each key as the length of its common
prefix with the one before, and the rest), cut at splitters and merged by loser trees that compare only beyond known
common prefixes. Keys come out with their common prefixes, so equal keys (all but the earliest repeat) and groups of
equal grams (compared by how far they agree to both sides) are read off the merged order.

A slice of texts sends one key for all equal ones it has, and where there are more than RUNS runs, groups of them are
merged first, which leaves one key of equal ones in each group: so a passage in a third of all documents is a bounded
number of keys in the last merge. A group of grams that splitters cut is left to an exact aggregation of its strings' 128-bit hashes.

Defined cases: a null text is an empty one; documents under LENGTH bytes repeat nothing; ids may be of any type that
sorts; null ids come before all others and are one id; rows with one id and one text are the same document, none earlier than the other, and rows with one id and
different texts start at equal places, so that neither removes the other's string at the same start; an empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .skew import dealt
from .store import drop, free, save
from .words import encoded, slices

#: Fixed value of the contract: bytes of a string.
LENGTH = 100
#: Bytes of the window whose least hash is the anchor; windows in a string; the bytes that a key holds before it.
GRAM = 32
SPAN = LENGTH - GRAM + 1
BEFORE = SPAN - 1
KEY = LENGTH + BEFORE + 2
#: Bytes of text for each part of the first exchange.
PART = 16 << 20
#: Texts worked on at once; positions in a block of theirs; suffixes in a merge; keys for splitters at most.
SLICE, STRIDE, MERGE, SAMPLE = 4 << 20, 1 << 19, 150_000, 20_000
#: Runs in one merge.
RUNS = 100_000
#: Up to so many classes of a gram are compared pair by pair.
FEW = 12
NULL_ID = -(2**63)


# Anchors, in arrays over the joined bytes of a slice's documents.


def _windows(x: np.ndarray, size: int, fold) -> np.ndarray:
    """fold over x[i : i + size], by doubling."""
    n, have, out = len(x) - size + 1, 1, x
    while 2 * have <= size:
        out = fold(out[:-have], out[have:])
        have *= 2
    return fold(out[:n], out[size - have : size - have + n]) if have < size else out[:n]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """An odd 64-bit hash of every GRAM bytes."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    have = 1
    while have < GRAM:
        h = h[:-have] * np.uint64(0xD6E8FEB86659FD93 + 2 * have) + (h[have:] ^ (h[have:] >> np.uint64(29)))
        have *= 2
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(33))) | np.uint64(1)


def anchors(data: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By blocks: (at, hash, nearest, farthest): the anchors' places, and how far before them the strings that they anchor start.

    stops: where each document of the joined bytes ends. The strings start from at - farthest to at - nearest.
    """
    n = len(data)
    for a in range(0, n, STRIDE):
        b = min(a + STRIDE, n)
        lo, hi = max(0, a - BEFORE), min(n, b + BEFORE + GRAM - 1)
        if hi - lo < LENGTH:
            continue
        h = _gram_hashes(data[lo:hi])
        least = _windows(h, SPAN, np.minimum)  # of the string at lo + i
        first = np.searchsorted(stops, lo, "right")
        edges = np.minimum(stops[first : np.searchsorted(stops, lo + len(least), "right") + 1], lo + len(least)) - lo
        ends = np.repeat(stops[first : first + len(edges)], np.diff(edges, prepend=0))
        least[np.arange(lo, lo + len(least)) + LENGTH > ends] = 0
        # A place is an anchor if it has the least hash of some string around it.
        most = _windows(np.concatenate([np.zeros(BEFORE, np.uint64), least, np.zeros(BEFORE, np.uint64)]), SPAN, np.maximum)
        use = min(len(most), len(h))
        at = np.flatnonzero(most[:use] == h[:use])
        at = at[(at + lo >= a) & (at + lo < b)]
        padded = np.concatenate([np.zeros(BEFORE, np.uint64), least, np.zeros(SPAN, np.uint64)])
        near, far = np.empty(len(at), np.uint8), np.empty(len(at), np.uint8)
        for k in range(0, len(at), 8192):
            some = at[k : k + 8192]
            own = padded[some[:, None] + BEFORE - np.arange(SPAN)] == h[some][:, None]
            near[k : k + 8192] = own.argmax(axis=1)
            far[k : k + 8192] = SPAN - 1 - own[:, ::-1].argmax(axis=1)
        yield at + lo, h[at], near, far


def _joined(batch: pa.RecordBatch, texts: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [encoded(t) for t in batch.column(texts).to_pylist()]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts], dtype=np.int64)


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=[*columns])


# First exchange: which grams are found more than once.


def candidates(docs: DataFrame, parts: int) -> DataFrame:
    """(dk, places), a row for each document key: its anchors whose gram's hash is found elsewhere too."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, stops = _joined(batch, "text")
            ids = batch.column("dk").to_numpy()
            found = [(at, h) for at, h, _, _ in anchors(data, stops)]
            if not found:
                continue
            at, h = (np.concatenate(z) for z in zip(*found, strict=True))
            of = np.searchsorted(stops, at, "right")
            pos = (at - np.concatenate([[0], stops])[of]).astype(np.int64)
            h = (h * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h >> np.uint64(31))  # least hashes are all small: spread them
            order = np.argsort(h, kind="stable")
            h, owner, pos = h[order], ids[of[order]], pos[order]
            new = np.append(True, h[1:] != h[:-1])
            again = ~new | np.append(~new[1:], False)
            # What a slice itself has twice is settled; of all that it has, one of each hash goes on.
            yield grouped(home(owner[again]), -1, (h[:0], owner[again], pos[again], again[:0]))
            h, owner, pos, again = h[new], owner[new], pos[new], again[new]
            yield grouped((h % np.uint64(parts)).astype(np.int64), 1, (h, owner, pos, again))

    def home(owner: np.ndarray) -> np.ndarray:
        return (owner.view(np.uint64) % np.uint64(parts)).astype(np.int64)

    def grouped(to: np.ndarray, sign: int, columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        """A row for each part; parts of documents are counted below zero."""
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(parts + 1))
        full = [k for k in range(parts) if cuts[k] < cuts[k + 1]]
        pick = [order[cuts[k] : cuts[k + 1]] for k in full]
        blobs = ([z[p].tobytes() if len(z) else b"" for p in pick] for z in columns)
        return _rows({"part": ([k if sign > 0 else -1 - k for k in full], pa.int32())} | {c: (v, pa.binary()) for c, v in zip(("h", "dk", "pos", "again"), blobs, strict=True)})

    def meet(t: pa.Table) -> pa.Table:
        get = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
        h, owner, pos, again = get("h", np.uint64), get("dk", np.int64), get("pos", np.int64), get("again", np.bool_)
        order = np.argsort(h, kind="stable")
        h = h[order]
        same = h[1:] == h[:-1]
        twice = np.append(False, same) | np.append(same, False)
        keep = order[twice & ~again[order]]  # the slice has told of the others
        return pa.Table.from_batches([grouped(home(owner[keep]), -1, (h[:0], owner[keep], pos[keep], again[:0]))])

    def gather(t: pa.Table) -> pa.Table:
        owner, pos = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.int64) for c in ("dk", "pos"))
        order = np.argsort(owner, kind="stable")
        owner, pos = owner[order], pos[order]
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
        bounds = [*cuts, len(owner)]
        return pa.table({"dk": pa.array(owner[cuts], pa.int64()), "places": pa.array([pos[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())})

    schema = "part int, h binary, dk binary, pos binary, again binary"
    all_ = save(docs.select("dk", "text").mapInArrow(local, schema), "suffix-grams")
    met = all_.where("part >= 0").groupBy("part").applyInArrow(meet, schema)
    out = save(met.unionByName(all_.where("part < 0")).select("part", "dk", "pos").groupBy("part").applyInArrow(gather, "dk bigint, places binary"), "suffix-places")
    drop(all_)
    return out


# Sorted runs.


def keys(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(n, KEY): LENGTH bytes from at, BEFORE bytes before it backwards, and how many there are of both."""
    out = np.zeros((len(at), KEY), np.uint8)
    right, left = np.minimum(stops - at, LENGTH), np.minimum(at - starts, BEFORE)
    ahead = at[:, None] + np.arange(LENGTH)
    ok = np.arange(LENGTH) < right[:, None]
    out[:, :LENGTH][ok] = data[ahead[ok]]
    back = at[:, None] - 1 - np.arange(BEFORE)
    ok = np.arange(BEFORE) < left[:, None]
    out[:, LENGTH : LENGTH + BEFORE][ok] = data[back[ok]]
    out[:, -2], out[:, -1] = right, left
    return out


def merged_intervals(owner: np.ndarray, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals a to b, both included, of documents (owner, text), joined where they touch."""
    if not len(a):
        return owner, text, a, b
    order = np.lexsort((a, text, owner))
    owner, text, a, b = owner[order], text[order], a[order], b[order]
    same = (owner[1:] == owner[:-1]) & (text[1:] == text[:-1])
    group = np.cumsum(np.append(True, ~same))
    # Ends so far within the document: a running maximum that later documents start above.
    lift = group * (int(b.max()) + 2)
    reach = np.maximum.accumulate(b + lift) - lift
    new = np.append(True, ~(same & (a[1:] <= reach[:-1] + 1)))
    cuts = np.flatnonzero(new)
    return owner[cuts], text[cuts], a[cuts], np.maximum.reduceat(b, cuts)


RUN = "n int, ord binary, text binary, pos binary, near binary, far binary, lcp binary, rest binary, some array<binary>"


def _prefixes(k: np.ndarray) -> np.ndarray:
    """Of each sorted key with the one before; KEY for an equal one."""
    differ = k[1:] != k[:-1]
    return np.append(0, np.where(differ.any(axis=1), differ.argmax(axis=1), KEY)).astype(np.uint8)[: len(k)]


def squeezed(data: bytes) -> bytes:
    """The rests of a run's keys. Anchors of one text are near each other, so their keys share most of their bytes, far apart in the run."""
    import zstandard

    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(3, window_log=25, enable_ldm=False)).compress(data)


def unsqueezed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor(max_window_size=1 << 27).decompress(data)


def _decode(lcp: np.ndarray, rest: bytes) -> list[bytes]:
    out, prev, at = [], b"", 0
    for c in lcp.tolist():
        n = KEY - c
        prev = prev[:c] + rest[at : at + n]
        at += n
        out.append(prev)
    return out


def runs(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Sorted runs, a row each, and under n null the intervals of starts that a run itself shows to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, stops = _joined(batch, "text")
            starts = np.concatenate([[0], stops[:-1]])
            ids, texts = batch.column("ord").to_numpy(), batch.column("tx").to_numpy()
            wanted = np.zeros(len(data) + 1, bool)
            for s, e, blob in zip(starts, stops, batch.column("places").to_pylist(), strict=True):
                p = np.frombuffer(blob, np.int64)
                wanted[p[p < e - s] + s] = True
            found = [tuple(z[wanted[x[0]]] for z in x) for x in anchors(data, stops)]
            if not found:
                continue
            at, _, near, far = (np.concatenate(z) for z in zip(*found, strict=True))
            if not len(at):
                continue
            of = np.searchsorted(stops, at, "right")
            k, owner, text, pos = keys(data, starts[of], stops[of], at), ids[of], texts[of], at - starts[of]
            order = np.lexsort((text, pos, owner))
            order = order[np.argsort(k[order].view(f"S{KEY}")[:, 0], kind="stable")]
            k, owner, text, pos, near, far = (z[order] for z in (k, owner, text, pos, near, far))
            new = np.append(True, (k[1:] != k[:-1]).any(axis=1))
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            level = (owner == owner[head]) & (pos == pos[head])  # as early as the first: no repeat of it
            late = ~level
            if late.any():
                o, t, a, b = merged_intervals(owner[late], text[late], pos[late] - far[late], pos[late] - near[late])
                yield _rows({"n": ([None], pa.int32()), "ord": ([o.tobytes()], pa.binary()), "text": ([t.tobytes()], pa.binary()), "pos": ([a.tobytes()], pa.binary()), "near": ([b.tobytes()], pa.binary()), "far": ([None], pa.binary()), "lcp": ([None], pa.binary()), "rest": ([None], pa.binary()), "some": ([None], pa.list_(pa.binary()))})
            # Different texts with one id may be level; each distinct one is kept, next to its equal key.
            keep = level & np.append(True, new[1:] | (text[1:] != text[:-1]))
            k, owner, text, pos, near, far = (z[keep] for z in (k, owner, text, pos, near, far))
            lcp = _prefixes(k)
            rest = squeezed(k[np.arange(KEY) >= lcp[:, None]].tobytes())
            some = [k[i].tobytes() for i in np.linspace(0, len(k) - 1, min(len(k), 16)).astype(int)]
            yield _rows({"n": ([len(k)], pa.int32()), "ord": ([owner.tobytes()], pa.binary()), "text": ([text.tobytes()], pa.binary()), "pos": ([pos.tobytes()], pa.binary()), "near": ([near.tobytes()], pa.binary()), "far": ([far.tobytes()], pa.binary()), "lcp": ([lcp.tobytes()], pa.binary()), "rest": ([rest], pa.binary()), "some": ([some], pa.list_(pa.binary()))})

    return save(docs.select("dk", "ord", "tx", "text").join(places, "dk").mapInArrow(run, RUN), "suffix-runs")


def splitters(table: DataFrame, parts: int) -> list[bytes]:
    """parts - 1 keys between parts of about equal size, from at most SAMPLE keys."""
    some = table.where("n is not null").select(F.explode("some").alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE).collect()
    ranked = sorted(bytes(r.k) for r in some)
    return sorted({ranked[len(ranked) * i // parts] for i in range(1, parts)}) if ranked else []


PIECE = "part int, n int, ord binary, text binary, pos binary, near binary, far binary, lcp binary, rest binary"


def split(table: DataFrame, cuts: list[bytes]) -> DataFrame:
    """The runs cut at the splitters, with part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lcp = np.frombuffer(row["lcp"], np.uint8)
                rest = unsqueezed(row["rest"])
                k = _decode(lcp, rest)
                ends = np.append(0, np.cumsum(KEY - lcp.astype(np.int64)))
                bounds = [0, *(bisect.bisect_left(k, c) for c in cuts), len(k)]
                out: dict[str, list] = {c: [] for c in ("part", "n", "ord", "text", "pos", "near", "far", "lcp", "rest")}
                for part, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    if a == b:
                        continue
                    out["part"].append(part)
                    out["n"].append(b - a)
                    for c, width in (("ord", 8), ("text", 8), ("pos", 8), ("near", 1), ("far", 1)):
                        out[c].append(row[c][a * width : b * width])
                    out["lcp"].append(b"\0" + row["lcp"][a + 1 : b])  # the first key of a run is whole
                    out["rest"].append(squeezed(k[a] + rest[ends[a + 1] : ends[b]]))
                types = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
                yield _rows({c: (v, t) for (c, v), t in zip(out.items(), types, strict=True)})

    return table.where("n is not null").drop("some").mapInArrow(run, PIECE)


# The merge.


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix of two strings of one length, of which known bytes are known to agree."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return len(a) - (x.bit_length() + 7) // 8


def merge(lists: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix with the one before) of all keys in order, by a loser tree.

    Each contestant carries its common prefix with the last winner it met. The longer prefix is the smaller key; only
    equal ones are compared, beyond the prefix. A run's own coding gives its next key's prefix with the last winner.
    """
    width = 1 << max(0, (len(lists) - 1).bit_length())
    key: list[bytes | None] = [x[0][0] if x[0] else None for x in lists] + [None] * (width - len(lists))
    lcp, at, losers = [0] * width, [0] * width, [0] * width

    def beats(a: int, b: int) -> bool:
        """Whether a goes before b; the loser's prefix becomes that with the winner."""
        ka, kb = key[a], key[b]
        if ka is None or kb is None:
            return kb is None
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        c = common(ka, kb, lcp[a])
        won = a < b if c == len(ka) else ka[c] < kb[c]
        lcp[b if won else a] = c
        return won

    def play(node: int) -> int:
        if node >= width:
            return node - width
        a, b = play(2 * node), play(2 * node + 1)
        won = beats(a, b)
        losers[node] = b if won else a
        return a if won else b

    top = play(1)
    while key[top] is not None:
        yield top, at[top], lcp[top]
        at[top] += 1
        own, prefixes = lists[top]
        if at[top] < len(own):
            key[top], lcp[top] = own[at[top]], prefixes[at[top]]
        else:
            key[top] = None
        node = (top + width) // 2
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


def agreeing(k: list[bytes], lcp: list[int], rank: np.ndarray, near: np.ndarray, far: np.ndarray) -> list[tuple[int, int, int]]:
    """(which, d, d2): the strings starting d to d2 before the anchor of a key repeat one of lower rank.

    k: the distinct keys of one gram, in order; lcp: each with the one before.
    """
    out: list[tuple[int, int, int]] = []
    if len(k) <= FEW:
        for i, a in enumerate(k):
            for j, b in enumerate(k):
                if rank[j] >= rank[i]:
                    continue
                right = min(common(a[:LENGTH], b[:LENGTH]), a[-2], b[-2])
                left = min(common(a[LENGTH:-2], b[LENGTH:-2]), a[-1], b[-1])
                d, e = max(LENGTH - right, int(near[i])), min(left, int(far[i]))
                if d <= e:
                    out.append((i, d, e))
        return out
    table = np.frombuffer(b"".join(k), np.uint8).reshape(len(k), KEY)
    prefix = np.array(lcp)
    prefix[0] = 0
    back = np.ascontiguousarray(table[:, LENGTH:-2])
    order = np.argsort(back.view(f"S{BEFORE}")[:, 0], kind="stable")
    diff = back[order][1:] != back[order][:-1]
    shared = np.append(0, np.where(diff.any(axis=1), diff.argmax(axis=1), BEFORE))
    hit = np.zeros((len(k), SPAN), bool)
    for d in range(SPAN):
        ok = (table[:, -2] >= LENGTH - d) & (table[:, -1] >= d)
        mine = ok & (near <= d) & (d <= far)
        if not mine.any():
            continue
        left = np.empty(len(k), np.int64)
        left[order] = np.cumsum(shared < d)
        code = np.cumsum(prefix < LENGTH - d) * (len(k) + 1) + left
        some = np.flatnonzero(ok)
        some = some[np.lexsort((rank[some], code[some]))]
        head = np.append(True, code[some][1:] != code[some][:-1])
        least = rank[some[np.flatnonzero(head)]][np.cumsum(head) - 1]
        hit[some, d] = rank[some] > least
        hit[:, d] &= mine
    for i in np.flatnonzero(hit.any(axis=1)):
        on = np.flatnonzero(hit[i])
        cuts = np.flatnonzero(np.diff(on) > 1)
        out += [(int(i), int(on[a]), int(on[b])) for a, b in zip([0, *(cuts + 1)], [*cuts, len(on) - 1], strict=True)]
    return out


class Pile:
    """The runs of one part, to be merged."""

    def __init__(self, t: pa.Table):
        self.part = t.column("part")[0].as_py()
        cols = {c: [np.frombuffer(x, kind) for x in t.column(c).to_pylist()] for c, kind in (("ord", np.int64), ("text", np.int64), ("pos", np.int64), ("near", np.uint8), ("far", np.uint8), ("lcp", np.uint8))}
        self.base = np.append(0, np.cumsum([len(x) for x in cols["ord"]]))
        self.lists = [(_decode(c, unsqueezed(r)), c.tolist()) for c, r in zip(cols["lcp"], t.column("rest").to_pylist(), strict=True)]
        self.owner, self.text, self.pos, self.near, self.far = (np.concatenate(cols[c]) for c in ("ord", "text", "pos", "near", "far"))
        self.rank = np.empty(len(self.owner), np.int64)
        order = np.lexsort((self.pos, self.owner))
        o, p = self.owner[order], self.pos[order]
        self.rank[order] = np.cumsum(np.append(True, (o[1:] != o[:-1]) | (p[1:] != p[:-1])))

    def keys(self) -> Iterator[tuple[bytes, int, list[int]]]:
        """(key, common prefix with the one before, entries) of each distinct key, in order."""
        now: tuple[bytes, int, list[int]] | None = None
        for r, i, c in merge(self.lists):
            e = int(self.base[r]) + i
            if c == KEY and now:
                now[2].append(e)
                continue
            if now:
                yield now
            now = (self.lists[r][0][i], c, [e])
        if now:
            yield now

    def parted(self, entries: list[int]) -> tuple[list[int], list[int]]:
        """The entries of one key that are as early as the earliest, and the others."""
        least = min(self.rank[e] for e in entries)
        return [e for e in entries if self.rank[e] == least], [e for e in entries if self.rank[e] > least]

    def spans(self, late: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
        """Intervals of starts from (entry, d, d2)."""
        e, d, d2 = (np.array([x[j] for x in late], np.int64) for j in range(3))
        return merged_intervals(self.owner[e], self.text[e], self.pos[e] - d2, self.pos[e] - d)


def combined(pieces: DataFrame, groups: int) -> DataFrame:
    """The pieces of each part merged into one for each of the groups that they are dealt to; under n null, intervals that repeat."""

    def run(t: pa.Table) -> pa.Table:
        pile = Pile(t)
        kept, lcp, rest, late = [], [], [], []
        for key, c, entries in pile.keys():
            level, others = pile.parted(entries)
            late += [(e, pile.near[e], pile.far[e]) for e in others]
            kept += level
            lcp += [c, *[KEY] * (len(level) - 1)]
            rest.append(key[c:])
        k = np.array(kept, np.int64)
        lcp[0] = 0
        o, x, a, b = pile.spans(late)
        each = lambda p, q: ([p.tobytes(), q.tobytes() if q is not None else None], pa.binary())
        rows = {"part": ([pile.part] * 2, pa.int32()), "n": ([len(k), None], pa.int32()), "ord": each(pile.owner[k], o), "text": each(pile.text[k], x), "pos": each(pile.pos[k], a), "near": each(pile.near[k], b), "far": each(pile.far[k], None)}
        return pa.Table.from_batches([_rows(rows | {"lcp": each(np.array(lcp, np.uint8), None), "rest": ([squeezed(b"".join(rest)), None], pa.binary())})])

    dealt_ = pieces.withColumn("grp", F.pmod(F.xxhash64("ord", "pos"), F.lit(groups)))
    return save(dealt_.groupBy("part", "grp").applyInArrow(lambda t: run(t.drop_columns(["grp"])), PIECE), "suffix-combined")


FOUND = "ord bigint, text bigint, a bigint, b bigint, h1 bigint, h2 bigint"


def repeats(parts: DataFrame, cuts: list[bytes]) -> DataFrame:
    """(ord, text, a, b, h1, h2): with null hashes, intervals of starts that repeat; else single starts with the string's hash."""

    def run(t: pa.Table) -> pa.Table:
        from xxhash import xxh3_128_intdigest

        pile = Pile(t)
        late: list[tuple[int, int, int]] = []
        open_: list[tuple[int, bytes]] = []
        shut = {c[:GRAM] for c in cuts[max(0, pile.part - 1) : pile.part + 1]}
        rank, owner, text, pos, near, far = pile.rank, pile.owner, pile.text, pile.pos, pile.near, pile.far

        def close(group: list[tuple[bytes, int, list[int]]]) -> None:
            """group: the distinct keys of one gram."""
            heads, k, prefix = [], [], []
            for key, c, entries in group:
                level, others = pile.parted(entries)
                late.extend((e, near[e], far[e]) for e in others)
                for n, e in enumerate(level):  # level entries of different texts each go on
                    heads.append(e)
                    k.append(key)
                    prefix.append(KEY if n else c)
            if not group:
                return
            if group[0][0][:GRAM] in shut:
                open_.extend(zip(heads, k, strict=True))
            elif len(group) > 1:
                late.extend((heads[i], d, e) for i, d, e in agreeing(k, prefix, rank[heads], near[heads], far[heads]))

        group: list[tuple[bytes, int, list[int]]] = []
        for key, c, entries in pile.keys():
            if c < GRAM:
                close(group)
                group = []
            group.append((key, c, entries))
        close(group)
        o, x, a, b = pile.spans(late)
        each = [(n, d, xxh3_128_intdigest((k[LENGTH:-2][::-1] + k[:LENGTH])[BEFORE - d : BEFORE - d + LENGTH])) for n, k in open_ for d in range(int(near[n]), int(far[n]) + 1)]
        n, s = np.array([z[0] for z in each], np.int64), np.array([z[1] for z in each], np.int64)
        h1, h2 = (np.array([z[2] >> shift & (1 << 64) - 1 for z in each], np.uint64).view(np.int64) for shift in (0, 64))
        start = pos[n] - s
        none = pa.nulls(len(o), pa.int64())
        cat = lambda p, q: pa.concat_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64())])
        return pa.table({"ord": cat(o, owner[n]), "text": cat(x, text[n]), "a": cat(a, start), "b": cat(b, start), "h1": cat(none, h1), "h2": cat(none, h2)})

    return save(parts.groupBy("part").applyInArrow(run, FOUND), "suffix-repeats")


def intervals(tables: list[DataFrame], found: DataFrame) -> DataFrame:
    """(ord, text, a, b): all intervals of starts that repeat, those that tables hold under n null and those found."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _rows({c: (np.frombuffer(row[k], np.int64), pa.int64()) for c, k in (("ord", "ord"), ("text", "text"), ("a", "pos"), ("b", "near"))})

    told = reduce(DataFrame.unionByName, (t.where("n is null").select("ord", "text", "pos", "near") for t in tables))
    own = told.mapInArrow(local, "ord bigint, text bigint, a bigint, b bigint")
    hashed = found.where("h1 is not null")
    least = hashed.groupBy("h1", "h2").agg(F.min(F.struct("ord", "a")).alias("least"))
    later = dealt(hashed, least, ["h1", "h2"], "inner").where(F.struct("ord", "a") > F.col("least")).select("ord", "text", "a", "b")
    return own.unionByName(found.where("h1 is null").select("ord", "text", "a", "b")).unionByName(later)


def kept(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) from docs (doc_id, ord, tx, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, removed, rest, at, count = encoded(text), 0, [], 0, 0
                for a, b in sorted((s["a"], s["b"] + LENGTH) for s in spans or ()):
                    if a > at or not count:
                        rest.append(data[at:a])
                        count += 1
                        removed += b - a
                    elif b > at:
                        removed += b - at
                    at = max(at, b)
                rest.append(data[at:])
                out.append((len(data), removed, count, hashlib.sha256(b"".join(rest)).hexdigest()))
            cols = [*zip(*out, strict=True)]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    lists = gone.groupBy("ord", "text").agg(F.collect_list(F.struct("a", "b")).alias("spans")).withColumnRenamed("text", "tx")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.join(lists, ["ord", "tx"], "left").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def placed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, tx, text) with ord, a long in the order of doc_id, nulls first, and dk, a key of (ord, tx)."""
    kind = docs.schema["doc_id"].dataType
    if kind.typeName() in ("byte", "short", "integer", "long"):
        out = docs.withColumn("ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    else:
        n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        ids = docs.select(F.col("doc_id").alias("id")).where("id is not null").distinct()
        ranks = save(ids.repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("ord", F.monotonically_increasing_id()), "suffix-ids")
        out = docs.join(ranks, F.col("doc_id") == F.col("id"), "left").drop("id").withColumn("ord", F.coalesce("ord", F.lit(NULL_ID)))
    return out.withColumn("dk", F.xxhash64("ord", "tx"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its bytes, how many of them repeat, in how many runs, and the hash of the others."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = placed(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tx"), text.alias("text")))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    places = candidates(rows, 1 + size // PART)
    free(spark)
    table = runs(rows, places)
    drop(places)
    free(spark)
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cuts = splitters(table, max(1, -(-total // MERGE)))
    pieces, tables = split(table, cuts), [table]
    groups = -(-table.where("n is not null").count() // RUNS)
    if groups > 1:
        pieces = combined(pieces, groups)
        tables.append(pieces)
    found = repeats(pieces.where("n is not null"), cuts)
    gone = save(intervals(tables, found), "suffix-intervals")
    for done in tables:
        drop(done)
    drop(found)
    free(spark)
    return kept(rows, gone)


def query(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
