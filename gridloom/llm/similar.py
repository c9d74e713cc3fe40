"""Near-duplicates by the similarity of shingle sets: all pairs whose Jaccard similarity is at least SIMILARITY, exactly.

Candidates come from SimHash balls first (simhash.links, over fingerprints of the sets), and are checked exactly. No
radius that balls of 64 bits can afford reaches all pairs of that similarity, whose fingerprints differ in ten bits on
average; what they leave apart is found by prefixes. Two sets as similar as a fraction t share one of their first n - ceil(t n) + 1 shingles, n being a set's own size, in
any order that all sets keep. Here that order is by hash, with shingles of many sets last, so that few sets meet in one;
sets that meet in one of those are told of their least by an aggregation, not gathered. What meets is linked to the
least set of those that met, by an exact check; of these pairs, bitmaps of the first shingles tell most that can't be
similar, by what one surely has and the other has not, and sets are exchanged for the rest only. Sets that this leaves
in different components are compared pair by pair where at most COMMON of them meet in a shingle, so that pairs are in
proportion to places.

Sets that meet in larger numbers and are still in different components lie in blocks of a bounded number of shingles, those with a shingle
in common side by side. For each two blocks in which a shingle's sets lie, one task gets these sets, counts what they
share by products of bit matrices, and returns a forest over their components, so that no pair becomes a row. Work on a
large group of near copies still goes by the square of its size, in sums of bits, and exchange by its size times the number of its blocks.

Defined cases: words are those of simhash; a text of fewer words than a shingle is one shingle; a null text is an empty
one, and texts without words are copies of each other; equal sets are one; an empty table gives no rows; a set of more
shingles than a block holds is a block by itself. Sets are told apart by 64 bits of hash, shingles too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import simhash
from .components import components
from .store import drop, free, fresh, save
from .words import encoded, slices

#: Words of a shingle; the least similarity, a fraction.
SHINGLE, SIMILARITY = 5, (4, 5)

#: Shingles that begin more than COMMON sets come last, the LISTED most frequent of them: this orders, and leaves nothing out.
COMMON, LISTED = 16, 50_000

#: Words of 64 bits in a bitmap; pairs whose sets are exchanged at once.
WORDS, BATCH = 8, 100_000

#: Shingles in a block, each set counting OWN more; copies of the sets in blocks that are exchanged at once.
BLOCK, OWN, COPIES = 1 << 18, 64, 1

_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, length: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    from xxhash import xxh64_intdigest

    words = encoded(text).lower().split()
    if not words:
        return np.zeros(0, np.int64)
    w = np.array([xxh64_intdigest(x) for x in words], np.uint64)
    n = min(length, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h = h * _MUL + w[k : k + len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set of hashes: the bits that over half of them have; signed."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(own), 1 << 14):
        total += np.unpackbits(own[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(own), bitorder="little").view("<i8")[0])


def bitmap(own: np.ndarray) -> np.ndarray:
    """The bits that the hashes set, of 64 * WORDS."""
    on = np.zeros(64 * WORDS, bool)
    on[own & (64 * WORDS - 1)] = True
    return np.packbits(on).view(np.int64)


def _key(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(own.tobytes())).view(np.int64))


def _sets(docs: DataFrame, common: np.ndarray | None, part: str, length: int, similarity: tuple[int, int]) -> DataFrame:
    """(doc_id, digest, key, fp, n, rare, last, bits, own) of docs with doc_id, digest and text. part: what own holds of a set, its first shingles or all."""
    t, u = similarity
    by = None if common is None else np.argsort(common)

    def first(own: np.ndarray) -> tuple[np.ndarray, int, int]:
        """The first shingles, how many of them are not common, and the place of the last of them among the common ones."""
        most = len(own) - -(-len(own) * t // u) + 1
        if by is None or not len(common) or not len(own):
            return own[:most], min(most, len(own)), 0
        at = np.minimum(np.searchsorted(common, own, sorter=by), len(common) - 1)
        rank = np.where(common[by[at]] == own, by[at] + 1, 0)
        order = np.argsort(rank, kind="stable")[:most]
        return own[order], min(most, int((rank == 0).sum())), int(rank[order[-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            sets = [shingles(x, length) for x in batch.column("text").to_pylist()]
            kept, rare, last = (sets, [0] * len(sets), [0] * len(sets)) if part == "all" else zip(*map(first, sets), strict=True)
            bits = pa.array([None if part == "all" else bitmap(s) for s in kept], pa.list_(pa.int64()))
            own = pa.ListArray.from_arrays(np.cumsum([0, *map(len, kept)], dtype=np.int32), np.concatenate(kept))
            fp = pa.array([None if part == "all" else fingerprint(s) for s in sets], pa.int64())
            cols = [batch.column("doc_id"), batch.column("digest"), pa.array([_key(s) for s in sets], pa.int64()), fp, pa.array([len(s) for s in sets], pa.int64()), pa.array(rare, pa.int32()), pa.array(last, pa.int32()), bits, own]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "key", "fp", "n", "rare", "last", "bits", "own"])

    rows = docs.select("doc_id", "digest", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest bigint, key bigint, fp bigint, n bigint, rare int, last int, bits array<bigint>, own array<bigint>")


def balls(table: DataFrame) -> DataFrame:
    """(a, b): candidates from a saved table of (key, fp): a set of each fingerprint with its others and with those in its balls."""
    least = save(table.groupBy("fp").agg(F.min("key").alias("least")), "similar-fps")
    same = table.select("key", "fp").join(least, "fp").where("key != least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    near = simhash.links(least.select("fp")).join(least.select(F.col("fp").alias("a"), F.col("least").alias("la")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("lb")), "b")
    out = save(same.unionByName(near.select(F.col("la").alias("a"), F.col("lb").alias("b"))).distinct(), "similar-balls")
    drop(least)
    free(table.sparkSession)
    return out


def _similar(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar."""
    t, u = similarity
    left, right = (sets.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("own").alias(f"own{k}")) for k in "ab")
    shared = F.size(F.array_intersect("owna", "ownb"))
    return pairs.join(left, "a").join(right, "b").where(shared * (t + u) >= t * (F.col("na") + F.col("nb"))).select("a", "b")


def _may(similarity: tuple[int, int]):
    """Whether sets of na and nb shingles can be similar whose first common shingle is at the places ia and ib."""
    t, u = similarity
    na, nb, ia, ib = map(F.col, ("na", "nb", "ia", "ib"))
    return F.least(na - ia, nb - ib) * (t + u) >= t * (na + nb)


def _likely(pairs: DataFrame, facts: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) that can be similar, by facts (key, n, firsts, last, end, bits).

    What two sets share is among the firsts of both, or comes after the end of those that end first. And a bit that
    only one of them sets stands for a first shingle at least that the other's firsts don't hold.
    """
    t, u = similarity
    for k in "ab":
        pairs = pairs.join(facts.select(F.col("key").alias(k), *(F.col(c).alias(c + k) for c in ("n", "firsts", "end", "bits"))), k)
    only = lambda p, q: reduce(lambda x, y: x + y, (F.bit_count(F.get(f"bits{p}", F.lit(w)).bitwiseAND(F.bitwise_not(F.get(f"bits{q}", F.lit(w))))) for w in range(WORDS)))
    shared = F.least(F.col("firstsa") - only("a", "b"), F.col("firstsb") - only("b", "a"))
    rest = F.when(F.col("enda") <= F.col("endb"), F.col("na") - F.col("firstsa")).otherwise(F.col("nb") - F.col("firstsb"))
    return pairs.where((shared + rest) * (t + u) >= t * (F.col("na") + F.col("nb"))).select("a", "b")


def meetings(distinct: DataFrame) -> DataFrame:
    """(x, key, n, i, least): the places of shingles that are first ones of two sets or more, and of each the least set's own place.

    Shingles that are not listed as common begin few sets and are put side by side by a window; the least sets of the
    at most LISTED others are aggregated before they are exchanged, and broadcast.
    """
    places = distinct.select("key", "n", "rare", F.posexplode("own").alias("i", "x"))
    place, columns = F.struct("key", "n", "i"), ["x", "key", "n", "i", "least"]
    side = Window.partitionBy("x").orderBy("key")
    few = places.where("i < rare").select("x", "key", "n", "i").withColumns({"least": F.first(place).over(side), "more": F.lead("key").over(side)})
    few = few.where(F.col("more").isNotNull() | (F.col("key") != F.col("least.key")))
    many = places.where("i >= rare")
    least = many.groupBy("x").agg(F.min(place).alias("least"), F.count("*").alias("met")).where("met > 1").select("x", "least")
    return few.select(*columns).unionByName(many.join(F.broadcast(least), "x").select(*columns))


def mixed(met: DataFrame, edges: DataFrame) -> DataFrame:
    """(x, key, n, i, root), saved: the places of shingles in which sets of several components meet."""
    rooted = save(met.join(components(edges), F.col("key") == F.col("node"), "left").select("x", "key", "n", "i", F.coalesce("root", "key").alias("root")), "similar-rooted")
    several = rooted.groupBy("x").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("x")
    out = save(rooted.join(several, "x", "left_semi"), "similar-mixed")
    drop(rooted)
    return out


def crowded(places: DataFrame) -> DataFrame:
    """(x, crowd): whether more than COMMON sets of mixed() places meet in x."""
    return places.groupBy("x").agg((F.count("*") > COMMON).alias("crowd"))


def paired(places: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): sets of mixed() places that meet where few do, may be similar and have different roots."""
    few = places.join(crowded(places).where("not crowd"), "x", "left_semi")
    a, b = (few.select("x", F.col("key").alias(k), *(F.col(c).alias(c + k) for c in ("n", "i", "root"))) for k in "ab")
    return a.join(b, "x").where((F.col("a") < F.col("b")) & (F.col("roota") != F.col("rootb")) & _may(similarity)).select("a", "b")


def blocks(places: DataFrame) -> DataFrame:
    """(key, n, root, block), saved: the sets of mixed() places, in blocks of at most BLOCK shingles, by their least shared shingle and size."""
    sets = places.groupBy("key").agg(F.min("n").alias("n"), F.min("root").alias("root"), F.min("x").alias("label"))
    ordered = sets.repartitionByRange("label", "n", "key").sortWithinPartitions("label", "n", "key").select("key", "n", "root", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = 0
        for batch in batches:
            ends = upto + np.cumsum(batch.column("n").to_numpy() + OWN)
            yield batch.append_column("end", pa.array(ends, pa.int64()))
            upto = int(ends[-1]) if len(ends) else upto

    run_of = save(ordered.mapInArrow(run, "key bigint, n bigint, root bigint, part int, end bigint"), "similar-ordered")
    totals = sorted(run_of.groupBy("part").agg(F.max("end").alias("total")).collect())
    starts = np.cumsum([0, *(r.total for r in totals)])
    offsets = run_of.sparkSession.createDataFrame([(r.part, int(s)) for r, s in zip(totals, starts, strict=False)], "part int, offset long")
    return run_of.join(F.broadcast(offsets), "part").select("key", "n", "root", F.floor((F.col("offset") + F.col("end") - 1) / BLOCK).alias("block"))


def touching(placed: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(x, a, b): blocks a <= b and a shingle x of placed (x, key, n, i, root, block) in which sets of both meet that may be similar and apart."""
    t, u = similarity
    each = placed.groupBy("x", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("i")).alias("rest"), F.min("root").alias("least"), F.max("root").alias("most"))
    a, b = (each.select("x", *(F.col(c).alias(c + k) for c in each.columns[1:])) for k in "ab")
    near = (F.col("hia") * u >= F.col("lob") * t) & (F.col("hib") * u >= F.col("loa") * t) & (F.least("resta", "restb") * (t + u) >= t * (F.col("loa") + F.col("lob")))
    several = F.least("leasta", "leastb") != F.greatest("mosta", "mostb")
    return a.join(b, "x").where((F.col("blocka") <= F.col("blockb")) & near & several).select("x", F.col("blocka").alias("a"), F.col("blockb").alias("b"))


def shared(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], rows: int, cols: int, words: int) -> np.ndarray:
    """How many of the shingles 0 .. words - 1 each of rows sets shares with each of cols sets. A side: (set, shingle) of its entries, by shingle.

    Shingles of many sets are columns of bit matrices, which are multiplied; those of few are paired up.
    """
    (i, x), (j, y) = left, right
    l, r = np.bincount(x, minlength=words), np.bincount(y, minlength=words)
    out = np.zeros((rows, cols), np.float32)
    heavy = l * r * 64 > rows * cols
    for many in np.array_split(np.flatnonzero(heavy), max(1, -(-int(heavy.sum()) // 2048))):
        col = np.full(words, -1)
        col[many] = np.arange(len(many))
        sides = []
        for which, at, size in ((i, x, rows), (j, y, cols)):
            bits = np.zeros((size, len(many)), np.float32)
            on = col[at] >= 0
            bits[which[on], col[at[on]]] = 1
            sides.append(bits)
        out += sides[0] @ sides[1].T
    light = np.flatnonzero(~heavy[x] & (r[x] > 0))
    first, each = np.cumsum(r) - r, r[x[light]]
    for part in np.split(light, np.flatnonzero(np.diff(np.cumsum(each) >> 20)) + 1):
        n = r[x[part]]
        at = np.repeat(first[x[part]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        np.add.at(out.reshape(-1), np.repeat(i[part] * cols, n) + j[at], 1)
    return out


def joined(p: np.ndarray, q: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The least node of each node's component, by links p, q and by least, which such links gave before."""
    while len(p):
        low = np.minimum(least[p], least[q])
        now = least.copy()
        for at in (p, q, least[p], least[q]):
            np.minimum.at(now, at, low)
        now = now[now]
        if (now == least).all():
            break
        least = now
    return least


def forest(table: pa.Table, similarity: tuple[int, int]) -> pa.Table:
    """(a, b): roots that similar sets of the two blocks a and b of table (a, b, block, root, n, own) join; at most one row for each root."""
    t, u = similarity
    block, root, n = (table.column(c).to_numpy() for c in ("block", "root", "n"))
    own = table.column("own").combine_chunks()
    which = np.repeat(np.arange(len(n)), np.diff(own.offsets.to_numpy()))
    x, at = np.unique(own.flatten().to_numpy(), return_inverse=True)
    order = np.argsort(at, kind="stable")
    which, at = which[order], at[order]
    names, node = np.unique(root, return_inverse=True)
    sides = [np.flatnonzero(block == table.column(k)[0].as_py()) for k in "ab"]
    least = np.arange(len(names))

    def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.full(len(n), -1)
        place[rows] = np.arange(len(rows))
        on = place[which] >= 0
        return place[which[on]], at[on]

    right = entries(sides[1])
    for start in range(0, len(sides[0]), 1024):
        rows = sides[0][start : start + 1024]
        count = shared(entries(rows), right, len(rows), len(sides[1]), len(x)).astype(np.int64)
        mine, other = least[node[rows]], least[node[sides[1]]]
        i, j = np.nonzero((count * (t + u) >= t * (n[rows][:, None] + n[sides[1]])) & (mine[:, None] != other))
        least = joined(mine[i], other[j], least)
    moved = np.flatnonzero(least != np.arange(len(names)))
    return pa.table({"a": pa.array(names[moved], pa.int64()), "b": pa.array(names[least[moved]], pa.int64())})


def apart(places: DataFrame, made, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): links that join all sets of mixed() places that are similar and have different roots; places are dropped. made: gives a saved (key, n, own) of the sets that a table names by key."""
    spark = places.sparkSession
    members = save(blocks(places), "similar-blocks")
    placed = save(places.join(members.select("key", "block"), "key"), "similar-placed")
    ends = touching(placed, similarity).select("x", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    rows = save(ends.join(placed.select("x", "block", "key"), ["x", "block"]).select("a", "b", "block", "key").distinct(), "similar-sides")
    drop(placed)
    drop(places)
    free(spark)
    sets = made(rows.select("key").distinct())
    held = save(sets.join(members.select("key", "root"), "key"), "similar-held")
    drop(sets)
    size = held.agg(F.sum(F.col("n") + OWN)).first()[0] or 0
    moved = rows.join(held.select("key", "n"), "key").agg(F.sum(F.col("n") + OWN)).first()[0] or 0
    parts = max(1, -(-moved // max(1, COPIES * size)))
    links = []
    for k in range(parts):
        some = rows.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == k).join(held, "key").select("a", "b", "block", "root", "n", "own")
        links.append(save(some.groupBy("a", "b").applyInArrow(lambda table: forest(table, similarity), "a bigint, b bigint"), "similar-links"))
        free(spark)
    for done in (members, rows, held):
        drop(done)
    return reduce(DataFrame.unionByName, links)


def listed(firsts: DataFrame) -> np.ndarray:
    """The most frequent first shingles, rarest first: of those that begin more than COMMON sets at most LISTED, down to a count that a histogram tells."""
    counts = firsts.dropDuplicates(["key"]).select(F.explode("own").alias("x")).groupBy("x").count().where(F.col("count") > COMMON)
    counts = save(counts.withColumn("level", F.floor(8 * F.log2("count"))), "similar-common")
    room, least = LISTED, None
    for level, n in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
        room -= n
        if room < 0:
            break
        least = level
    out = [] if least is None else counts.where(F.col("level") >= least).collect()
    drop(counts)
    return np.array([r.x for r in sorted(out, key=lambda r: (r["count"], -r.x))], np.int64)


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, digest, key, root) for every row: digest is a hash of the text, key of its set; rows of a component share root."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    common = listed(_sets(docs, None, "first", length, similarity))
    whole = save(_sets(docs, common, "first", length, similarity), "similar-firsts")
    free(docs.sparkSession)
    table = save(whole.select("doc_id", "digest", "key", "fp"), "similar-rows")
    distinct = save(whole.dropDuplicates(["key"]).select("key", "n", "rare", "last", "bits", "own"), "similar-distinct")
    drop(whole)
    free(docs.sparkSession)
    near = balls(table)
    met = save(meetings(distinct), "similar-met")
    end = F.struct("last", F.coalesce(F.get("own", F.size("own") - 1), F.lit(0)).alias("x")).alias("end")
    facts = save(distinct.select("key", "n", F.size("own").alias("firsts"), end, "bits"), "similar-facts")
    drop(distinct)
    free(docs.sparkSession)

    def made(keys: DataFrame) -> DataFrame:
        """(key, n, own), saved: the whole sets of the distinct keys, made again, each from one text."""
        texts = table.select("key", "digest").join(keys, "key", "left_semi").groupBy("key").agg(F.min("digest").alias("digest")).select("digest").distinct()
        return save(_sets(docs.join(texts, "digest", "left_semi"), None, "all", length, similarity).dropDuplicates(["key"]).select("key", "n", "own"), "similar-sets")

    def compared(pairs: DataFrame) -> DataFrame:
        """The similar ones of the pairs (a, b)."""
        pairs = save(_likely(pairs.distinct(), facts, similarity), "similar-pairs")
        sets = made(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())
        free(docs.sparkSession)
        parts = max(1, -(-pairs.count() // BATCH))
        links = []
        for k in range(parts):
            links.append(save(_similar(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == k), sets, similarity), "similar-links"))
            free(docs.sparkSession)
        for done in (pairs, sets):
            drop(done)
        return reduce(DataFrame.unionByName, links)

    sides = met.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("least.key").alias("b"), F.col("least.n").alias("nb"), F.col("least.i").alias("ib"))
    edges = compared(sides.where((F.col("a") != F.col("b")) & _may(similarity)).select("a", "b").unionByName(near))
    places = mixed(met, edges)
    drop(met)
    if not places.isEmpty():
        edges = edges.unionByName(compared(paired(places, similarity)))
        crowd = places.join(crowded(places).where("crowd"), "x", "left_semi").select("x", "key", "n", "i")
        left = mixed(crowd, edges)
        drop(places)
        drop(facts)
        if not left.isEmpty():
            edges = edges.unionByName(apart(left, made, similarity))
    out = save(table.select("doc_id", "digest", "key").join(components(edges), F.col("key") == F.col("node"), "left").select("doc_id", "digest", "key", F.coalesce("root", "key").alias("root")), "similar-roots")
    for done in (table, near, facts):
        drop(done)
    return out


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row of each component, with its own columns: that of the least id and, of its texts, the least digest.

    A row without an id stands for its component where no row has one.
    """
    own_id, own_digest = fresh(docs.columns, "_kept_id"), fresh(docs.columns, "_kept_digest")
    kept = grouped(docs, id_col, text_col, length, similarity).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias(own_id), F.col("k.digest").alias(own_digest))
    own = docs.withColumn(fresh([*docs.columns, own_id, own_digest], "_digest"), F.xxhash64(F.col(text_col)))
    digest = own.columns[-1]
    own = own.join(kept, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(digest) == F.col(own_digest)), "left_semi")
    return own.dropDuplicates([id_col, digest]).drop(digest)
