"""Conversation structure repair by weighted finite-state composition.

A conversation's rows are an input acceptor, a chain. The edit transducer keeps, reroles or deletes a row or inserts one;
the grammar acceptor takes the role initials of (s?(ua)+)?. They are composed lazily: an arc exists once a state that
can be reached asks for it. Weights are (cost, labels), least cost first, then the least string of edit initials, and
the shortest path is found in topological order, rows from the last to the first, inserts before a row by their number
(more than the grammar has states would come back to one of them at a cost).

A step of the composition is "inserts, then what becomes of the row", so every path over n rows has n labels that end a
step, none is a proper prefix of another, and the least of concatenated paths is made of the least parts. Conversations
of any length are therefore cut into blocks: rows in order are dealt out by ranges and cut at BLOCK rows or BYTES; a
block is the matrix of its least paths between grammar states; FAN matrices at a time are multiplied, where a part's
labels are stood for by their rank in the part, until one is left; its least path from the start to an end is then
handed down level by level to the blocks, which render their rows. No task sees more than FAN matrices or one block,
except that the digest of a repaired conversation runs over its parts one after the other, as hashes do.

A first row of equal role and text is found by an aggregation of digests, and told to its block.

Defined cases: rows sort by turn, nulls first, ties by the digest of role and text; a null role or text is one space;
a role of another initial than s, u or a, or an empty one, fits nowhere unless reroled; a null conversation id is a
conversation; equal rows are rows of their own; texts of any length are worked on whole; a conversation without rows
has zeros and empty results; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import drop, save
from .words import slices

#: Fixed values of the contract: what edits cost, what a truncated row that stays adds, the grammar with its states from 0, the roles of inserts.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ENDS, ROLES = 4, (0, 3), {"u": "user", "a": "assistant"}
#: Legal pairs of neighbouring initials.
LEGAL = ("su", "ua", "au")

#: Rows and bytes of texts in a block, about; matrices multiplied at a time.
BLOCK, BYTES, FAN = 256, 1 << 20, 64
#: Rows of a pattern that a worker remembers; blocks rendered at a time.
REPEATED, AT_ONCE = 16, 16
CONV = ("none", "conv")
#: Marks of rows: without fault, blank, duplicate, truncated.
FINE, BLANK, DUPLICATE, SHORT = ".", "b", "d", "t"

#: A weight: its cost and its labels. A matrix: from each state, the weights of those that can be reached.
Weight = tuple[int, str]
Matrix = dict[int, dict[int, Weight]]


# The machines.


def edits(initial: str, mark: str) -> Iterator[tuple[str, str | None, int]]:
    """The transducer's arcs for a row: label, what is put out, cost."""
    yield "D", None, DELETE
    if mark not in (BLANK, DUPLICATE):
        more = TRUNCATED if mark == SHORT else 0
        yield "K", initial, KEEP + more
        yield from (("R", r, REROLE + more) for r in ROLES)


def inserts(state: int) -> Iterator[tuple[int, Weight]]:
    yield from ((to, (INSERT, "I")) for r in ROLES if (to := GRAMMAR.get((state, r))) is not None)


def composed(state: int, initial: str, mark: str) -> Iterator[tuple[int, Weight]]:
    """The composition's arcs over a row from a state of the grammar."""
    for label, out, cost in edits(initial, mark):
        to = state if out is None else GRAMMAR.get((state, out))
        if to is not None:
            yield to, (cost, label)


def then(a: Weight, b: Weight) -> Weight:
    return a[0] + b[0], a[1] + b[1]


def least(found: Iterable[tuple[int, Weight]]) -> dict[int, Weight]:
    out: dict[int, Weight] = {}
    for to, w in found:
        if to not in out or w < out[to]:
            out[to] = w
    return out


def layers(state: int) -> Iterator[dict[int, Weight]]:
    """What inserts alone reach from a state, by their number."""
    there = {state: (0, "")}
    for _ in range(STATES):
        yield there
        there = least((to, then(w, more)) for q, w in there.items() for to, more in inserts(q))


@lru_cache(maxsize=None)  # at most four initials by four marks
def step(initial: str, mark: str) -> Matrix:
    """Inserts, then what becomes of the row."""
    return {q: least((to, then(w, more)) for layer in layers(q) for p, w in layer.items() for to, more in composed(p, initial, mark)) for q in range(STATES)}


@lru_cache(maxsize=None)
def ending(state: int) -> Weight:
    """The least inserts that lead to an end."""
    return min(w for layer in layers(state) for q, w in layer.items() if q in ENDS)


@lru_cache(maxsize=1 << 14)
def _pattern(initials: str, marks: str) -> dict[tuple[int, int], tuple[int, str, str]]:
    return product([step(a, m) for a, m in zip(initials, marks, strict=True)])


def least_paths(initials: str, marks: str) -> dict[tuple[int, int], tuple[int, str, str]]:
    """The product over rows; short patterns come again and again, and a worker remembers them."""
    return _pattern(initials, marks) if len(marks) <= REPEATED else _pattern.__wrapped__(initials, marks)


def product(matrices: list[Matrix]) -> dict[tuple[int, int], tuple[int, str, str]]:
    """(from, to): cost, labels and the states on the way, of the least paths through matrices one after the other."""
    out = {}
    for t in range(STATES):
        best = {t: (0, "", str(t))}
        for m in reversed(matrices):
            new = {}
            for q, row in m.items():
                if found := [(w[0] + best[p][0], w[1] + best[p][1], best[p][2]) for p, w in row.items() if p in best]:
                    cost, labels, way = min(found)
                    new[q] = (cost, labels, f"{q}{way}")
            best = new
        out |= {(q, t): found for q, found in best.items()}
    return out


# Rows.


def damaged(turns: DataFrame) -> DataFrame:
    """(none, conv, turn, role, text): the rows after the contract's faults, by the crc32 of `conv_id:turn`."""
    conv, turn = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    rows = keyed(turns).withColumn("fault", F.crc32(F.concat(conv, F.lit(":"), turn)) % 20).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = rows.select(*CONV, "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"))
    return out.drop("copy")


def keyed(turns: DataFrame) -> DataFrame:
    """(none, conv, turn, role, text, conv_id) from turns (conv_id, turn, role, text); none and conv stand for the id."""
    kind = turns.schema["conv_id"].dataType
    return turns.select(
        F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit("0").cast(kind)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), "conv_id",
    )


def _mark() -> Column:
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    return F.when(solid == "", BLANK).when(F.right(solid, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(SHORT)


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(none, conv, task, k, alone, turns, initials, marks, digests, roles, texts): the rows in order, cut at size rows or BYTES.

    A task has a range of the order and numbers its blocks of a conversation by k. alone: the conversation has no other
    block, for sure; the first and the last of a task may have.
    """
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    initial = F.substring("role", 1, 1)
    ready = rows.select(*CONV, "turn", digest.alias("digest"), F.when(initial.isin("s", "u", "a"), initial).otherwise("?").alias("initial"), _mark().alias("mark"), "role", "text")
    # Equal rows may be many: the last key parts them.
    order = [*CONV, F.col("turn").asc_nulls_first(), "digest", "salt"]
    ready = ready.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = rows.schema["conv"].dataType.simpleString()
    fields = ("turn", "initial", "mark", "digest", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, key, k, held, weight, first = TaskContext.get().partitionId(), None, 0, [], 0, True
        done: list[tuple] = []

        def close(last: bool, end: bool) -> None:
            """last: of the conversation in this task; end: of the task."""
            nonlocal held, weight, k
            turns, initials, marks, digests, roles, texts = map(list, zip(*held, strict=True))
            done.append((*key, task, k, last and k == 0 and not first and not end, turns, "".join(initials), "".join(marks), digests, roles, texts))
            held, weight, k = [], 0, k + 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [()] * len(schema)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        schema = None
        for batch in slices(batches, "text"):
            schema = schema or pa.schema([("none", pa.bool_()), ("conv", batch.schema.field("conv").type), ("task", pa.int32()), ("k", pa.int64()), ("alone", pa.bool_()), ("turns", pa.list_(pa.int64())), ("initials", pa.string()), ("marks", pa.string()), ("digests", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
            keys = zip(*(batch.column(c).to_pylist() for c in CONV), strict=True)
            for new, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in fields), strict=True), strict=True):
                if new != key and key is not None:
                    close(True, False)
                    first = False
                elif held and (len(held) >= size or weight >= BYTES):
                    close(False, False)
                if new != key:
                    key, k = new, 0
                held.append(row)
                weight += len(row[-1])
            yield out()
        if held:
            close(True, True)
            yield out()

    return ready.mapInArrow(run, f"none boolean, conv {kind}, task int, k bigint, alone boolean, turns array<bigint>, initials string, marks string, digests array<string>, roles array<string>, texts array<string>")


def numbered(cut: DataFrame) -> DataFrame:
    """The blocks with idx, their number in the conversation. Between two tasks at most one conversation goes on, so what is broadcast has a row for each task at most."""
    ahead = Window.partitionBy(*CONV).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.where("not alone").groupBy(*CONV, "task").agg(F.count("*").alias("n")).select(*CONV, "task", F.sum("n").over(ahead).alias("before")).where("before > 0")
    return cut.join(F.broadcast(before), [*CONV, "task"], "left").withColumn("idx", F.col("k") + F.coalesce("before", F.lit(0)))


def firsts(cut: DataFrame) -> DataFrame:
    """(none, conv, idx, first): the places in each block of the rows that are the first of their role and text in the conversation."""
    every = cut.select(*CONV, "idx", F.posexplode("digests").alias("i", "digest"))
    return every.groupBy(*CONV, "digest").agg(F.min(F.struct("idx", "i")).alias("at")).groupBy(*CONV, "at.idx").agg(F.collect_list("at.i").alias("first"))


# Matrices. A table of them has (none, conv, idx, alone), what a block or more hold (STATS), and paths.

STATS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, lo bigint, hi bigint, turns bigint, head string, tail string"
PATHS = "paths array<struct<s:int,t:int,cost:bigint,labels:string,way:string>>"


def _paths(found: dict[tuple[int, int], tuple[int, str, str]]) -> list[dict]:
    return [{"s": s, "t": t, "cost": c, "labels": labels, "way": way} for (s, t), (c, labels, way) in sorted(found.items())]


def matrices(cut: DataFrame) -> DataFrame:
    """The matrix of each block of cut, a saved table."""
    slim = cut.select(*CONV, "idx", "alone", "turns", "initials", "marks").join(firsts(cut), [*CONV, "idx"], "left")
    kind = cut.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                first = set(r["first"] or ())
                marks = "".join(m if m == BLANK or i in first else DUPLICATE for i, m in enumerate(r["marks"]))
                turns, x = {t for t in r["turns"] if t is not None}, r["initials"]
                found = least_paths(x, marks)
                out.append({
                    "none": r["none"], "conv": r["conv"], "idx": r["idx"], "alone": r["alone"], "blank": marks.count(BLANK), "duplicate": marks.count(DUPLICATE), "truncated": marks.count(SHORT),
                    "illegal": sum(a + b not in LEGAL for a, b in zip(x, x[1:], strict=False)), "lo": min(turns, default=None), "hi": max(turns, default=None), "turns": len(turns), "head": x[0], "tail": x[-1], "paths": _paths(found),
                })
            yield pa.RecordBatch.from_pylist(out, _schema(batch.schema.field("conv").type))

    return slim.mapInArrow(run, f"none boolean, conv {kind}, idx bigint, alone boolean, {STATS}, {PATHS}")


def _schema(conv: pa.DataType) -> pa.Schema:
    counts = [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "lo", "hi", "turns")]
    path = pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("labels", pa.string()), ("way", pa.string())])
    return pa.schema([("none", pa.bool_()), ("conv", conv), ("idx", pa.int64()), ("alone", pa.bool_()), *counts, ("head", pa.string()), ("tail", pa.string()), ("paths", pa.list_(path))])


def multiplied(level: DataFrame, fan: int = FAN) -> DataFrame:
    """The level above: the products of fan matrices that follow one another."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows, chain, total = group.sort_values("idx").to_dict("records"), [], None
        for r in rows:
            order = {x: chr(ord("A") + i) for i, x in enumerate(sorted({p["labels"] for p in r["paths"]}))}
            m: Matrix = {}
            for p in r["paths"]:
                m.setdefault(p["s"], {})[p["t"]] = (p["cost"], order[p["labels"]])
            chain.append(m)
            lo, hi = (None if pd.isna(r[c]) else int(r[c]) for c in ("lo", "hi"))
            new = {c: r[c] for c in ("blank", "duplicate", "truncated", "illegal", "turns", "head", "tail")} | {"lo": lo, "hi": hi}
            if total:
                new |= {c: total[c] + new[c] for c in ("blank", "duplicate", "truncated")}
                new["illegal"] += total["illegal"] + (total["tail"] + r["head"] not in LEGAL)
                new["turns"] += total["turns"] - (hi is not None and total["hi"] == lo)
                new["head"], new["lo"], new["hi"] = total["head"], lo if total["lo"] is None else total["lo"], total["hi"] if hi is None else hi
            total = new
        out = pd.DataFrame([{"none": key[0], "conv": key[1], "idx": key[2], "alone": False, **total, "paths": _paths(product(chain))}])
        return out.astype({"lo": "Int64", "hi": "Int64"})

    grouped = level.withColumn("up", F.floor(F.col("idx") / fan)).groupBy(*CONV, "up")
    return grouped.applyInPandas(run, f"none boolean, conv {level.schema['conv'].dataType.simpleString()}, idx bigint, alone boolean, {STATS}, {PATHS}")


# Repair.


def _chosen(tops: DataFrame) -> DataFrame:
    """(none, conv, stats, cost, t, last, idx, paths): the end of each conversation's least path, and its last inserts."""
    best = F.array_min(F.transform(F.filter("paths", lambda p: p["s"] == 0), lambda p: F.struct((p["cost"] + _by_state(p["t"], 0)).alias("cost"), p["labels"].alias("labels"), _by_state(p["t"], 1).alias("last"), p["t"].alias("t"))))
    return tops.withColumn("best", best).withColumns({"cost": F.col("best.cost"), "t": F.col("best.t"), "last": F.col("best.last")}).drop("best")


def _by_state(t: Column, i: int) -> Column:
    out = F.lit(ending(0)[i])
    for q in range(1, STATES):
        out = F.when(t == q, F.lit(ending(q)[i])).otherwise(out)
    return out


def _path(s: Column, t: Column) -> Column:
    return F.element_at(F.filter("paths", lambda p: (p["s"] == s) & (p["t"] == t)), 1)


def planned(cut: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Each conversation's (none, conv, STATS, cost), and each block's (none, conv, idx, s, labels): where its path begins and its edits. cut: a saved table of numbered blocks."""
    levels = [save(matrices(cut), "repair-blocks")]
    rest = levels[0].where("not alone")
    top = rest.agg(F.max("idx")).first()[0] or 0
    while top > 0:
        levels.append(save(multiplied(rest, fan), "repair-level"))
        rest, top = levels[-1], top // fan
    tops = levels[0].where("alone").unionByName(rest) if len(levels) > 1 else levels[0]
    ends = _chosen(tops)
    todo = ends.where("not alone").select(*CONV, "idx", F.lit(0).alias("s"), "t", "last")
    for level in reversed(levels[1:]):
        # A path's way names the states before, between and after its parts.
        there = level.join(todo, [*CONV, "idx"]).withColumn("way", _path(F.col("s"), F.col("t"))["way"])
        parts = there.select(*CONV, "idx", "last", "way", F.posexplode(F.sequence(F.lit(1), F.length("way") - 1)).alias("j", "_"))
        state = lambda j: F.substring("way", j + 1, F.lit(1)).cast("int")
        todo = parts.select(*CONV, (F.col("idx") * fan + F.col("j")).alias("idx"), state(F.col("j")).alias("s"), state(F.col("j") + 1).alias("t"), F.when(F.col("j") == F.length("way") - 2, F.col("last")).otherwise("").alias("last"))
    single = ends.where("alone" if len(levels) > 1 else "true").select(*CONV, "idx", F.lit(0).alias("s"), "t", "last")
    todo = single.unionByName(todo) if len(levels) > 1 else single
    paths = levels[0].select(*CONV, "idx", "paths").join(todo, [*CONV, "idx"])
    return ends.drop("paths", "idx", "alone", "t", "last", "head", "tail"), paths.select(*CONV, "idx", "s", F.concat(_path(F.col("s"), F.col("t"))["labels"], "last").alias("labels"))


def rendered(labels: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The lines `role:text` that edits leave of a block's rows; state: the grammar's before it."""
    out, row = [], 0
    for label in labels:
        if label != "I":
            row += 1
        if label == "D":
            continue
        if label == "K":
            role, text = roles[row - 1], texts[row - 1]
            state = GRAMMAR[state, role[0]]
        else:  # what can follow a state is only one of the two
            (initial,) = (r for r in ROLES if (state, r) in GRAMMAR)
            role, text, state = ROLES[initial], texts[row - 1] if label == "R" else "", GRAMMAR[state, initial]
        out.append(f"{role}:{text}")
    return out


def parts(cut: DataFrame, plan: DataFrame) -> DataFrame:
    """(none, conv, idx, labels, text): the repaired lines of each block."""
    joined = plan.join(cut.select(*CONV, "idx", "roles", "texts"), [*CONV, "idx"])
    kind = cut.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):  # they may be large
                some = batch.slice(i, AT_ONCE)
                columns = (some.column(c).to_pylist() for c in ("labels", "s", "roles", "texts"))
                texts = ["\n".join(rendered(*r)) for r in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in (*CONV, "idx", "labels")), pa.array(texts, pa.string())], names=[*CONV, "idx", "labels", "text"])

    return joined.mapInArrow(run, f"none boolean, conv {kind}, idx bigint, labels string, text string")


def digested(found: DataFrame) -> DataFrame:
    """(none, conv, audit, repaired_sha256), over the parts of each conversation one after the other; none is held."""
    kind = found.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sha = conv_type = None
        audit: list[str] = []
        begun = False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], conv_type), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names=[*CONV, "audit", "repaired_sha256"])

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for none, conv, labels, text in zip(*(batch.column(c).to_pylist() for c in (*CONV, "labels", "text")), strict=True):
                if key != (none, conv):
                    if key is not None:
                        yield row()
                    key, sha, audit, begun = (none, conv), hashlib.sha256(), [], False
                audit.append(labels)
                if text:  # a line has a colon
                    sha.update((b"\n" if begun else b"") + text.encode())
                    begun = True
        if key is not None:
            yield row()

    return found.repartition(*CONV).sortWithinPartitions(*CONV, "idx").mapInArrow(run, f"none boolean, conv {kind}, audit string, repaired_sha256 string")


def repaired(rows: DataFrame, every: DataFrame, size: int = BLOCK, fan: int = FAN) -> DataFrame:
    """A row for each conversation of every (none, conv): what is wrong with its rows (none, conv, turn, role, text), the least edits and their cost, and the digest of what they leave."""
    raw = save(blocks(rows, size), "repair-cut")
    cut = save(numbered(raw), "repair-rows")
    drop(raw)
    stats, plan = planned(cut, fan)
    out = every.distinct().join(stats, [*CONV], "left").join(digested(parts(cut, plan)), [*CONV], "left")
    gaps = F.col("hi") - F.col("lo") + 1 - F.col("turns")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"), zero(gaps).alias("gaps"), *(zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repaired(damaged(turns), keyed(turns).select(*CONV))


def oracle() -> str:
    """The contract in SQL: from a conversation's last row to its first, the least edits from each of the grammar's states."""
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def add(v: str, cost: str, label: str, line: str = "") -> str:
        return f"{{'c': {v}.c + {cost}, 'a': '{label}' || {v}.a, 'o': {f'list_prepend({line}, {v}.o)' if line else f'{v}.o'}}}"

    def kept(initial: str, v: str) -> str:
        return f"CASE WHEN mark IN ('.', 't') AND x = '{initial}' THEN {add(v, 'late', 'K', 'role || chr(58) || txt')} END"

    def reroled(role: str, v: str) -> str:
        return f"CASE WHEN mark IN ('.', 't') THEN {add(v, '3 + late', 'R', f"'{role}:' || txt")} END"

    w = {
        0: [add("v0", "4", "D"), kept("s", "v1"), kept("u", "v2"), reroled("user", "v2")],
        1: [add("v1", "4", "D"), kept("u", "v2"), reroled("user", "v2")],
        2: [add("v2", "4", "D"), kept("a", "v3"), reroled("assistant", "v3")],
        3: [add("v3", "4", "D"), kept("u", "v2"), reroled("user", "v2")],
    }
    user, assistant = "'user:'", "'assistant:'"
    return f"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(unicode(c) AS BIGINT))),
  lambda c, b: xor(c >> 8, tab.t[xor(c & 255, b) + 1])), 4294967295) % 20 AS fault FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt FROM k, (VALUES (1), (2)) c(n) WHERE fault <> 0 AND (n = 1 OR fault = 3)),
o AS (SELECT *, rtrim(txt, {spaces}) AS solid, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || txt)) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY p) AS seen, left(role, 1) AS x, left(lead(role) OVER (PARTITION BY conv_id ORDER BY p), 1) AS y FROM o),
m AS (SELECT *, CASE WHEN solid = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(solid, 1) IN ('.', '!', '?') THEN '.' ELSE 't' END AS mark FROM s),
r AS (SELECT DISTINCT conv_id, n AS p, {{'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])}} AS v0, {{'c': 6, 'a': 'II', 'o': [{user}, {assistant}]}} AS v1, {{'c': 3, 'a': 'I', 'o': [{assistant}]}} AS v2, {{'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])}} AS v3 FROM m
  UNION ALL SELECT conv_id, p, list_min([w0, {add("c2", "3", "I", user)}]), list_min([w1, {add("c2", "3", "I", user)}]), c2, list_min([w3, {add("w2", "3", "I", user)}])
  FROM (SELECT *, list_min([w2, {add("w3", "3", "I", assistant)}]) AS c2
    FROM (SELECT conv_id, p - 1 AS p, {", ".join(f"list_min([{', '.join(w[q])}]) AS w{q}" for q in w)} FROM (SELECT r.*, m.role, m.txt, m.x, m.mark, CASE WHEN m.mark = 't' THEN 3 ELSE 0 END AS late FROM r JOIN m ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.p = m.p)))),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE mark = 'b') AS blank, count(*) FILTER (WHERE mark = 'd') AS duplicate, count(*) FILTER (WHERE mark = 't') AS truncated, count(*) FILTER (WHERE p < n AND x || y NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(v0.c, 0) AS BIGINT) AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN r ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND r.p = 0
"""
