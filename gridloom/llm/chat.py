"""Chat formatting after a cumulative-snapshot collapse.

A conversation that was logged again after every turn appears as many conversations, each a prefix of the next. The
rolling hash of a conversation's first k turns is the exclusive or of 64-bit hashes of (position, role, text) over
them, in two lanes; the whole hash of every conversation is anti-joined with the hashes of all proper prefixes, equal
conversations keep the least id, and what is left is maximal and gets rendered. Texts are exchanged twice: to put turns
in order for the hashes, which are written as a table of a few numbers a row, and to render what is kept.

Hashes are folded within blocks of turn numbers first and then over the blocks, so a conversation with a third of all
rows is scanned by many tasks. It is rendered in parts of at most `size` rows of one block, whatever their turn numbers,
so that no part outgrows a task; joined in order of part they are the whole conversation. The size is an argument of
collapse(), BLOCK by default; a size over the longest conversation gives every conversation as one row.

Defined cases: a null role or text differs from an empty one and renders as empty; turns sort by number, nulls first,
ties by role and text; rows with a null conversation id form one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import drop, free, save

#: Turn numbers in a block, and rows in a part, if not asked otherwise.
BLOCK = 256
#: What names a conversation: whether it has no id, and its id or a stand-in, so that joins are on plain equality.
CONV = ("none", "conv")
KEY = (*CONV, "blk")


def keyed(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """(none, conv, blk, turn, role, text) from turns (conv_id, turn, role, text)."""
    kind, turn = turns.schema["conv_id"].dataType, F.col("turn").cast("long")
    return turns.select(
        F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0).cast(kind)).alias("conv"), F.floor(F.coalesce(turn, F.lit(-1)) / size).alias("blk"),
        turn.alias("turn"), "role", "text",
    )


def _place() -> Column:
    """The row's number in its block, from 1."""
    return F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(none, conv, blk, ahead, parts, total): the rows and the parts before each block, and the conversation's rows."""
    sizes = rows.groupBy(*KEY).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*CONV).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return sizes.select(*KEY, upto("n").alias("ahead"), upto(F.ceil(F.col("n") / size)).alias("parts"), F.sum("n").over(Window.partitionBy(*CONV)).alias("total"))


def prefix_hashes(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(none, conv, blk, pos, last, a, b), saved: the hash of the block's rows up to each; last: the conversation ends there."""
    placed = rows.join(_blocks(rows, size), [*KEY]).withColumn("at", _place()).withColumn("pos", F.col("at") + F.col("ahead"))
    h = F.xxhash64(F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))
    h2 = F.xxhash64(F.lit(1), F.col("text"), F.col("pos"), F.col("role"))
    upto = Window.partitionBy(*KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.select(*KEY, "at", "pos", (F.col("pos") == F.col("total")).alias("last"), h.alias("a"), h2.alias("b"))
    return save(own.select(*KEY, "pos", "last", F.bit_xor("a").over(upto).alias("a"), F.bit_xor("b").over(upto).alias("b")), "chat-prefixes")


def maximal(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(none, conv, n_turns), saved, of the conversations that prefix no longer one; of equal ones the least id."""
    every = prefix_hashes(rows, size)
    whole = every.groupBy(*KEY).agg(F.max_by("a", "pos").alias("a"), F.max_by("b", "pos").alias("b"))
    before = Window.partitionBy(*CONV).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = whole.select(*KEY, *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c + "0") for c in "ab"))
    full = lambda df: df.join(ahead, [*KEY]).select(*CONV, "pos", F.col("a").bitwiseXOR(F.col("a0")).alias("h1"), F.col("b").bitwiseXOR(F.col("b0")).alias("h2"))
    # A first turn that a third of all conversations share is one row of each task's after the partial distinct.
    proper = full(every.where("not last")).select("pos", "h1", "h2").distinct()
    distinct = full(every.where("last")).groupBy("pos", "h1", "h2").agg(F.min(F.struct(*CONV)).alias("k"))
    kept = save(distinct.join(proper, ["pos", "h1", "h2"], "left_anti").select("k.*", F.col("pos").alias("n_turns")), "chat-kept")
    drop(every)
    return kept


def render(rows: DataFrame, keep: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, part, n_turns, text): the kept conversations, in parts of at most size rows."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    ahead = _blocks(rows, size).join(keep, [*CONV]).select(*KEY, "parts", "n_turns")
    placed = rows.join(ahead, [*KEY]).withColumn("at", _place())
    # Parts are within blocks, by which rows are dealt already.
    grouped = placed.withColumn("k", F.floor((F.col("at") - 1) / size)).groupBy(*KEY, "k", "parts", "n_turns").agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("lines"))
    return grouped.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), (F.col("parts") + F.col("k")).cast("int").alias("part"), "n_turns", F.array_join(F.col("lines.line"), "").alias("text"))


def collapse(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    rows = keyed(turns, size)
    keep = maximal(rows, size)
    free(turns.sparkSession)
    return render(rows, keep, size)


def query(spark, sf_dir: str) -> DataFrame:
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH t AS (SELECT conv_id, role, text, CAST(floor(coalesce(turn, -1) / 256) AS BIGINT) AS blk,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations),
c AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, blk ORDER BY pos) - 1) // 256 AS k FROM t),
p AS (SELECT conv_id, pos, list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY pos) AS turns FROM t),
n AS (SELECT conv_id, max(pos) AS n_turns FROM t GROUP BY conv_id),
whole AS (SELECT p.conv_id, p.turns, n.n_turns FROM p JOIN n ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.pos = n.n_turns),
proper AS (SELECT DISTINCT p.turns FROM p JOIN n ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.pos < n.n_turns),
kept AS (SELECT min(conv_id) AS conv_id, n_turns FROM whole WHERE turns NOT IN (SELECT turns FROM proper) GROUP BY turns, n_turns)
SELECT c.conv_id, CAST(dense_rank() OVER (PARTITION BY c.conv_id ORDER BY c.blk, c.k) - 1 AS INTEGER) AS part, CAST(k.n_turns AS BIGINT) AS n_turns,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY pos) AS text
FROM c JOIN kept k ON c.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY c.conv_id, c.blk, c.k, k.n_turns
"""
