"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash of its id. Words are summed by source and hash bucket; the running sums name the one
bucket of each source in which its budget ends; only that bucket is histogrammed again, by the next bits, until the
bits are used up. What is left per source is one threshold, and the mix is a filter on it: nothing is sorted, and a
smaller budget takes a subset of what a larger one takes.

Defined cases: a null text counts no words and takes none; a null id hashes like an empty string; a null source is a
source of its own, last in order; rows that share an id share a hash and are taken together; an empty table gives an
empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import drop, fresh, save

#: Fixed values of the contract: weights by source order, the share of all words to mix, the most a source repeats.
WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
#: Bits of the hash, and bits that one histogram resolves.
BITS, STEP = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(doc_id: Column) -> Column:
    """The hash: the first 60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def key(source: Column) -> Column:
    """A source as a string that sorts by code point and is never null; null's sorts last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """sizes (src, source_size), a row for each source -> with target, by filling up to each source's limit in order of limit per weight.

    The share that sources above their limit leave goes to the others by weight until none is above: the level at
    which the first source isn't full is the level of all that aren't.
    """
    order = Window.orderBy("src")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_limit = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("src"))
    filled = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(total)) - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))
    level = weighed.withColumn("place", F.row_number().over(by_limit)).withColumn("level", left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(filled), F.lit(0.0))))
    # Beyond rounding, some source is below its limit unless total >= most; then all are full.
    at = F.coalesce(F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("place", "level"))).over(everything)["level"], F.lit(float("inf")))
    return level.withColumn("target", F.when(F.col("cap") == 0, 0.0).otherwise(F.least(F.col("cap"), at * F.col("w")))).select("src", "source_size", "target")


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """sized (src, size, u), goals (src, source_size, target) -> (src, passes, least): a document is taken passes times, once more if u < least."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    now = goals.select("src", passes.alias("passes"), (F.col("target") - F.when(F.col("source_size") > 0, passes * F.col("source_size")).otherwise(0)).alias("want"), F.lit(0).cast("long").alias("at"))
    now = save(now, "mix-goals")
    for used in range(STEP, BITS + 1, STEP):
        shift = BITS - used
        inside = sized.join(now.select("src", "at"), "src")
        inside = inside.where(F.shiftright("u", shift + STEP) == F.col("at"))
        hist = inside.groupBy("src", F.shiftright("u", shift).alias("b")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("src").orderBy("b")
        run = hist.withColumn("before", F.sum("n").over(upto) - F.col("n"))
        joined = run.join(now, "src")
        # The boundary: the first bucket that the want doesn't cover. A want that covers all has no boundary.
        crossing = joined.where(F.col("before") + F.col("n") > F.col("want")).groupBy("src").agg(F.min(F.struct("b", "before", "n")).alias("c"))
        after = now.join(crossing, "src", "left")
        if used < BITS:
            step = after.select("src", "passes", (F.col("want") - F.coalesce("c.before", F.lit(0))).alias("want"), F.coalesce("c.b", F.shiftleft("at", STEP) + F.lit((1 << STEP) - 1)).alias("at"))
        else:  # one hash: it is taken if that comes closer
            nearer = F.col("c.before") + F.col("c.n") / 2 <= F.col("want")
            step = after.select("src", "passes", F.when(F.col("c").isNull(), F.lit(1 << BITS)).otherwise(F.col("c.b") + nearer.cast("long")).alias("least"))
        nxt = save(step, "mix-step")
        drop(now)
        now = nxt
    return now


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs."""
    sized = save(docs.select(F.col(id_col).alias("doc_id"), key(F.col(source_col)).alias("src"), words(F.col(text_col)).alias("size"), unit(F.col(id_col)).alias("u")), "mix-sized")
    goals = save(targets(sized.groupBy("src").agg(F.sum("size").alias("source_size")), **shares), "mix-targets")
    cut = thresholds(sized, goals)
    plan = goals.join(cut, "src")
    taken = (F.col("size") * (F.col("passes") + (F.col("u") < F.col("least")).cast("long"))).alias("taken")
    return sized.join(plan, "src").select("doc_id", "size", "source_size", "target", taken)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """docs as mixed: every row as often as it is taken, with its own columns."""
    own = docs.columns
    src, size, u = (fresh(own, x) for x in ("_src", "_size", "_u"))
    tagged = docs.withColumns({src: key(F.col(source_col)), size: words(F.col(text_col)), u: unit(F.col(id_col))})
    sized = save(tagged.select(F.col(src).alias("src"), F.col(size).alias("size"), F.col(u).alias("u")), "mix-sized")
    goals = save(targets(sized.groupBy("src").agg(F.sum("size").alias("source_size")), **shares), "mix-targets")
    cut = thresholds(sized, goals)
    passes, least = fresh(own, "_passes"), fresh(own, "_least")
    joined = tagged.join(cut.select(F.col("src").alias(src), F.col("passes").alias(passes), F.col("least").alias(least)), src)
    times = F.col(passes) + (F.col(u) < F.col(least)).cast("long")
    return joined.where(times > 0).withColumn(size, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*own)


def oracle(table: str = "documents") -> str:
    """The same mix in SQL by sorting, for an engine with MD5 and 128-bit sums."""
    weights = "CASE (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END"
    return f"""
WITH sized AS (
  SELECT doc_id, source AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS u
  FROM {table}),
sources AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY src),
weighed AS (SELECT src, source_size, CAST({weights} AS DOUBLE) AS w, source_size * CAST(2.0 AS DOUBLE) AS cap FROM sources),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, src NULLS LAST) AS place, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT src, source_size, CASE WHEN cap = 0 THEN 0.0 ELSE least(cap, coalesce(arg_min(level, place) FILTER (WHERE level <= cap / w) OVER (), CAST('inf' AS DOUBLE)) * w) END AS target
  FROM levels),
grouped AS (SELECT src, u, sum(size) AS g FROM sized GROUP BY src, u),
running AS (SELECT src, u, g, sum(g) OVER (PARTITION BY src ORDER BY u) - g AS before FROM grouped)
SELECT s.doc_id, s.size, g.source_size, g.target,
       CAST(s.size * CASE WHEN g.source_size = 0 THEN 0 ELSE floor(g.target / g.source_size)
         + CASE WHEN r.before + r.g / 2.0 <= g.target - floor(g.target / g.source_size) * g.source_size THEN 1 ELSE 0 END END AS BIGINT) AS taken
FROM sized s JOIN goals g ON s.src IS NOT DISTINCT FROM g.src JOIN running r ON s.src IS NOT DISTINCT FROM r.src AND s.u = r.u
"""


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
