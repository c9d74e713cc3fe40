"""Exact percentiles of groups of any size: nested histograms, of which only the bin that holds the rank is refined."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, Window, functions as F

from ..sources import shared

#: Bins of a histogram: the rows a group has in an exchange at most, from each task. A bin of at most FEW values is sorted.
BINS, FEW = 4096, 4096
#: The greatest double.
MOST = sys.float_info.max


def quantile(df: DataFrame, by: str, value: str, p: float, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(by, q): of each group the value at rank p * (n - 1) from 0, interpolated between the two around it.

    A round counts the values between the ends that are left to a group in bins, by turns equal in exponents and in
    values, so that a dozen rounds tell all doubles apart, whatever their distribution. It keeps the least and the greatest
    of each bin, and goes on with those of the bin that holds the rank; the value after it is the next one there or the
    least of the next bin. A bin of few values or of one ends the rounds. Only counts are exchanged, and at last few
    values a group; a table of one row a group goes from round to round, saved. Nulls don't count and not-a-number is
    above all; a group without values has no row.
    """
    rows = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_v"))
    left = rows.groupBy(by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumns({"_rank": F.lit(None).cast("bigint"), "_part": F.lit(None).cast("double"), "_next": F.lit(None).cast("double")})
    done: list[DataFrame] = []
    while True:
        todo = shared.saved(_round(rows, left, by, p, bins, len(done) % 2 == 1), "ranks")
        over = (F.col("_n") <= few) | F.col("_lo").eqNullSafe(F.col("_hi"))
        done.append(todo.where(over))
        left = todo.where(~over).drop("_n")
        if left.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # What is one value needs no rows.
    alike = F.col("_lo").eqNullSafe(F.col("_hi"))
    sorted_ = rows.join(out.where(~alike).select(by, "_lo", "_hi"), by).where("_v >= _lo and _v <= _hi").groupBy(by).agg(F.array_sort(F.collect_list("_v")).alias("_all"))
    both = out.join(sorted_, by, "left")
    at = lambda k: F.when(alike, F.col("_lo")).otherwise(F.get("_all", (F.col("_rank") + k).cast("int")))
    after = F.when(F.col("_rank") + 1 < F.col("_n"), at(1)).otherwise(F.col("_next"))
    return both.select(by, F.when(F.col("_part") == 0, at(0)).otherwise(at(0) + (after - at(0)) * F.col("_part")).alias("q"))


def _round(rows: DataFrame, left: DataFrame, by: str, p: float, bins: int, exponents: bool) -> DataFrame:
    """left (by, _lo, _hi, _rank, _part, _next) -> the same of the bin that holds the rank, and _n, its values; without ranks they are p's."""
    inside = rows.join(left, by).where("_v >= _lo and _v <= _hi")
    # Halves, as the difference of the ends may be beyond a double. What is infinite or no number has a bin for itself.
    finite = lambda c: F.least(F.greatest(F.nanvl(F.col(c), F.lit(MOST)), F.lit(-MOST)), F.lit(MOST))
    scaled = lambda c: F.when(finite(c) == 0, 0.0).otherwise(F.signum(finite(c)) * (1100 + F.log2(F.abs(finite(c))))) if exponents else finite(c) / 2
    share = (scaled("_v") - scaled("_lo")) / F.greatest(scaled("_hi") - scaled("_lo"), F.lit(5e-324))
    odd = F.when(F.isnan("_v"), bins + 1).when(F.col("_v") > MOST, bins).when(F.col("_v") < -MOST, -1)
    counted = inside.groupBy(by, F.coalesce(odd, F.least(F.floor(share * bins), F.lit(bins - 1))).alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    order = Window.partitionBy(by).orderBy("_bin")
    summed = counted.select("*", F.sum("_c").over(order).alias("_upto"), F.lead("_a").over(order).alias("_after"), F.sum("_c").over(Window.partitionBy(by)).alias("_all")).join(left, by)
    place = F.lit(float(p)) * (F.col("_all") - 1)
    ranked = summed.withColumn("_part", F.coalesce("_part", place - F.floor(place))).withColumn("_rank", F.coalesce("_rank", F.floor(place)))
    here = ranked.where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    return here.select(by, F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_c").alias("_n"), (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"), "_part", F.coalesce("_after", "_next").alias("_next"))
