"""Joins whose left rows may share a key by the millions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key with at least one in HOT of all rows is hot: there are at most HOT.
HOT = 256


def dealt(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """left joined with right, which has a row for each key of on, none of them null. how: left or inner.

    The right rows of hot keys are broadcast, so that the left rows stay where they are; all others are exchanged.
    """
    most = max(2, -(-left.count() // HOT))
    found = left.groupBy(*on).count().where(F.col("count") >= most).select(*on)
    keys = left.sparkSession.createDataFrame(found.collect(), found.schema)
    match = right.join(F.broadcast(keys), on, "left_semi").withColumn("_hit", F.lit(True))
    marked = left.join(F.broadcast(keys.join(F.broadcast(match), on, "left").withColumn("_hot", F.lit(True))), on, "left")
    hot = marked.where("_hot" if how == "left" else "_hot and _hit").drop("_hot", "_hit")
    cold = marked.where("_hot is null").select(*left.columns).join(right, on, how)
    return hot.select(*cold.columns).unionByName(cold)
