"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is joins and aggregations over the edge table, and no neighbour list is ever gathered. Aggregations combine
before they exchange; in joins, nodes with at least one in HUBS of all edges, of which there are at most 2 * HUBS,
are broadcast, so that a hub's edges stay where they are. The table is written to the shared folder after each round;
the loop ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import drop, save


HUBS = 256


def _with_least(edges: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """edges joined with least (u, m, deg) on u."""
    hub = F.col("deg") >= F.lit(max(2, -(-count // HUBS)))
    marked = edges.join(F.broadcast(least.where(hub).select("u", F.col("m").alias("hub"))), "u", "left")
    rest = marked.where("hub is null").drop("hub").join(least.where(~hub).select("u", "m"), "u")
    return rest.unionByName(marked.where("hub is not null").withColumnRenamed("hub", "m"))


def _star(edges: DataFrame, count: int, large: bool) -> DataFrame:
    """edges (u, v), u > v, count of them. Large: neighbours above u go to the least of u and its neighbours; small: those below."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg")).select("u", F.least("m", "u").alias("m"), "deg")
        return _with_least(edges.select(F.col("v").alias("u"), F.col("u").alias("w")), least, count).select(F.col("w").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg"))
    moved = _with_least(edges, least, count).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that an edge (a, b) of two longs names; root is the least node of its component.

    Loops and repeated edges do not matter. An empty edge table gives an empty result.
    """
    now = save(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        nxt = save(_star(_star(now, mark[0], large=True), mark[0], large=False), "edges")
        drop(now)
        now, before, mark = nxt, mark, _mark(nxt)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
