"""Rasters, detections and scenes read out of plain tables, by whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, r, g, b): an 8-bit image 100 wide, a pixel for each order."""
    o = table(spark, sf_dir, "orders")
    part = lambda c, n: F.pmod(F.floor(c), F.lit(n)).cast("int")
    return o.select(
        F.lit("orders").alias("image_id"), F.floor(F.col("o_orderkey") / 100).cast("int").alias("y"), (F.col("o_orderkey") % 100).cast("int").alias("x"),
        part(F.col("o_totalprice"), 256).alias("r"), part(F.col("o_totalprice") / 7, 256).alias("g"), ((F.col("o_custkey") * 31) % 256).cast("int").alias("b"),
    )


PIXELS = """SELECT 'orders' AS image_id, CAST(o_orderkey // 100 AS INTEGER) AS y, CAST(o_orderkey % 100 AS INTEGER) AS x,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 256 AS INTEGER) AS r, CAST(CAST(floor(o_totalprice / 7) AS BIGINT) % 256 AS INTEGER) AS g,
  CAST((o_custkey * 31) % 256 AS INTEGER) AS b FROM orders"""


def floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, v): a band of doubles 64 wide, a row for each embedding."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("embeddings").alias("image_id"), F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "e")).select("image_id", "y", "x", F.col("e").cast("double").alias("v"))


FLOATS = "SELECT 'embeddings' AS image_id, CAST(vec_id AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, det_id, cls, confidence, cx, cy, width, height, angle, col_off, row_off), one for each event."""
    e = table(spark, sf_dir, "events")
    cls = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 7).when(F.col("event_type") == "signup", 8).otherwise(14)
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        (u % 20).cast("int").alias("image_id"), i.alias("det_id"), cls.alias("cls"), (F.col("value") / 500).alias("confidence"),
        ((i * 37) % 1000).cast("double").alias("cx"), ((u * 53) % 200).cast("double").alias("cy"), (40 + i % 20).cast("double").alias("width"), (30 + i % 9).cast("double").alias("height"), (((i * 7) % 314) / 100).alias("angle"),
        ((i % 3) * 544).cast("int").alias("col_off"), ((i % 2) * 544).cast("int").alias("row_off"),
    )


DETECTIONS = """SELECT CAST(user_id % 20 AS INTEGER) AS image_id, event_id AS det_id,
  CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 7 WHEN 'signup' THEN 8 ELSE 14 END AS INTEGER) AS cls,
  value / 500 AS confidence, CAST((event_id * 37) % 1000 AS DOUBLE) AS cx, CAST((user_id * 53) % 200 AS DOUBLE) AS cy,
  CAST(40 + event_id % 20 AS DOUBLE) AS width, CAST(30 + event_id % 9 AS DOUBLE) AS height, ((event_id * 7) % 314) / 100e0 AS angle,
  CAST((event_id % 3) * 544 AS INTEGER) AS col_off, CAST((event_id % 2) * 544 AS INTEGER) AS row_off FROM events"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, path, priority, west, north, res, width, height, crs), one for each supplier."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("image_id"), F.concat(F.lit("/in/scene"), k.cast("string"), F.lit(".tif")).alias("path"), (k % 1000).cast("int").alias("priority"),
        ((k * 17) % 60).cast("double").alias("west"), (100 + (k * 29) % 50).cast("double").alias("north"), F.lit(0.5).alias("res"),
        (20 + (k * 7) % 30).cast("int").alias("width"), (15 + (k * 11) % 25).cast("int").alias("height"), F.lit("EPSG:4490").alias("crs"),
    )


SCENES = """SELECT s_suppkey AS image_id, '/in/scene' || s_suppkey || '.tif' AS path, CAST(s_suppkey % 1000 AS INTEGER) AS priority,
  CAST((s_suppkey * 17) % 60 AS DOUBLE) AS west, CAST(100 + (s_suppkey * 29) % 50 AS DOUBLE) AS north, 0.5e0 AS res,
  CAST(20 + (s_suppkey * 7) % 30 AS INTEGER) AS width, CAST(15 + (s_suppkey * 11) % 25 AS INTEGER) AS height, 'EPSG:4490' AS crs FROM supplier"""
