"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most RADIUS bits share a word within half of that from each. Every distinct
fingerprint therefore emits itself and its one-bit variants; variants are shuffled, and what meets in one is a set of
at most 65 fingerprints that are all near each other: it is held as one mask of bits, whatever the number of
documents. Each such set gives a star of links, which are deduplicated, verified, and joined into components.

Defined cases: a null text is an empty one; texts without words have fingerprint zero, which links like any other; a
null id takes part but never names a component; rows that share a text share everything; a text of any length is hashed
whole, by itself if it is long; other columns, whatever their names, are not read or are carried along; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .store import drop, free, fresh, save
from .words import encoded, slices

#: Fixed values of the contract.
SHINGLE, SEED, RADIUS = 3, 42, 2


def fingerprint(text: str | None) -> int:
    """64 bits, unsigned."""
    from xxhash import xxh64_intdigest

    words = encoded(text).lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxh64_intdigest(line, SEED)
    stops = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *stops]
    h = np.array([xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts, stops[SHINGLE - 1 :], strict=False)], "<u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints fp that together connect all within RADIUS = 2 bits of each other."""
    # Fingerprints are few bytes until each becomes 65 rows: so they are dealt out first, whatever their size says, and
    # by another key, or the dealing they have, in few tasks, would do.
    dealt = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    balls = dealt.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i"))
    balls = balls.select(F.expr("if(i < 0, fp, fp ^ shiftleft(1L, i))").alias("v"), F.expr("if(i < 0, 0L, shiftleft(1L, i))").alias("bit"), F.expr("if(i < 0, 1, 0)").alias("own"))
    met = balls.groupBy("v").agg(F.bit_or("bit").alias("bits"), F.max("own").alias("own")).where("bit_count(bits) + own > 1")
    sets = met.select(F.expr("concat(if(own = 1, array(v), array()), transform(filter(sequence(0, 63), i -> bits & shiftleft(1L, i) != 0), i -> v ^ shiftleft(1L, i)))").alias("near"))
    stars = sets.select(F.explode("near").alias("a"), F.array_min("near").alias("b")).where("a != b").distinct()
    return stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def grouped(table: DataFrame) -> DataFrame:
    """(fp, component_id) from a saved table of (doc_id, fp)."""
    ids = table.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = save(links(ids.select("fp")), "simhash-links")
    free(table.sparkSession)
    roots = ids.join(components(edges), ids.fp == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = save(roots, "simhash-roots")
    drop(edges)
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(names, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    table = save(fingerprints(docs, id_col, text_col), "simhash-fps")
    return table.join(grouped(table), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with its own columns: that of the least id and, of its texts, the least hash. A row without an id stays."""
    name, own_digest = fresh(docs.columns, "_kept"), fresh(docs.columns, "_digest")
    named = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest")).alias("doc_id"), F.col(text_col).alias("text"))
    table = save(fingerprints(named), "simhash-fps")
    kept = table.where("doc_id.id is not null").join(grouped(table), "fp").groupBy("component_id").agg(F.min("doc_id").alias(name)).select(name)
    own = docs.where(F.col(id_col).isNotNull()).withColumn(own_digest, F.xxhash64(text_col))
    own = own.join(kept, (F.col(id_col) == F.col(f"{name}.id")) & (F.col(own_digest) == F.col(f"{name}.digest")), "left_semi").dropDuplicates([id_col, own_digest])
    return own.drop(own_digest).unionByName(docs.where(F.col(id_col).isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
