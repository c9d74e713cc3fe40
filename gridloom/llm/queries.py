"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, infill, mixing, packing, pii, quality, repair, rules, simhash, subwords, suffixes, urls, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_collapse": chat.query,
    "op2_pii": pii.query,
    "op3_suffix_dedup": suffixes.query,
    "op4_simhash": simhash.query,
    "op5_mixing": mixing.query,
    "op6_quality": quality.query,
    "op7_quality_rules": rules.query,
    "op8_embeddings": vectors.query,
    "op9_urls": urls.query,
    "op10_packing": packing.query,
    "op11_subwords": subwords.query,
    "op12_infill": infill.query,
    "op13_repair": repair.query,
}

ORACLES: dict[str, str] = {
    "op1_chat_collapse": chat.ORACLE,
    "op5_mixing": mixing.oracle(),
    "op12_infill": infill.ORACLE,
    "op13_repair": repair.oracle(),
}
