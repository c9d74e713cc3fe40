"""A corpus from raw documents to packed sequences, a stage for each operator.

Defined cases, for every stage: an empty table gives an empty one; columns other than doc_id, text, source and n_chars
are carried along whatever their names; rows that share an id are rows of their own; a null id is carried through; a
text of any length is worked on whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import mixing, packing, pii, rules, similar
from gridloom.llm.store import save


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the base nor a learned rule rejects; null and empty texts fail the base."""
    return rules.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similar by 0.8 at least.

    Candidates come from SimHash balls, and by prefixes what no ball can reach; all are checked exactly. Of a group the
    least id stays, null last, and of its texts one; texts without words, null ones too, are one group.
    """
    return similar.distinct_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their personal data masked; n_chars follows the text; a null text stays null."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them; one without words is taken with its source and counts nothing; a null source is a source."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the packed sequences; a null text is an empty one, of one token."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("simhash", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", sequences),
]

#: The tokenizer of the last stage is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
