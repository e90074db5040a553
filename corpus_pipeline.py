"""A corpus pipeline over ``documents``: clean, deduplicate, decontaminate, mask, encode.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last
keep the columns of ``documents``, also columns of their own that a table has.
Texts are read whole, however long; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arrowfen.llm.decontam import contamination
from arrowfen.llm.hostrules import without_failing
from arrowfen.llm.pieces import encoded
from arrowfen.llm.pii import redacted
from arrowfen.llm.rows import listed, one_of_each
from arrowfen.llm.scratch import discard, stored
from arrowfen.llm.simhash import near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that their host's verdict rejects go.

    Null and empty texts have no words and fail; null sources are one host;
    repeated rows and null ids are judged like any other.
    """
    return without_failing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id.

    Null and empty texts are one group; null ids come last, ties go by the
    hash of the text; of repeated rows one stays.
    """
    return one_of_each(docs, near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go.

    Null and empty texts have no words and stay; repeated rows share a verdict;
    null ids are ids like any other; an empty benchmark takes nothing away.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return listed(docs, contamination(docs, items).where("contaminated"), "left_anti")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in every text; null and empty texts, null ids and repeated rows stay as they are."""
    return redacted(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, exact): every text in SentencePiece ids, and whether they decode to it.

    Null and empty texts have no ids; null doc_ids and repeated rows are rows like any other.
    """
    return encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("pieces", pieces),
]

#: SQL can express neither near-duplicate groups nor SentencePiece; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each from the stored result of the one before, which then goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
