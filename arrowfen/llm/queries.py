"""The registered queries over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, oracles
from .archive import archived
from .chat import rotated
from .decontam import contamination
from .hostrules import judged
from .htmlwrap import extracted
from .pieces import encoded
from .pii import detect
from .shards import interleave
from .simhash import near_duplicates
from .urltree import filtered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op3_decontamination": oracles.DECONTAMINATION,
    "op5_host_rules": oracles.HOST_RULES,
    "op7_chat": chat.ORACLE_SQL,
    "op9_warc": oracles.WARC,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents")).drop("scores")


@query
def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"))


@query
def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


@query
def op6_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"))


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated(table(spark, sf_dir, "conversations"))


@query
def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
