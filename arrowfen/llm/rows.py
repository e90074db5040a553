"""Keeping and dropping rows of a document table by verdicts on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: So many listed rows are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def listed(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` that ``keys`` (doc_id, text_hash) lists (left_semi) or doesn't (left_anti).

    A row is known by its doc_id, null included, and the hash of its text, null
    and empty ones included; repeated rows share a verdict. Empty keys keep
    nothing or everything; an empty table gives an empty table.
    """
    right = stored(keys.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct())
    if right.count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    same = docs["doc_id"].eqNullSafe(right["_d"]) & (F.xxhash64(docs["text"]) == right["_t"])
    return docs.join(right, same, how)


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of ``groups`` (doc_id, text_hash, component_id), which lists every row.

    The row with the least doc_id stays, null ids last, ties by the hash of the
    text; of rows with the same id and text any one. Null and empty texts are
    grouped as ``groups`` says; an empty table gives an empty table.
    """
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    held = groups.select(F.col("component_id").alias("group"), own.alias("own"))
    counted = stored(held.groupBy("group", "own").agg(F.count("*").alias("n")))
    first = counted.groupBy("group").agg(F.min(F.struct("own", "n")).alias("first"))
    best = stored(first.select("group", F.col("first.own").alias("best"), F.col("first.n").alias("n")))
    gone = counted.join(best, counted.group.eqNullSafe(best.group)).where("own <> best").select("own.doc_id", "own.text_hash")
    left = listed(docs, gone, "left_anti")
    twice = best.where("n > 1").select("best.doc_id", "best.text_hash")
    if twice.isEmpty():
        return left
    again = listed(left, twice, "left_semi").dropDuplicates(["doc_id", "text"])
    return listed(left, twice, "left_anti").union(again)
