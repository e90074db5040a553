"""Mutations of a table of rows with an id, as new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Limits
from ..errors import InvalidRequestError
from ..functions.vector import check_batch_size, is_valid_vector


def checked(rows: DataFrame, dimensions: int | None = None, vector: str = "vector") -> DataFrame:
    """``rows``; a vector that is empty, not finite or of another dimension raises when it is read."""
    good = is_valid_vector(F.col(vector))
    if dimensions is not None:
        good = good & (F.size(vector) == dimensions)
    return rows.withColumn(vector, F.when(good, F.col(vector)).otherwise(F.raise_error(F.lit("invalid vector or dimension"))))


def inserted(base: DataFrame, new: DataFrame, id: str = "id") -> DataFrame:
    """New rows appended; ids that are there already are overwritten."""
    return upserted(base, new, id)


def upserted(base: DataFrame, new: DataFrame, id: str = "id") -> DataFrame:
    """Rows of ``new`` replace those of the same id or are added."""
    return base.join(new.select(id), id, "left_anti").unionByName(new)


def created_flags(base: DataFrame, new: DataFrame, id: str = "id") -> DataFrame:
    """(id, created): whether an upsert of ``new`` creates the row."""
    there = base.select(id).distinct().withColumn("_there", F.lit(True))
    return new.join(there, id, "left").select(id, F.col("_there").isNull().alias("created"))


def deleted(base: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    return base.join(ids.select(id), id, "left_anti")


def deleted_count(base: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """One row, ``n``: how many rows a deletion of ``ids`` removes; repeated ids count once."""
    return base.select(id).join(ids.select(id), id, "left_semi").agg(F.count("*").alias("n"))


def updated(base: DataFrame, changes: DataFrame, column: str, id: str = "id") -> DataFrame:
    """``column`` replaced, not merged, where ``changes`` (id, column) lists the id."""
    new = changes.select(F.col(id), F.lit(True).alias("_listed"), F.col(column).alias("_new"))
    joined = base.join(new, id, "left")
    return joined.withColumn(column, F.when(F.col("_listed"), F.col("_new")).otherwise(F.col(column))).select(*base.columns)


def row_bytes(vector: str = "vector", text: str = "text"):
    """The size of a row as it counts for limits: id, vector and text."""
    return 16 + 4 * F.size(vector) + F.coalesce(F.octet_length(text), F.lit(0))


def limit_violations(base: DataFrame, new: DataFrame, limits: Limits, id: str = "id", vector: str = "vector", text: str = "text") -> DataFrame:
    """(rule, value, bound) of each limit that an insert of ``new`` would break; rows that replace others don't add."""
    size = row_bytes(vector, text)
    fresh = new.join(base.select(id), id, "left_anti")
    sums = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b"))
    largest = new.agg(F.coalesce(F.max(size), F.lit(0)).cast("long").alias("value"))
    both = sums(base).union(sums(fresh)).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    parts = [both.select(F.lit("max_vectors").alias("rule"), F.col("n").alias("value"), F.lit(limits.max_vectors).cast("long").alias("bound"))]
    parts.append(both.select(F.lit("max_bytes"), F.col("b"), F.lit(limits.max_bytes).cast("long")))
    parts.append(largest.select(F.lit("max_vector_bytes"), "value", F.lit(limits.max_vector_bytes).cast("long")))
    return parts[0].union(parts[1]).union(parts[2]).where("value > bound")


def insert_batch(base: DataFrame, vectors: list, texts: list, metadata: list | None = None, id: str = "id") -> DataFrame:
    """1 to 10,000 rows of equally many vectors and texts, with fresh ids; metadata default to an empty object."""
    check_batch_size(len(texts))
    if len(vectors) != len(texts):
        raise InvalidRequestError("as many vectors as texts are needed")
    rows = [(v, t, (metadata or [])[i] if metadata and i < len(metadata) else "{}") for i, (v, t) in enumerate(zip(vectors, texts))]
    new = base.sparkSession.createDataFrame(rows, "vector array<float>, text string, metadata string").withColumn(id, F.expr("uuid()"))
    return base.unionByName(new.select(*base.columns))
