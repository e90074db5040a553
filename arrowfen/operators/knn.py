"""Nearest-neighbour search over a table of vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_BATCH, SearchConfig, metric_name
from ..errors import InvalidRequestError
from ..functions.distance import cosine_to_unit, euclidean, score
from ..functions.metadata import Filter
from ..functions.vector import check_batch_size
from .kernel import best, matrix, scores

#: Queries that one pass over the base compares; more take further passes.
QUERY_BLOCK = 1024


def query_column(query: Sequence[float]):
    """A query vector as one literal."""
    q = np.asarray(query, np.float64)
    if q.ndim != 1 or not q.size or not np.isfinite(q).all():
        raise InvalidRequestError("a query vector is a list of finite numbers")
    return F.lit(q)


def _score(vector: str, query: Sequence[float], metric: str | None, binary: bool):
    """The score with a constant query, whose length is taken once instead of for each row."""
    if metric_name(metric) != "cosine" or binary:
        return score(F.col(vector), query_column(query), metric, binary)
    q = np.asarray(query, np.float64)
    length = np.linalg.norm(q)
    return cosine_to_unit(F.col(vector), query_column(q / length if length else q))


def knn(
    base: DataFrame, query: Sequence[float], k: int = 10, metric: str | None = None, where: Filter | None = None, filter_mode: str = "pre",
    rank_metric: str | None = None, config: SearchConfig = SearchConfig(), id: str = "id", vector: str = "vector", metadata: str | None = None, binary: bool = False,
) -> DataFrame:
    """The k best rows of ``base`` with ``score``, best first, ties by id; one scan with a top-k for each task.

    ``pre`` filters before ranking. ``post`` ranks k times the overfetch and
    then filters, so fewer than k rows may come back. ``rank_metric`` ranks by
    another metric than the one that is reported.
    """
    query_column(query)  # rejects what is no query
    value = _score(vector, query, metric, binary)
    rank = value if rank_metric is None else _score(vector, query, rank_metric, binary)
    rows = base.where(F.col(vector).isNotNull())
    filtered = where is not None
    if filtered and filter_mode == "pre":
        rows = rows.where(where.column(rows, metadata))
    rows = rows.withColumn("score", value).withColumn("_rank", rank)
    order = [F.col("_rank").desc(), F.col(id)]
    if filtered and filter_mode == "post":
        wide = rows.orderBy(*order).limit(k * config.filter_overfetch)
        return wide.where(where.column(wide, metadata)).orderBy(F.col("score").desc(), F.col(id)).limit(k).drop("_rank")
    return rows.orderBy(*order).limit(k).drop("_rank")


def range_topk(base: DataFrame, query: Sequence[float], min_score: float, k: int = 10, metric: str | None = None, **more) -> DataFrame:
    """Of the k best rows those that score ``min_score`` or more."""
    return knn(base, query, k, metric, **more).where(F.col("score") >= min_score)


def radius(base: DataFrame, query: Sequence[float], max_distance: float, vector: str = "vector") -> DataFrame:
    """All rows within a Euclidean distance, with ``distance``."""
    return base.withColumn("distance", euclidean(F.col(vector), query_column(query))).where(F.col("distance") <= max_distance)


def collected_queries(queries: DataFrame, q_id: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a batch of 1 to MAX_BATCH queries."""
    found = queries.select(q_id, vector).limit(MAX_BATCH + 1).collect()
    check_batch_size(len(found))
    vectors = np.array([r[1] for r in found], np.float64)
    if vectors.ndim != 2 or not np.isfinite(vectors).all():
        raise InvalidRequestError("query vectors have one length and finite components")
    return np.array([r[0] for r in found]), vectors


def search_kernel(ids: np.ndarray, vectors: np.ndarray, k: int, metric: str, probed: np.ndarray | None = None):
    """A mapInArrow function over (id, vector[, cid]): the task's k best rows of each query, as (q, id, score).

    ``probed`` has a row of flags over the clusters for each query; rows of
    other clusters don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, object), np.zeros(0))] * len(ids)
        kind, names = pa.int64(), []
        for batch in batches:
            kind = batch.column(0).type
            own = np.array(batch.column(0).to_pylist(), object if pa.types.is_string(kind) else None)
            values = scores(matrix(batch.column(1)), vectors, metric)
            if probed is not None:
                values[~probed[:, batch.column(2).to_numpy()].T] = -np.inf
            for q in range(len(ids)):
                some = best(own, values[:, q], k)
                old_ids, old = held[q]
                every, worth = np.concatenate([old_ids, own[some]]), np.concatenate([old, values[some, q]])
                top = best(every, worth, k)
                held[q] = every[top], worth[top]
        qs = [ids[q] for q in range(len(ids)) for _ in held[q][0]]
        found = [x for some, _ in held for x in some.tolist()]
        worth = [x for _, some in held for x in some.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(qs), pa.array(found, kind), pa.array(worth, pa.float64())], names=["q_id", "id", "score"])

    return run


def _id_type(df: DataFrame, name: str) -> str:
    return "string" if df.schema[name].dataType.simpleString() == "string" else "bigint"


def knn_batch(base: DataFrame, queries: DataFrame, k: int = 10, metric: str | None = None, id: str = "id", vector: str = "vector", q_id: str = "q_id", q_vector: str = "vector") -> DataFrame:
    """(q_id, rank, id, score): the k best rows for each of 1 to 10,000 queries.

    The queries, bounded by that limit, travel with the tasks in blocks; each
    task multiplies its rows with a block and keeps k rows for each query, so
    the shuffle holds k rows for each query and task.
    """
    ids, vectors = collected_queries(queries, q_id, q_vector)
    rows = base.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    return ranked(rows, ids, vectors, k, metric_name(metric), _id_type(queries, q_id), _id_type(base, id))


def ranked(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str, q_type: str, id_type: str, probed: np.ndarray | None = None) -> DataFrame:
    found = None
    for at in range(0, len(ids), QUERY_BLOCK):
        block = slice(at, at + QUERY_BLOCK)
        part = rows.mapInArrow(search_kernel(ids[block], vectors[block], k, metric, None if probed is None else probed[block]), f"q_id {q_type}, id {id_type}, score double")
        found = part if found is None else found.union(part)
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("q_id", "rank", "id", "score")
