"""Search of a collection through its stored index.

The index is a commit like any other: it names a folder and the number up to
which it holds. Rows that changed since are left out of its results and
compared directly, so a search is current without a rebuild.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchConfig, metric_name
from ..operators.index import VectorIndex
from ..operators.knn import knn_batch
from .store import Collection


def build_index(c: Collection) -> dict:
    """Builds and commits the index that the settings call for; its commit. A flat one has no folder."""
    known = c.record()
    rows = c._rows(known)
    name, n = uuid.uuid4().hex, rows.count()
    kind = c.config.index.access_path(n) if n else "flat"
    if kind != "flat":
        VectorIndex.build(rows, c.config.index, path=f"{c.path}/indexes/{name}")
    c._commit({"type": "Index", "index": name if kind != "flat" else None, "kind": kind, "metric": metric_name(c.config.index.metric), "upto": known.seq, "n": n})
    return c.index_commit()


def opened_index(c: Collection) -> tuple[VectorIndex, DataFrame | None]:
    """The collection's index, and the rows that changed since as (id, e), or None if none did. Flat if there is no index, or it is too old."""
    found = c.index_commit()
    if found and found["kind"] != "flat":
        changes = c.changes_since(found["upto"])
        if changes is not None:
            index = VectorIndex.load(c.spark, f"{c.path}/indexes/{found['index']}", found["kind"], c.config.index, rows=c.rows())
            return index, None if all(x["type"] != "Batch" for x in c.commits() if x["seq"] > found["upto"]) else changes
    return VectorIndex("flat", c.rows(), c.config.index), None


def search(c: Collection, queries: DataFrame, k: int = 10, metric: str | None = None, settings: SearchConfig = SearchConfig(), allowed: DataFrame | None = None) -> DataFrame:
    """(q_id, rank, id, score) of queries (q_id, vector), through the index; ``allowed`` (id) lists the rows that may be results."""
    index, changes = opened_index(c)
    if changes is None:
        return index.search(queries, k, settings, metric, allowed=allowed)
    old = index.search(queries, k, settings, metric, allowed=allowed, without=changes)
    fresh = changes.where("e.type <> 'Delete'").select("id", "e.vector")
    if allowed is not None:
        fresh = fresh.join(allowed.select("id").distinct(), "id", "left_semi")
    new = knn_batch(fresh, queries, k, metric or c.config.index.metric)
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("score").desc(), "id"))
    return old.unionByName(new).withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)
