"""A clustered (inverted-list) index: k-means centroids and a cluster column."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import metric_name
from .kernel import matrix, scores
from .knn import _id_type, collected_queries, ranked

#: Centroids times dimensions that the driver and each task hold at most.
MOST_CELLS = 50_000_000
#: All centroids moved less than this similarity allows: training ends.
CONVERGED = 0.99
#: Recall that a search without a number of probes has to reach on sampled rows, the sample, and its neighbours that reach the driver at most.
TARGET, SAMPLE, MOST_FOUND = 0.95, 1_000, 100_000


def auto_parameters(n: int) -> tuple[int, int, int]:
    """(clusters, probes, iterations) for n rows."""
    k = int(max(math.sqrt(n), 10))
    return k, int(min(max(0.1 * k, 1), 10)), 10


def _nearest(rows: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """The best centroid of each row; of equal ones the last."""
    values = np.round(scores(rows, centroids, metric), 12)
    return len(centroids) - 1 - np.argmax(values[:, ::-1], axis=1)


def assigned(base: DataFrame, centroids: np.ndarray, metric: str | None = None, vector: str = "vector") -> DataFrame:
    """``base`` with ``cid``, the cluster of each row."""
    name, at = metric_name(metric), base.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = _nearest(matrix(batch.column(at)), centroids, name) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cid, pa.int64())], names=[*batch.schema.names, "cid"])

    schema = base.select("*", F.lit(0).cast("bigint").alias("cid")).schema
    return base.where(F.col(vector).isNotNull()).mapInArrow(run, schema)


def seeds(base: DataFrame, k: int, id: str = "id", vector: str = "vector") -> np.ndarray:
    """The vectors of the k lowest ids."""
    return np.array([r[0] for r in base.where(F.col(vector).isNotNull()).orderBy(id).limit(k).select(vector).collect()], np.float64)


def lloyd_step(base: DataFrame, centroids: np.ndarray, metric: str | None = None, vector: str = "vector") -> np.ndarray:
    """Each cluster's mean; an empty cluster keeps its centroid. Tasks add up; K sums reach the driver."""
    name = metric_name(metric)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            rows = matrix(batch.column(0))
            if len(rows):
                cid = _nearest(rows, centroids, name)
                np.add.at(total, cid, rows)
                count += np.bincount(cid, minlength=len(centroids))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some], pa.int64()), pa.array(total[some].tolist(), pa.list_(pa.float64()))], names=["cid", "n", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = matrix(table.column("total")).sum(axis=0)
        return pa.table({"cid": table.column("cid").slice(0, 1), "n": [sum(table.column("n").to_pylist())], "total": [total.tolist()]})

    schema = "cid bigint, n bigint, total array<double>"
    parts = base.where(F.col(vector).isNotNull()).select(vector).mapInArrow(sums, schema)
    out = centroids.copy()
    for r in parts.groupBy("cid").applyInArrow(add, schema).collect():
        out[r.cid] = np.array(r.total) / r.n
    return out


def train(base: DataFrame, k: int, iterations: int = 10, metric: str | None = None, id: str = "id", vector: str = "vector") -> np.ndarray:
    """Centroids by Lloyd's iterations from the k lowest ids, at most as many as the driver may hold."""
    first = base.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    k = max(1, min(k, MOST_CELLS // max(1, first[0] if first else 1)))
    name, now = metric_name(metric), seeds(base, k, id, vector)
    for _ in range(iterations):
        before, now = now, lloyd_step(base, now, name, vector)
        if all(scores(a[None], b[None], name)[0, 0] >= CONVERGED for a, b in zip(before, now)):
            break
    return now


@dataclass
class IvfIndex:
    """Trained centroids and the table with ``cid``; lists are pruned where the table is stored by it."""

    centroids: np.ndarray
    rows: DataFrame
    metric: str = "cosine"
    id: str = "id"
    vector: str = "vector"
    probes: dict[tuple[int, str], int] = field(default_factory=dict)
    pending: int | None = None

    @staticmethod
    def build(base: DataFrame, k: int | None = None, iterations: int = 10, metric: str | None = None, id: str = "id", vector: str = "vector") -> IvfIndex:
        """``k`` lists, or as many as the rows call for; with fewer than ``k`` rows they wait without lists, and searches look at all."""
        n = base.count()
        wanted = auto_parameters(n)[0] if k is None else k
        if k is not None and n < k:
            return IvfIndex(np.zeros((0, 0)), base.withColumn("cid", F.lit(0).cast("bigint")), metric_name(metric), id, vector, pending=k)
        k = min(wanted, max(n, 1))
        centroids = train(base, k, iterations, metric, id, vector)
        return IvfIndex(centroids, assigned(base, centroids, metric, vector), metric_name(metric), id, vector)

    def save(self, path: str) -> None:
        self.rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "cid bigint, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        self.rows.write.partitionBy("cid").parquet(f"{path}/rows")

    @staticmethod
    def load(spark, path: str, metric: str = "cosine", id: str = "id", vector: str = "vector") -> IvfIndex:
        held = spark.read.parquet(f"{path}/centroids").orderBy("cid").collect()
        rows = spark.read.parquet(f"{path}/rows").withColumn("cid", F.col("cid").cast("bigint"))
        return IvfIndex(np.array([r.centroid for r in held], np.float64), rows, metric, id, vector)

    def insert(self, new: DataFrame) -> IvfIndex:
        """With new rows in the clusters of frozen centroids; ids that are there already stay as they are. Waiting rows are clustered when there are enough."""
        fresh = new.join(self.rows.select(self.id), self.id, "left_anti").dropDuplicates([self.id])
        if self.pending is not None:
            return IvfIndex.build(self.rows.drop("cid").unionByName(fresh), self.pending, metric=self.metric, id=self.id, vector=self.vector)
        return IvfIndex(self.centroids, self.rows.unionByName(assigned(fresh, self.centroids, self.metric, self.vector)), self.metric, self.id, self.vector)

    def remove(self, ids: DataFrame) -> IvfIndex:
        return IvfIndex(self.centroids, self.rows.join(ids.select(self.id).distinct(), self.id, "left_anti"), self.metric, self.id, self.vector, pending=self.pending)

    def sizes(self) -> DataFrame:
        return self.rows.groupBy("cid").agg(F.count("*").alias("n"))

    def _ordered(self, vectors: np.ndarray) -> np.ndarray:
        """The lists of each vector, best first."""
        return np.argsort(-np.round(scores(vectors, self.centroids, self.metric), 12), axis=1, kind="stable")

    def probes_for(self, k: int, metric: str) -> int:
        """The fewest lists that hold TARGET of the k nearest other rows of sampled rows, by exact search of the sample; kept for the next search."""
        if (k, metric) not in self.probes:
            rows = self.rows.select(F.col(self.id).alias("id"), F.col(self.vector).alias("vector"), "cid")
            m = max(50, min(SAMPLE, MOST_FOUND // (k + 1)))
            some = [r.vector for r in rows.orderBy(F.xxhash64("id"), "id").limit(m).select("id", "vector").collect()]
            clusters, counts = len(self.centroids), np.zeros(len(self.centroids), np.int64)
            if some:
                asked = np.array(some, np.float64)
                near = ranked(rows, np.arange(len(asked)), asked, k + 1, metric, "bigint", _id_type(self.rows, self.id)).where("rank > 1")
                held = near.join(rows.select("id", "cid"), "id").groupBy("q_id", "cid").count().collect()
                place = np.argsort(self._ordered(asked), axis=1)  # of each list
                for r in held:
                    counts[place[r.q_id, r.cid]] += r["count"]
            reached = np.flatnonzero(np.cumsum(counts) >= TARGET * counts.sum())
            least = max(1, min(10, int(0.1 * clusters)))
            self.probes[k, metric] = max(least, int(reached[0]) + 1 if counts.any() else clusters)
        return self.probes[k, metric]

    def search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None, q_id: str = "q_id", q_vector: str = "vector", metric: str | None = None) -> DataFrame:
        """(q_id, rank, id, score) over the ``nprobe`` best lists of each query, or as many as reach TARGET; all rows if there are no centroids."""
        ids, vectors = collected_queries(queries, q_id, q_vector)
        rows = self.rows.select(F.col(self.id).alias("id"), F.col(self.vector).alias("vector"), "cid")
        kinds = _id_type(queries, q_id), _id_type(self.rows, self.id)
        name = metric_name(metric) if metric else self.metric
        clusters = len(self.centroids)
        if not clusters:
            return ranked(rows, ids, vectors, k, name, *kinds)
        nprobe = min(clusters, nprobe or self.probes_for(k, name))
        order = self._ordered(vectors)[:, :nprobe]
        probed = np.zeros((len(ids), clusters), bool)
        np.put_along_axis(probed, order, True, axis=1)
        lists = np.flatnonzero(probed.any(axis=0)).tolist()
        return ranked(rows.where(F.col("cid").isin(lists)), ids, vectors, k, name, *kinds, probed)
