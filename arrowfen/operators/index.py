"""One interface over the access paths: flat, clustered and graph, chosen by settings or the number of rows.

An index is built once, stored, and searched from there: the clustered one by
list, so that a search reads the probed lists only, the graph one as graphs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig, SearchConfig, metric_name
from ..errors import IndexStateError
from ..functions.telemetry import vector_bytes
from ..sources.shared import shared_path
from .graph import GraphIndex
from .ivf import IvfIndex, auto_parameters
from .knn import knn_batch


@dataclass
class VectorIndex:
    """Rows with their access path; ``path`` is where the index is stored."""

    kind: str
    rows: DataFrame
    config: IndexConfig = IndexConfig()
    id: str = "id"
    vector: str = "vector"
    ivf: IvfIndex | None = None
    graph: GraphIndex | None = None
    path: str | None = None

    @staticmethod
    def build(rows: DataFrame, config: IndexConfig = IndexConfig(), id: str = "id", vector: str = "vector", path: str | None = None) -> VectorIndex:
        """The index that the configuration, or else the number of rows, calls for, stored at ``path``."""
        n = rows.count()
        kind = config.access_path(n)
        if kind == "flat" or not n:
            return VectorIndex("flat" if not n and config.kind == "auto" else kind, rows, config, id, vector)
        path = path or shared_path(rows.sparkSession, "index")
        if kind == "ivf":
            IvfIndex.build(rows, min(n, config.clusters or auto_parameters(n)[0]), config.iterations, config.metric, id, vector).save(path)
        else:
            GraphIndex.build(rows, path, config.metric, config.m, id, vector)
        own = VectorIndex.load(rows.sparkSession, path, kind, config, id, vector, rows)
        return own

    def _only(self, rows: DataFrame, allowed: DataFrame | None, without: DataFrame | None) -> DataFrame:
        for ids, how in ((allowed, "left_semi"), (without, "left_anti")):
            if ids is not None:
                rows = rows.join(ids.select(F.col("id").alias(self.id)).distinct(), self.id, how)
        return rows

    def search(self, queries: DataFrame, k: int = 10, search: SearchConfig = SearchConfig(), metric: str | None = None, q_id: str = "q_id", q_vector: str = "vector", allowed: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
        """(q_id, rank, id, score) for a batch of queries; ``allowed`` (id) lists the rows that may be results, ``without`` those that may not.

        A graph is built for one metric; another one scans. An exact search looks at all lists, and at what a graph's walk missed.
        """
        metric = metric_name(metric or self.config.metric)
        if self.ivf is not None:
            own = replace(self.ivf, rows=self._only(self.ivf.rows, allowed, without))
            nprobe = len(own.centroids) if search.exact else search.nprobe or self.config.nprobe
            return own.search(queries, k, nprobe, q_id, q_vector, metric)
        if self.graph is not None and metric == self.graph.metric:
            return self.graph.search(queries, k, max(search.ef or self.config.ef, k), q_id, q_vector, allowed, without, search.exact)
        return knn_batch(self._only(self.rows, allowed, without), queries, k, metric, self.id, self.vector, q_id, q_vector)

    def insert(self, new: DataFrame) -> VectorIndex:
        """With new rows; ids that are there already are ignored. A graph index grows where it is stored."""
        fresh = new.join(self.rows.select(self.id), self.id, "left_anti").dropDuplicates([self.id])
        if self.graph is not None:
            self.graph.insert(fresh, self.id, self.vector)
        return replace(self, rows=self.rows.unionByName(fresh), ivf=self.ivf and self.ivf.insert(fresh))

    def remove(self, ids: DataFrame) -> VectorIndex:
        """Without the rows of these ids. A graph index keeps them as tombstones where it is stored."""
        if self.graph is not None:
            self.graph.remove(ids, self.id)
        kept = self.rows.join(ids.select(self.id).distinct(), self.id, "left_anti")
        return replace(self, rows=kept, ivf=self.ivf and self.ivf.remove(ids))

    def stats(self) -> DataFrame:
        """One row: kind, vectors, bytes, lists, tombstones, average_degree; null where the kind has none."""
        size = F.coalesce(F.sum(vector_bytes(self.vector)), F.lit(0)).alias("bytes")
        lists = F.lit(len(self.ivf.centroids) if self.ivf else 0).cast("bigint").alias("lists")
        base = self.rows.agg(F.lit(self.kind).alias("kind"), F.count("*").alias("vectors"), size, lists)
        if self.graph is None:
            return base.select("*", F.lit(None).cast("bigint").alias("tombstones"), F.lit(None).cast("double").alias("average_degree"))
        nodes = F.col("nodes") + F.col("tombstones")
        return base.crossJoin(F.broadcast(self.graph.stats().agg(F.sum("tombstones").alias("tombstones"), (F.sum(F.col("average_degree") * nodes) / F.sum(nodes)).alias("average_degree"))))

    def save(self, path: str) -> None:
        """A copy of the stored form: the rows by list, the graphs, or just the rows."""
        if self.ivf is not None:
            self.ivf.save(path)
        elif self.graph is not None:
            self.graph.graphs().write.parquet(f"{path}/graphs")
            self.graph.tombstones().write.parquet(f"{path}/tombstones")
            self.rows.write.parquet(f"{path}/rows")
        else:
            self.rows.write.parquet(f"{path}/rows")

    @staticmethod
    def load(spark: SparkSession, path: str, kind: str, config: IndexConfig = IndexConfig(), id: str = "id", vector: str = "vector", rows: DataFrame | None = None) -> VectorIndex:
        """A stored index; ``rows`` where they are stored elsewhere."""
        if kind == "ivf":
            own = IvfIndex.load(spark, path, config.metric, id, vector)
            if not np.isfinite(own.centroids).all():
                raise IndexStateError("centroids are corrupt")
            return VectorIndex(kind, own.rows.drop("cid") if rows is None else rows, config, id, vector, own, path=path)
        rows = spark.read.parquet(f"{path}/rows") if rows is None else rows
        if kind == "hnsw":
            return VectorIndex(kind, rows, config, id, vector, graph=GraphIndex.load(spark, path, config.metric, config.m), path=path)
        return VectorIndex(kind, rows, config, id, vector, path=path)
