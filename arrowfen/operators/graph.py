"""A navigable small-world graph index, stored as many bounded graphs.

Rows are dealt into graphs of bounded bytes. Each is built at once: a node is
linked to the best of the nodes before it, found by block products, and keeps a
bounded number of links. Nodes of the upper layers, drawn at random, are the
entries, with one more for each group of near rows without any; a walk begins
at the best of them, which one product finds. Graphs are stored as rows of a
table, so an index is built once, and a search reads graphs, walks all queries
through each of them at once, and merges the graphs' best rows; recall is at
least that of a single graph. Removed rows are tombstones, which still guide
walks; so do rows that a filter rejects, unless it leaves so few that they are
compared directly. An exact search goes on where its walk ends: rows at least as
near as the last one found are looked up by products over the whole graph.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import metric_name
from ..errors import IndexStateError
from ..sources.shared import shared_path
from .kernel import best, matrix, scores
from .knn import _id_type, collected_queries

#: Bytes of vectors, and nodes, of one graph at most; rows that are scored at once, and queries that walk together.
GRAPH_BYTES, GRAPH_ROWS, BLOCK, TOGETHER = 32 << 20, 20_000, 1024, 256
#: Links to nodes that came before which a node keeps whatever comes later, so that all parts stay in reach.
KEPT = 4
#: Entries that a walk begins at, and how many times the beam's width the rows of a filter may be to be compared directly.
STARTS, DIRECT = 16, 10
#: Rounding of a product, as a share of the lengths, that the exact check allows for; rows within it are scored anew.
SLACK = 1e-9


class Graph:
    """A layered neighbour graph over vectors in memory; nearer means a higher score."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, metric: str = "cosine", m: int = 16, seed: int = 7, links: np.ndarray | None = None, entries: np.ndarray | None = None) -> None:
        self.vectors, self.ids, self.metric, self.m, self.seed = np.asarray(vectors, np.float64), np.asarray(ids), metric, m, seed
        lengths = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.base = np.divide(self.vectors, lengths[:, None], out=np.zeros_like(self.vectors), where=lengths[:, None] > 0) if metric == "cosine" else self.vectors
        self.bias = -0.5 * lengths**2 if metric == "euclidean" else np.zeros(len(self.vectors))
        draws = np.maximum(np.random.default_rng(seed).random(len(self.ids)), 1e-12)
        self.levels = (-np.log(draws) / np.log(m)).astype(int)
        if links is None:
            self.links, near = self._linked()
            self.entries = self._entries(*near)
        else:
            self.links, self.entries = links, entries
        self.dead = np.zeros(len(self.ids), bool)

    def __len__(self) -> int:
        return int((~self.dead).sum())

    def _linked(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The links of each node, -1 where there is none; and pairs of a node with its nearest few."""
        nodes, most = np.arange(len(self.ids)), 2 * self.m
        sources, targets, worth = [], [], []
        for first in range(0, len(nodes), BLOCK):
            own, before = nodes[first : first + BLOCK], nodes[: first + BLOCK]
            value = self.base[own] @ self.base[before].T + self.bias[before]
            value[np.arange(len(before))[None, :] >= np.arange(first, first + len(own))[:, None]] = -np.inf
            k = min(self.m, len(before))
            top = np.argpartition(-value, k - 1, axis=1)[:, :k]
            w = np.take_along_axis(value, top, axis=1)
            some = w > -np.inf
            sources.append(np.repeat(own, k).reshape(top.shape)[some])
            targets.append(before[top][some])
            worth.append(w[some])
        out = np.full((len(self.ids), most), -1, np.int32)
        if not len(nodes):
            return out, (nodes, nodes)
        a, b, w = map(np.concatenate, (sources, targets, worth))
        back = w - self.bias[b] + self.bias[a]  # as seen from the other end
        source, target, value, forward = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, back]), np.repeat([True, False], len(a))
        order = np.lexsort((-value, ~forward, source))  # links to earlier nodes, best first: the first few stay
        rank = _rank_in_groups(source[order])
        kept = np.zeros(len(source), bool)
        kept[order] = forward[order] & (rank < KEPT)
        order = np.lexsort((-value, ~kept, source))
        rank = _rank_in_groups(source[order])
        some = rank < most
        out[source[order][some], rank[some]] = target[order][some]
        order = np.lexsort((-value, source))
        some = order[_rank_in_groups(source[order]) < KEPT]
        return out, (source[some], target[some])

    def _entries(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The upper layers' nodes, and one for each group of nodes that are linked by nearness, and each part that no walk reaches, without any."""
        upper = np.flatnonzero(self.levels > 0)
        entries = upper if len(upper) >= STARTS else np.argsort(-self.levels, kind="stable")[:STARTS]
        label = np.arange(len(self.ids))
        while True:
            before = label.copy()
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            label = label[label]
            if (label == before).all():
                break
        entries = np.union1d(entries, np.setdiff1d(np.unique(label), label[entries]))
        reached, front, more = np.zeros(len(self.ids), bool), entries, []
        while len(front):
            reached[front] = True
            near = np.unique(self.links[front])
            front = near[(near >= 0) & ~reached[near]]
            if not len(front) and not reached.all():
                more.append(int(np.argmin(reached)))
                front = np.array(more[-1:])
        return np.concatenate([entries, np.array(more, entries.dtype)])

    def _worth(self, nodes: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Worth of the nodes (queries x some) for their queries; minus infinity for -1."""
        value = np.einsum("qnd,qd->qn", self.base[nodes], query) + self.bias[nodes]
        value[nodes < 0] = -np.inf
        return value

    def search_many(self, queries: np.ndarray, k: int, ef: int = 200, allowed: np.ndarray | None = None, exact: bool = False) -> list[list[tuple]]:
        """[(id, score)] of the k best live nodes for each query; ``allowed`` flags the nodes that may be results.

        Where a filter leaves fewer than k results the walk is repeated with a wider beam. ``exact`` adds what the walk missed.
        """
        alive = ~self.dead if allowed is None else ~self.dead & allowed
        wanted, out = min(k, int(alive.sum())), []
        direct = np.flatnonzero(alive) if alive.sum() <= DIRECT * max(ef, k) and not alive.all() else None
        for first in range(0, len(queries), TOGETHER):
            block = np.asarray(queries[first : first + TOGETHER], np.float64)
            width = min(max(ef, k), len(self.ids))
            found = [direct] * len(block)
            while wanted and direct is None:
                found = self._walk(block, width, alive, wanted)
                if width >= len(self.ids) or all(len(f) >= wanted for f in found):
                    break
                width = min(4 * width, len(self.ids))
            if exact and wanted and direct is None:
                found = self._with_missed(block, found, alive, wanted)
            for q in range(len(block)):
                nodes = found[q] if wanted else np.zeros(0, np.int64)
                value = scores(self.vectors[nodes], block[q : q + 1], self.metric)[:, 0] if len(nodes) else np.zeros(0)
                top = best(self.ids[nodes], value, k) if len(nodes) else []
                out.append([(self.ids[nodes[t]].item(), float(value[t])) for t in top])
        return out

    def _asked(self, queries: np.ndarray) -> np.ndarray:
        """The queries as walks compare them with ``base``."""
        lengths = np.linalg.norm(queries, axis=1, keepdims=True)
        return np.divide(queries, lengths, out=np.zeros_like(queries), where=lengths > 0) if self.metric == "cosine" else queries

    def _with_missed(self, queries: np.ndarray, found: list[np.ndarray], alive: np.ndarray, wanted: int) -> list[np.ndarray]:
        """``found`` and, by block products over all nodes, every live one as near as the last of the ``wanted`` best in it."""
        query, nodes = self._asked(queries), np.flatnonzero(alive)
        least = np.full(len(queries), -np.inf)
        for q, some in enumerate(found):
            if len(some) >= wanted:
                worth = self.base[some] @ query[q] + self.bias[some]
                least[q] = np.partition(worth, len(worth) - wanted)[len(worth) - wanted]
        least -= SLACK * (np.abs(least) + np.linalg.norm(query, axis=1) * np.sqrt(np.einsum("ij,ij->i", self.base, self.base).max()) + np.abs(self.bias).max())
        more: list[list[np.ndarray]] = [[some] for some in found]
        for first in range(0, len(nodes), BLOCK):
            own = nodes[first : first + BLOCK]
            here, q = np.nonzero(self.base[own] @ query.T + self.bias[own][:, None] >= least)
            order = np.argsort(q, kind="stable")
            for n, some in zip(np.unique(q), np.split(own[here[order]], np.flatnonzero(np.diff(q[order])) + 1)):
                more[n].append(some)
        return [np.unique(np.concatenate(some)) for some in more]

    def _walk(self, queries: np.ndarray, ef: int, alive: np.ndarray, wanted: int) -> list[np.ndarray]:
        """For each query the live nodes among those that a best-first walk with a beam of ``ef`` scores: ``wanted`` or more of the best."""
        n, query = len(queries), self._asked(queries)
        rows, width = np.arange(n), min(STARTS, ef, len(self.entries))
        value = query @ self.base[self.entries].T + self.bias[self.entries]
        top = np.argpartition(-value, width - 1, axis=1)[:, :width]
        beam, worth = np.full((n, ef), -1, np.int64), np.full((n, ef), -np.inf)
        beam[:, :width], worth[:, :width] = self.entries[top], np.take_along_axis(value, top, axis=1)
        opened, seen = worth == -np.inf, np.zeros((n, len(self.ids)), bool)
        seen[rows[:, None], beam[:, :width]] = True
        live = alive[beam[:, :width]]
        hits, hit_worth = np.where(live, beam[:, :width], -1), np.where(live, worth[:, :width], -np.inf)
        active = rows
        while len(active):
            value = np.where(opened[active], -np.inf, worth[active])
            top = np.argmax(value, axis=1)
            going = value[np.arange(len(active)), top] > -np.inf
            active, top = active[going], top[going]
            if not len(active):
                break
            opened[active, top] = True
            near = self.links[beam[active, top]].astype(np.int64)
            near[(near >= 0) & seen[active[:, None], near]] = -1
            here, column = np.nonzero(near >= 0)
            seen[active[here], near[here, column]] = True
            value = self._worth(near, query[active])
            every, all_worth = np.concatenate([beam[active], near], axis=1), np.concatenate([worth[active], value], axis=1)
            flags = np.concatenate([opened[active], np.zeros(near.shape, bool)], axis=1)
            order = np.argpartition(-all_worth, ef - 1, axis=1)[:, :ef]
            beam[active], worth[active], opened[active] = (np.take_along_axis(x, order, axis=1) for x in (every, all_worth, flags))
            good = (near >= 0) & alive[near]
            held, held_worth = np.full((n, near.shape[1]), -1, np.int64), np.full((n, near.shape[1]), -np.inf)
            held[active], held_worth[active] = np.where(good, near, -1), np.where(good, value, -np.inf)
            hits, hit_worth = np.concatenate([hits, held], axis=1), np.concatenate([hit_worth, held_worth], axis=1)
            if hits.shape[1] > 2 * wanted + 64:
                order = np.argpartition(-hit_worth, wanted - 1, axis=1)[:, : 2 * wanted]
                hits, hit_worth = np.take_along_axis(hits, order, axis=1), np.take_along_axis(hit_worth, order, axis=1)
        return [h[w > -np.inf] for h, w in zip(hits, hit_worth)]

    def search(self, query: np.ndarray, k: int, ef: int = 200, allowed: np.ndarray | None = None) -> list[tuple]:
        """(id, score) of the k best live nodes."""
        return self.search_many(np.asarray(query, np.float64)[None], k, ef, allowed)[0]

    def remove(self, ids) -> int:
        """Leaves tombstones: the nodes still guide walks but are no results. How many."""
        gone = np.isin(self.ids, np.asarray(ids)) & ~self.dead
        self.dead |= gone
        return int(gone.sum())

    def stats(self) -> dict:
        layers = {k: int((self.levels >= k).sum()) for k in range(int(self.levels.max(initial=-1)) + 1)}
        degree = float((self.links >= 0).sum() / len(self.ids)) if len(self.ids) else 0.0
        return {"nodes": len(self), "tombstones": int(self.dead.sum()), "layers": layers, "average_degree": degree}

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors.astype(np.float32), ids=self.ids, links=self.links, entries=self.entries, head=np.array([json.dumps([self.metric, self.m, self.seed])]))
        return out.getvalue()

    @staticmethod
    def loaded(data: bytes) -> Graph:
        try:
            with np.load(io.BytesIO(data), allow_pickle=False) as f:
                metric, m, seed = json.loads(str(f["head"][0]))
                return Graph(f["vectors"], f["ids"], metric, m, seed, f["links"], f["entries"])
        except (ValueError, KeyError, OSError) as e:
            raise IndexStateError(f"a stored graph is corrupt: {e}") from e


def _rank_in_groups(keys: np.ndarray) -> np.ndarray:
    """The place of each element among its equals, of sorted keys."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))


def _graphs(batches: Iterator[pa.RecordBatch], metric: str, m: int, rows: int | None) -> Iterator[pa.RecordBatch]:
    def made(ids: list, parts: list) -> pa.RecordBatch:
        graph = Graph(np.concatenate(parts), np.array(ids), metric, m)
        members = pa.array([ids], pa.list_(pa.array(ids).type))
        return pa.RecordBatch.from_arrays([pa.array([graph.dumped()], pa.binary()), members], names=["graph", "ids"])

    ids, parts = [], []
    for batch in batches:
        vectors, own, at = matrix(batch.column(1)), batch.column(0).to_pylist(), 0
        while at < len(own):
            most = rows or max(1, min(GRAPH_ROWS, GRAPH_BYTES // (4 * vectors.shape[1])))
            take = most - len(ids)
            ids += own[at : at + take]
            parts.append(vectors[at : at + take])
            at += take
            if len(ids) >= most:
                yield made(ids, parts)
                ids, parts = [], []
    if ids:
        yield made(ids, parts)


@dataclass
class GraphIndex:
    """Stored graphs (g, graph), the graph of each row (id, g), and tombstones (id, g)."""

    path: str
    spark: SparkSession
    metric: str = "cosine"
    m: int = 16
    id_type: str = "bigint"

    @staticmethod
    def build(base: DataFrame, path: str | None = None, metric: str | None = None, m: int = 16, id: str = "id", vector: str = "vector", rows: int | None = None) -> GraphIndex:
        """Graphs of all rows with a vector, written to ``path``; at most ``rows`` in a graph, or as many as its bytes allow."""
        spark = base.sparkSession
        index = GraphIndex(path or shared_path(spark, "graphs"), spark, metric_name(metric), m, _id_type(base, id))
        index._add(base.select(F.col(id).alias("id"), F.col(vector).alias("vector")), rows)
        return index

    def _add(self, rows: DataFrame, most: int | None) -> None:
        metric, m = self.metric, self.m
        made = rows.where("vector is not null").mapInArrow(lambda batches: _graphs(batches, metric, m, most), f"graph binary, ids array<{self.id_type}>")
        made.withColumn("g", F.expr("uuid()")).write.mode("append").parquet(f"{self.path}/graphs")

    @staticmethod
    def load(spark: SparkSession, path: str, metric: str | None = None, m: int = 16) -> GraphIndex:
        kind = spark.read.parquet(f"{path}/graphs").schema["ids"].dataType.elementType.simpleString()
        return GraphIndex(path, spark, metric_name(metric), m, kind)

    def graphs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/graphs")

    def members(self) -> DataFrame:
        """(id, g) of all rows, removed ones included."""
        return self.graphs().select(F.explode("ids").alias("id"), "g")

    def tombstones(self) -> DataFrame:
        schema = f"id {self.id_type}, g string"
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/tombstones")
        there = jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)
        return self.spark.read.schema(schema).parquet(f"{self.path}/tombstones") if there else self.spark.createDataFrame([], schema)

    def insert(self, new: DataFrame, id: str = "id", vector: str = "vector") -> int:
        """Adds graphs of new rows; ids that are there already are ignored. How many rows were added."""
        gone = self.tombstones()
        live = self.members().join(gone, ["id", "g"], "left_anti")
        fresh = new.select(F.col(id).alias("id"), F.col(vector).alias("vector")).dropDuplicates(["id"]).join(live.select("id"), "id", "left_anti")
        before = self.members().count()
        self._add(fresh, None)
        return self.members().count() - before

    def remove(self, ids: DataFrame, id: str = "id") -> int:
        """Leaves tombstones for the rows of these ids; how many."""
        found = self.members().join(ids.select(F.col(id).alias("id")).distinct(), "id", "left_semi").join(self.tombstones(), ["id", "g"], "left_anti")
        before = self.tombstones().count()
        found.write.mode("append").parquet(f"{self.path}/tombstones")
        return self.tombstones().count() - before

    def _with(self, allowed: DataFrame | None, without: DataFrame | None) -> DataFrame:
        """(graph, gone, allowed): each graph with the ids that are no results and, if filtered, those that may be."""
        gone = self.tombstones()
        if without is not None:
            gone = gone.unionByName(self.members().join(without.select("id").distinct(), "id", "left_semi").select("id", "g"))
        by_graph = lambda rows, name: rows.groupBy("g").agg(F.collect_set("id").alias(name))  # noqa: E731  at most a graph's rows
        out = self.graphs().select("g", "graph").join(by_graph(gone, "gone"), "g", "left")
        if allowed is None:
            return out.select("graph", "gone", F.lit(None).cast(f"array<{self.id_type}>").alias("allowed"))
        some = self.members().join(allowed.select("id").distinct(), "id", "left_semi")
        return out.join(by_graph(some, "allowed"), "g").select("graph", "gone", "allowed")

    def search(self, queries: DataFrame, k: int = 10, ef: int = 200, q_id: str = "q_id", q_vector: str = "vector", allowed: DataFrame | None = None, without: DataFrame | None = None, exact: bool = False) -> DataFrame:
        """(q_id, rank, id, score) by all graphs; ``allowed`` (id) lists the rows that may be results, ``without`` those that may not; ``exact`` adds what walks missed."""
        ids, vectors = collected_queries(queries, q_id, q_vector)
        q_type, kind, filtered = _id_type(queries, q_id), self.id_type, allowed is not None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data, gone, some in zip(*batch.columns):
                    graph = Graph.loaded(data.as_py())
                    graph.remove(gone.as_py() or [])
                    mask = np.isin(graph.ids, np.array(some.as_py())) if filtered else None
                    found = [(q, i, s) for q, hits in zip(ids.tolist(), graph.search_many(vectors, k, ef, mask, exact)) for i, s in hits]
                    qs, own, worth = zip(*found) if found else ((), (), ())
                    arrow = lambda t: pa.string() if t == "string" else pa.int64()
                    yield pa.RecordBatch.from_arrays([pa.array(list(qs), arrow(q_type)), pa.array(list(own), arrow(kind)), pa.array(list(worth), pa.float64())], names=["q_id", "id", "score"])

        near = self._with(allowed, without).mapInArrow(run, f"q_id {q_type}, id {kind}, score double")
        rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("score").desc(), "id"))
        return near.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("q_id", "rank", "id", "score")

    def stats(self) -> DataFrame:
        """(g, nodes, tombstones, layers, average_degree) of each graph; layers counts the nodes that reach each."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, data, gone in zip(*batch.columns):
                    graph = Graph.loaded(data.as_py())
                    graph.remove(gone.as_py() or [])
                    s = graph.stats()
                    columns = [[g.as_py()], [s["nodes"]], [s["tombstones"]], [list(s["layers"].values())], [s["average_degree"]]]
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["g", "nodes", "tombstones", "layers", "average_degree"])

        gone = self.tombstones().groupBy("g").agg(F.collect_set("id").alias("gone"))
        both = self.graphs().select("g", "graph").join(gone, "g", "left")
        return both.mapInArrow(run, "g string, nodes bigint, tombstones bigint, layers array<bigint>, average_degree double")
