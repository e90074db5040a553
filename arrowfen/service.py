"""The request interface: methods and paths over collections, as JSON in and out.

``Service.handle`` answers a request; ``serve`` puts it behind the standard
library's HTTP server. Each answer comes from DataFrame operators; only the k
rows, the page or the counts of an answer reach the driver.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import AppConfig, SearchConfig, load_config, metric_name, search_config
from .errors import ArrowfenError, InvalidRequestError, NotFoundError, UnavailableError
from .functions.embed import Embedder
from .functions.telemetry import average_step, vector_bytes
from .functions.vector import MAX_TEXT_BYTES, check_batch_size, normalized
from .operators.dedup import pairs_above, pairs_of_neighbours
from .operators.knn import knn
from .sources.cache import RowCache
from .sources.indexed import build_index, opened_index
from .sources.indexed import search as indexed_search
from .sources.shared import filesystem, hadoop_path
from .sources.store import ROW, Catalogue, Collection

Route = tuple[str, re.Pattern, Callable]
ROUTES: list[Route] = []


def route(method: str, path: str) -> Callable:
    def add(f: Callable) -> Callable:
        ROUTES.append((method, re.compile("/api(?:/v1)?" + re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", path) + r"\Z"), f))
        return f

    return add


def metadata_text(value: dict | None) -> str:
    """A JSON object with scalar fields only, as requests may bring it; arrays and objects are dropped."""
    return json.dumps({k: v for k, v in (value or {}).items() if not isinstance(v, (list, dict))})


class Service:
    """All requests over one root folder."""

    def __init__(self, spark: SparkSession, root: str, config: AppConfig = AppConfig(), embedder: Embedder | None = None) -> None:
        self.spark, self.config, self.embedder = spark, config, embedder
        self.catalogue = Catalogue(spark, root, config)
        self.cache = RowCache(config.cache_rows, config.cache_bytes)
        self.latency: dict[str, list[int]] = {}
        self.embeds = {"requests": 0, "texts": 0, "tokens": 0}
        self.jobs: dict[str, str] = {}
        self.threads: dict[str, threading.Thread] = {}
        self.slow: list[tuple[str, int]] = []
        self.read_only = self.stopping = False

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, Any]:
        """(status, answer); library errors become their status."""
        parts, began = urlsplit(path), time.perf_counter()
        for verb, pattern, f in ROUTES:
            m = pattern.match(parts.path)
            if verb == method and m:
                try:
                    answer = f(self, {**dict(parse_qsl(parts.query)), **(body or {})}, **m.groupdict())
                except ArrowfenError as e:
                    return e.status, {"error": str(e)}
                except (KeyError, TypeError, ValueError) as e:
                    return 400, {"error": f"{type(e).__name__}: {e}"}
                us = int((time.perf_counter() - began) * 1e6)
                n, average = self.latency.get(f.__name__, [0, 0])
                self.latency[f.__name__] = [n + 1, average_step(average, n, us)]
                if us > 1000 * self.config.slow_query_ms:
                    self.slow = [*self.slow[-99:], (f"{method} {path}", us // 1000)]
                return 200, answer
        return 404, {"error": "no such route"}

    def _writable(self, name: str) -> Collection:
        if self.read_only or self.stopping:
            raise UnavailableError("the service is shutting down" if self.stopping else "the service is read-only")
        if self.config.least_free_bytes and self.free_bytes() < self.config.least_free_bytes:
            raise UnavailableError("too little disk space is left to write")
        return self.catalogue.get_or_create(name)

    def free_bytes(self) -> int:
        """What the file system of the collections has left."""
        root = self.catalogue.root
        return filesystem(self.spark, root).getStatus(hadoop_path(self.spark, root)).getRemaining()

    def shutdown(self) -> None:
        """Refuses further writes and waits for running rebuilds."""
        self.stopping = True
        for thread in list(self.threads.values()):
            thread.join()

    def rebuild(self, name: str) -> str:
        """Starts building the index of a collection, unless that runs already; the job's status."""
        c = self.catalogue.get(name)
        if self.jobs.get(name) != "running":
            self.jobs[name] = "running"

            def run() -> None:
                try:
                    build_index(c)
                    self.jobs[name] = "completed"
                except Exception:  # noqa: BLE001  the status tells
                    self.jobs[name] = "failed"

            self.threads[name] = threading.Thread(target=run, daemon=True)
            self.threads[name].start()
        return self.jobs[name]

    def opened(self, name: str) -> Collection:
        """A collection to search; where its settings name an index that it lacks, one is built meanwhile."""
        c = self.catalogue.get(name)
        if name not in self.jobs and c.index_commit() is None and self.config.index.kind in ("ivf", "hnsw"):
            self.rebuild(name)
        return c

    def _rows(self, items: list[tuple[str, list[float], str, str]], unit: bool = False) -> DataFrame:
        if any(not t or len(t.encode()) > MAX_TEXT_BYTES for _, _, t, _ in items):
            raise InvalidRequestError(f"a text has 1 to {MAX_TEXT_BYTES} bytes")
        df = self.spark.createDataFrame([(i, [float(x) for x in v], t, m) for i, v, t, m in items], ROW)
        return df.withColumn("vector", normalized(F.col("vector")).cast("array<float>")) if unit else df

    def _vector_of(self, text: str) -> list[float]:
        if self.embedder is None:
            raise UnavailableError("no embedder is configured")
        vector, tokens = self.embedder(text)
        self.embeds = {"requests": self.embeds["requests"] + 1, "texts": self.embeds["texts"] + 1, "tokens": self.embeds["tokens"] + (tokens or 0)}
        return vector

    def _query(self, name: str, query: list[float], body: dict) -> list[dict]:
        c, k = self.opened(name), int(body.get("k", 10))
        settings = search_config(self.config.search, body.get("preset"), body.get("ef"), body.get("nprobe"), body.get("overfetch"))
        d = c.dimensions()
        if d is not None and d != len(query):
            raise InvalidRequestError(f"the query has {len(query)} dimensions, the collection {d}")
        index = c.index_commit()
        if index is None or index["kind"] == "flat":
            return [shown(r) for r in knn(self.cache.rows(c), query, k, body.get("metric")).drop("vector").collect()]
        asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "q_id long, vector array<double>")
        return self.hits(c, asked, k, body.get("metric"), settings).get(0, [])

    def hits(self, c: Collection, asked: DataFrame, k: int, metric: str | None, settings: SearchConfig) -> dict[int, list[dict]]:
        """The results of each query, with text and metadata."""
        found = indexed_search(c, asked, k, metric, settings)
        out: dict[int, list[dict]] = {}
        for r in F.broadcast(found).join(c.rows().drop("vector"), "id").orderBy("q_id", "rank").collect():
            out.setdefault(r.q_id, []).append({x: v for x, v in shown(r).items() if x not in ("q_id", "rank")})
        return out


def shown(row: Any) -> dict:
    out = row.asDict()
    if "metadata" in out:
        out["metadata"] = json.loads(out["metadata"] or "{}")
    return out


@route("GET", "/health")
def health(s: Service, body: dict) -> dict:
    return {"status": "ok"}


@route("GET", "/health/embeddings")
def health_embeddings(s: Service, body: dict) -> dict:
    if s.embedder is None:
        raise UnavailableError("no embedder is configured")
    return {"status": "ok"}


@route("GET", "/readyz")
def readyz(s: Service, body: dict) -> dict:
    found, free = s.catalogue.health(), s.free_bytes()
    ready = all(x["ok"] for x in found) and not s.stopping and free >= s.config.least_free_bytes
    return {"ok": ready, "collections": found, "log_bytes": sum(x.get("log_bytes", 0) for x in found), "disk_free_bytes": free, "read_only": s.read_only}


@route("GET", "/metrics")
def metrics(s: Service, body: dict) -> dict:
    counts = {n: s.catalogue.get(n).info().first().asDict() for n in s.catalogue.names()}
    totals = {"collections": len(counts), "vectors": sum(x["count"] for x in counts.values()), "bytes": sum(x["bytes"] for x in counts.values())}
    return {"totals": totals, "collections": counts, "latency_us": {k: v[1] for k, v in s.latency.items()}, "embeddings": s.embeds, "slow": s.slow}


@route("GET", "/version")
def version(s: Service, body: dict) -> dict:
    return {"version": __version__, "spark": s.spark.version}


@route("GET", "/config")
def config(s: Service, body: dict) -> dict:
    return s.config.shown()


@route("POST", "/config/reload")
def reload_config(s: Service, body: dict) -> dict:
    s.config = load_config(body.get("path"))
    s.catalogue.config = s.config
    s.cache.most_rows, s.cache.most_bytes = s.config.cache_rows, s.config.cache_bytes
    return s.config.shown()


@route("GET", "/collections")
def collections(s: Service, body: dict) -> list:
    return [{"name": n, "count": s.catalogue.get(n).rows().count()} for n in s.catalogue.names()]


@route("POST", "/collections")
def create(s: Service, body: dict) -> dict:
    return {"name": s.catalogue.get_or_create(body["name"]).name}


@route("GET", "/collections/{c}")
def collection(s: Service, body: dict, c: str) -> dict:
    return s.catalogue.get(c).info().first().asDict()


@route("DELETE", "/collections/{c}")
def drop(s: Service, body: dict, c: str) -> dict:
    s.jobs.pop(c, None)
    s.cache.drop(s.catalogue.get(c))
    return {"deleted": s.catalogue.get(c).drop()}


@route("GET", "/collections/{c}/count")
def count(s: Service, body: dict, c: str) -> dict:
    return {"count": s.catalogue.get(c).rows().count()}


@route("GET", "/collections/{c}/index/stats")
def index_stats(s: Service, body: dict, c: str) -> dict:
    own = s.catalogue.get(c)
    index, changes = opened_index(own)
    lists = {r.cid: r.n for r in index.ivf.sizes().collect()} if index.ivf else {}
    known = index.stats().first().asDict()
    return {**known, "lists": lists, "pending": 0 if changes is None else changes.count(), "wanted": own.config.index.choose(known["vectors"])}


@route("POST", "/collections/{c}/index/rebuild")
def rebuild(s: Service, body: dict, c: str) -> dict:
    """Builds in the background; with ``wait``, until it is done."""
    s.rebuild(c)
    if body.get("wait"):
        s.threads[c].join()
    return {"status": s.jobs[c]}


@route("GET", "/collections/{c}/index/rebuild/status")
def rebuild_status(s: Service, body: dict, c: str) -> dict:
    if c not in s.jobs:
        raise NotFoundError(c)
    return {"status": s.jobs[c]}


@route("POST", "/collections/{c}/warm")
def warm(s: Service, body: dict, c: str) -> dict:
    """Reads a collection into memory, where searches find it until it changes."""
    own = s.catalogue.get(c)
    s.cache.warm(own)
    return {"cached": own.path in s.cache.held, "bytes": sum(s.cache.sizes().values())}


@route("POST", "/collections/{c}/compact")
def compact(s: Service, body: dict, c: str) -> dict:
    """Also rebuilds the index, if there is one."""
    own = s._writable(c)
    stats = own.compact()
    if own.index_commit() is not None:
        s.rebuild(c)
    return stats


@route("POST", "/collections/{c}/duplicates")
def duplicates(s: Service, body: dict, c: str) -> list:
    rows, threshold, limit = s.catalogue.get(c).rows(), float(body.get("threshold", 0.95)), int(body.get("limit", 100))
    if body.get("k") is not None:
        found = pairs_of_neighbours(rows, threshold, body.get("metric"), int(body["k"]), limit)
    else:
        found = pairs_above(rows, threshold, body.get("metric")).orderBy(F.col("score").desc(), "id_a", "id_b").limit(limit)
    return [r.asDict() for r in found.collect()]


@route("GET", "/collections/{c}/vectors")
def list_vectors(s: Service, body: dict, c: str) -> list:
    page = s.catalogue.get(c).rows().orderBy("id").offset(int(body.get("offset", 0))).limit(int(body.get("limit", 100)))
    return [shown(r) for r in page.collect()]


@route("POST", "/collections/{c}/vectors")
def insert(s: Service, body: dict, c: str) -> dict:
    """One (vector, text) or many (vectors, texts); ids are fresh."""
    many = "vectors" in body
    vectors, texts = (body["vectors"], body["texts"]) if many else ([body["vector"]], [body["text"]])
    check_batch_size(len(texts))
    if len(vectors) != len(texts):
        raise InvalidRequestError("as many vectors as texts are needed")
    meta = body.get("metadata_list") or [] if many else [body.get("metadata")]
    items = [(str(uuid.uuid4()), v, t, metadata_text(meta[i] if i < len(meta) else None)) for i, (v, t) in enumerate(zip(vectors, texts))]
    s._writable(c).insert(s._rows(items, bool(body.get("normalize"))))
    return {"ids": [x[0] for x in items], "count": len(items)} if many else {"id": items[0][0]}


@route("DELETE", "/collections/{c}/vectors")
def delete_batch(s: Service, body: dict, c: str) -> dict:
    check_batch_size(len(body["ids"]))
    s.catalogue.get(c)  # a missing one isn't made
    return {"deleted": s._writable(c).delete(s.spark.createDataFrame([(i,) for i in set(body["ids"])], "id string"))}


@route("GET", "/collections/{c}/vectors/{id}")
def get_vector(s: Service, body: dict, c: str, id: str) -> dict:
    found = s.catalogue.get(c).rows().where(F.col("id") == id).first()
    if found is None:
        raise NotFoundError(id)
    return shown(found)


@route("DELETE", "/collections/{c}/vectors/{id}")
def delete_vector(s: Service, body: dict, c: str, id: str) -> dict:
    return {"deleted": delete_batch(s, {"ids": [id]}, c)["deleted"] == 1}


@route("POST", "/collections/{c}/upsert")
def upsert(s: Service, body: dict, c: str) -> dict:
    id = str(uuid.UUID(body["id"])) if body.get("id") else str(uuid.uuid4())
    own = s._writable(c)
    created = own.rows().where(F.col("id") == id).isEmpty()
    own.upsert(s._rows([(id, body["vector"], body["text"], metadata_text(body.get("metadata")))], bool(body.get("normalize"))))
    return {"id": id, "created": created}


@route("POST", "/collections/{c}/search")
def search(s: Service, body: dict, c: str) -> Any:
    if ("vector" in body) == ("vectors" in body):
        raise InvalidRequestError("either vector or vectors is needed")
    if "vector" in body:
        return s._query(c, body["vector"], body)
    check_batch_size(len(body["vectors"]))
    metric_name(body.get("metric"))
    own = s.opened(c)
    settings = search_config(s.config.search, body.get("preset"), body.get("ef"), body.get("nprobe"), body.get("overfetch"))
    asked = s.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(body["vectors"])], "q_id long, vector array<double>")
    found = s.hits(own, asked, int(body.get("k", 10)), body.get("metric"), settings)
    return [found.get(i, []) for i in range(len(body["vectors"]))]


@route("POST", "/collections/{c}/search/range")
def search_range(s: Service, body: dict, c: str) -> list:
    return [h for h in s._query(c, body["vector"], body) if h["score"] >= float(body["min_score"])]


@route("POST", "/collections/{c}/search/text")
def search_text(s: Service, body: dict, c: str) -> list:
    return s._query(c, s._vector_of(body["query"]), body)


@route("POST", "/collections/{c}/embed")
def embed(s: Service, body: dict, c: str) -> dict:
    many = "texts" in body
    texts = body["texts"] if many else [body["text"]]
    return insert(s, {"vectors": [s._vector_of(t) for t in texts], "texts": texts, "metadata_list": body.get("metadata_list") or [body.get("metadata")] * len(texts)}, c)


def serve(service: Service, port: int = 6333, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``; requests up to 100 MB."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size)) if 0 < size <= 100 << 20 else None
                status, found = service.handle(self.command, self.path, body)
            except ValueError as e:
                status, found = 400, {"error": str(e)}
            data = json.dumps(found, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("X-Request-Id", self.headers.get("X-Request-Id") or str(uuid.uuid4()))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _answer  # noqa: N815

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
