import json
import math
import threading
import urllib.request
import uuid

import pytest

from arrowfen.config import AppConfig, IndexConfig
from arrowfen.functions.embed import mock
from arrowfen.functions.sql import register
from arrowfen.service import ROUTES, Service, serve


@pytest.fixture()
def service(spark, tmp_path):
    return Service(spark, str(tmp_path), embedder=mock())


def test_requests(service):
    ask = lambda m, p, b=None: service.handle(m, f"/api{p}", b)
    assert ask("GET", "/health") == (200, {"status": "ok"}) and ask("GET", "/nothing")[0] == 404
    assert ask("GET", "/collections/docs/count")[0] == 404 and ask("GET", "/collections")[1] == []
    assert ask("POST", "/collections", {"name": "bad name"})[0] == 400
    status, one = ask("POST", "/collections/docs/vectors", {"vector": [3, 4], "text": "first", "metadata": {"k": 1, "l": [1]}, "normalize": True})
    assert status == 200
    got = ask("GET", f"/collections/docs/vectors/{one['id']}")[1]
    assert got["vector"] == pytest.approx([0.6, 0.8]) and got["metadata"] == {"k": 1}
    status, many = ask("POST", "/v1/collections/docs/vectors", {"vectors": [[1, 0], [0, 1]], "texts": ["second", "third"]})
    assert status == 200 and many["count"] == 2 and ask("GET", "/collections/docs/count")[1] == {"count": 3}
    assert len(ask("GET", "/collections/docs/vectors?limit=2&offset=1")[1]) == 2
    hits = ask("POST", "/collections/docs/search", {"vector": [1, 0], "k": 2})[1]
    assert [h["text"] for h in hits] == ["second", "first"] and "vector" not in hits[0]
    batch = ask("POST", "/collections/docs/search", {"vectors": [[0, 1], [1, 0]], "k": 1})[1]
    assert [b[0]["text"] for b in batch] == ["third", "second"]
    assert [h["text"] for h in ask("POST", "/collections/docs/search/range", {"vector": [1, 0], "min_score": 0.9})[1]] == ["second"]
    for bad in ({"vector": [1, 0, 0]}, {"vector": [1, 0], "metric": "cosinee"}, {"vector": [1, 0], "preset": "balanced"}, {}):
        assert ask("POST", "/collections/docs/search", bad)[0] == 400
    own = str(uuid.uuid4())
    assert ask("POST", "/collections/docs/upsert", {"id": own, "vector": [1, 1], "text": "new"})[1] == {"id": own, "created": True}
    assert ask("POST", "/collections/docs/upsert", {"id": own, "vector": [1, 0], "text": "newer"})[1]["created"] is False
    assert ask("POST", "/collections/docs/upsert", {"id": "nonsense", "vector": [1, 1], "text": "x"})[0] == 400
    pairs = ask("POST", "/collections/docs/duplicates", {"threshold": 0.99})[1]
    assert len(pairs) == 1 and pairs[0]["score"] == pytest.approx(1)
    assert ask("GET", "/collections/docs/index/rebuild/status")[0] == 404
    assert ask("POST", "/collections/docs/index/rebuild")[1]["status"] in ("running", "completed")
    assert ask("POST", "/collections/docs/index/rebuild", {"wait": True})[1] == {"status": "completed"} == ask("GET", "/collections/docs/index/rebuild/status")[1]
    assert ask("GET", "/collections/docs/index/stats")[1]["kind"] == "flat"
    assert ask("DELETE", f"/collections/docs/vectors/{own}")[1] == {"deleted": True} and ask("DELETE", "/collections/docs/vectors", {"ids": [own]})[1] == {"deleted": 0}
    assert ask("POST", "/collections/docs/compact")[1]["live"] == 3
    assert ask("GET", "/metrics")[1]["totals"]["vectors"] == 3 and ask("GET", "/readyz")[1]["ok"]
    service.read_only = True
    assert ask("POST", "/collections/docs/vectors", {"vector": [1, 0], "text": "x"})[0] == 503
    service.read_only = False
    service.config = AppConfig(least_free_bytes=1 << 62)
    assert ask("POST", "/collections/docs/vectors", {"vector": [1, 0], "text": "x"})[0] == 503 and not ask("GET", "/readyz")[1]["ok"]
    service.config = AppConfig()
    assert ask("DELETE", "/collections/docs")[1] == {"deleted": True} and ask("GET", "/collections/docs")[0] == 404


@pytest.mark.parametrize("kind", ["ivf", "hnsw"])
def test_searches_go_through_the_index(spark, tmp_path, kind):
    config = AppConfig(index=IndexConfig(kind=kind, clusters=4))
    service = Service(spark, str(tmp_path), config)
    ask = lambda m, p, b=None: service.handle(m, f"/api{p}", b)[1]
    angle = lambda i: [math.cos(i / 7), math.sin(i / 7)]
    ids = ask("POST", "/collections/a/vectors", {"vectors": [angle(i) for i in range(40)], "texts": [f"t{i}" for i in range(40)], "metadata_list": [{"i": i} for i in range(40)]})["ids"]
    texts = lambda **b: [h["text"] for h in ask("POST", "/collections/a/search", {"vector": angle(10), "k": 3, **b})]
    assert texts() == ["t10", "t9", "t11"]  # and the missing index is built meanwhile
    assert ask("POST", "/collections/a/index/rebuild", {"wait": True}) == {"status": "completed"}
    stats = ask("GET", "/collections/a/index/stats")
    assert (stats["kind"], stats["vectors"], stats["pending"], sum(stats["lists"].values())) == (kind, 40, 0, 40 if kind == "ivf" else 0)
    assert texts(nprobe=4, ef=40) == ["t10", "t9", "t11"]
    if kind == "ivf":
        assert len(texts(preset="fast", k=40)) < 40 == len(texts(nprobe=4, k=40))  # one list, all lists
    ask("DELETE", f"/collections/a/vectors/{ids[9]}")
    ask("POST", "/collections/a/upsert", {"id": ids[30], "vector": angle(10.1), "text": "moved"})
    assert texts(nprobe=4) == ["t10", "moved", "t11"] and ask("GET", "/collections/a/index/stats")["pending"] == 2
    other = Service(spark, str(tmp_path), config)  # opened again: the index is there
    assert [h["text"] for h in other.handle("POST", "/api/collections/a/search", {"vectors": [angle(10), angle(20)], "k": 1, "nprobe": 4})[1][1]] == ["t20"] and "a" not in other.jobs
    assert ask("POST", "/collections/a/compact")["live"] == 39
    service.shutdown()
    assert service.jobs["a"] == "completed" and ask("GET", "/collections/a/index/stats")["pending"] == 0 and texts(nprobe=4) == ["t10", "moved", "t11"]
    assert service.handle("POST", "/api/collections/a/vectors", {"vector": [1, 0], "text": "x"})[0] == 503


def test_cached_rows_follow_the_collection(spark, tmp_path):
    service = Service(spark, str(tmp_path), AppConfig(cache_rows=3, cache_bytes=250))
    ask = lambda m, p, b=None: service.handle(m, f"/api{p}", b)[1]
    add = lambda c, t: ask("POST", f"/collections/{c}/vectors", {"vector": [1, len(t)], "text": t})
    top = lambda c: [h["text"] for h in ask("POST", f"/collections/{c}/search", {"vector": [1, 9], "k": 1})]
    add("a", "xx")
    assert ask("POST", "/collections/a/warm")["cached"] and top("a") == ["xx"]
    add("a", "x" * 9)
    assert top("a") == ["x" * 9]  # another commit: read anew
    seq = service.cache.held[service.catalogue.get("a").path].seq
    assert seq == service.catalogue.get("a").last_seq()
    for _ in range(2):
        add("a", "y")
    assert top("a") == ["x" * 9] and service.cache.held == {}  # four rows are too many
    for c, n in (("b", 100), ("c", 150)):
        add(c, "z" * n)
        assert ask("POST", f"/collections/{c}/warm")["bytes"] <= 250
    assert [p[-1] for p in service.cache.held] == ["b"]  # over budget the largest goes


def test_texts_and_server(service):
    service.handle("POST", "/api/collections/t/embed", {"texts": ["aa", "bbbb", "c" * 9]})
    found = service.handle("POST", "/api/collections/t/search/text", {"query": "xxxxx", "k": 1, "metric": "euclidean"})
    assert found[0] == 200 and found[1][0]["text"] == "bbbb"
    server = serve(service, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/version") as r:
        assert json.load(r)["version"] and r.headers["X-Request-Id"]
    server.shutdown()
    service.embedder = None
    assert service.handle("GET", "/api/health/embeddings")[0] == 503
    assert len(ROUTES) >= 27


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT vec_cosine(array(1, 0), array(0, 0)) a, vec_dot(array(1, 2), array(3, 4)) b, vec_l2(array(0, 0), array(3, 4)) c, vec_l2_score(array(1), array(1)) d, vec_binary_cosine(array(1, -1), array(1, 1)) e").first()
    assert tuple(row) == (0.0, 11.0, 5.0, 1.0, 0.0)
    with pytest.raises(Exception, match="same length"):
        spark.sql("SELECT vec_dot(array(1), array(1, 2))").collect()
