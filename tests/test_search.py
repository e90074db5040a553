from collections import Counter

import numpy as np
import pytest

from arrowfen.config import IndexConfig, SearchConfig
from arrowfen.errors import IndexStateError, InvalidRequestError
from arrowfen.functions.metadata import Filter
from arrowfen.operators import dedup, graph, ivf, knn
from arrowfen.operators.index import VectorIndex


@pytest.fixture(scope="module")
def cloud(spark):
    pick = np.random.default_rng(5)
    v = pick.normal(size=(600, 16)).astype(np.float32)
    v[300:330] = v[:30] + 0.01  # near copies
    df = spark.createDataFrame([(i, x.tolist(), i % 4) for i, x in enumerate(v)], "id long, vector array<float>, label int").repartition(5)
    return df.cache(), v.astype(np.float64)


def exact(v, q, metric):
    if metric == "dot":
        s = v @ q
    elif metric == "cosine":
        s = v @ q / np.linalg.norm(v, axis=1) / np.linalg.norm(q)
    else:
        s = 1 / (1 + np.linalg.norm(v - q, axis=1))
    return s, np.lexsort((np.arange(len(v)), -s))


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_single_and_batch_search_equal_brute_force(spark, cloud, metric):
    df, v = cloud
    queries = spark.createDataFrame([(f"q{i}", v[i].tolist()) for i in range(5)], "q_id string, vector array<double>")
    batch = {}
    for r in knn.knn_batch(df, queries, 7, metric).collect():
        batch.setdefault(r.q_id, {})[r.rank] = (r.id, r.score)
    for i in range(5):
        s, order = exact(v, v[i], metric)
        single = knn.knn(df, v[i], 7, metric).collect()
        assert [r.id for r in single] == order[:7].tolist() == [batch[f"q{i}"][k][0] for k in range(1, 8)]
        assert [r.score for r in single] == pytest.approx(s[order[:7]].tolist())
        assert [batch[f"q{i}"][k][1] for k in range(1, 8)] == pytest.approx(s[order[:7]].tolist(), abs=1e-6)


def test_small_collection(spark):
    rows = [("vec0", [1.0, 0.0, 0.0], "rust"), ("vec1", [0.0, 1.0, 0.0], "go"), ("vec2", [0.0, 0.0, 1.0], None), ("vec3", [0.9, 0.1, 0.0], "python"), ("none", None, "rust")]
    df = spark.createDataFrame(rows, "id string, vector array<float>, lang string")
    assert [r.id for r in knn.knn(df, [1.0, 0, 0], 2).collect()] == ["vec0", "vec3"]
    assert [r.id for r in knn.knn(df, [1.0, 0, 0], 5, where=Filter().eq("lang", "rust")).collect()] == ["vec0"]
    assert [r.id for r in knn.knn(df, [0.0, 0, 0], 2).collect()] == ["vec0", "vec1"]  # a zero query: all score 0
    late = knn.knn(df, [1.0, 0, 0], 1, where=Filter().eq("lang", "go"), filter_mode="post", config=SearchConfig(filter_overfetch=2))
    assert late.collect() == []  # not among the best two
    assert [r.id for r in knn.range_topk(df, [1.0, 0, 0], 0.5).collect()] == ["vec0", "vec3"]
    assert {r.id for r in knn.radius(df, [1.0, 0, 0], 0.2).collect()} == {"vec0", "vec3"}
    assert [r.id for r in knn.knn(df, [1.0, 0, 0], 4, "dot", rank_metric="euclidean").collect()][:2] == ["vec0", "vec3"]
    for bad in ([], [float("nan")]):
        with pytest.raises(InvalidRequestError):
            knn.knn(df, bad)
    with pytest.raises(InvalidRequestError):
        knn.knn_batch(df, df.where("false").withColumnRenamed("id", "q_id"))
    with pytest.raises(Exception, match="same length"):
        knn.knn(df, [1.0, 0]).collect()


def test_duplicates_equal_brute_force_for_any_blocks(cloud):
    df, v = cloud
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    s = unit @ unit.T
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= 0.8}
    for blocks, rows in ((1, 1000), (4, 2000), (3, 50)):
        assert {(r.id_a, r.id_b) for r in dedup.pairs_above(df, 0.8, blocks=blocks, block_rows=rows).collect()} == want
    for rows in (2000, 40):
        for metric, threshold, value in (("cosine", 0.8, s), ("cosine", 0.3, s), ("euclidean", 0.5, 1 / (1 + np.linalg.norm(v[:, None] - v[None], axis=2)))):
            far = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if value[i, j] >= threshold}
            met = [(r.id_a, r.id_b) for r in dedup.pairs_above(df, threshold, metric, block_rows=rows, pivot_rows=1).collect()]
            assert len(met) == len(set(met)) and set(met) == far and len(far) >= 30
    near = {(r.id_a, r.id_b) for r in dedup.pairs_of_neighbours(df, 0.8, k=599).collect()}
    assert near == want and len(want) >= 30
    best = dedup.pairs_of_neighbours(df, 0.8, limit=5).collect()
    assert len(best) == 5 and all(r.score >= 0.99 for r in best)
    assert dedup.pairs_above(df.where("false"), 0.8).collect() == [] == dedup.pairs_above(df.where("false"), 0.8, pivot_rows=0).collect()
    assert [dedup.neighbour_count(*a) for a in ((100,), (100, 5), (100, None, 3), (10, None, 30), (1,))] == [49, 5, 10, 9, 1]


def test_clustered_index(spark, cloud, tmp_path):
    df, v = cloud
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(8)], "q_id long, vector array<double>")
    flat = Counter((r.q_id, r.rank, r.id) for r in knn.knn_batch(df, queries, 10).collect())
    index = ivf.IvfIndex.build(df, 12, 3)
    index.save(f"{tmp_path}/i")
    for own in (index, ivf.IvfIndex.load(spark, f"{tmp_path}/i")):
        assert Counter((r.q_id, r.rank, r.id) for r in own.search(queries, 10, nprobe=12).collect()) == flat
    some = {(r.q_id, r.id) for r in index.search(queries, 10, nprobe=4).collect()}
    assert len(some & {(q, i) for q, _, i in flat}) / len(flat) > 0.5
    assert sum(r.n for r in index.sizes().collect()) == 600
    new = spark.createDataFrame([(5, v[5].tolist(), 0), (900, v[0].tolist(), 0), (900, v[0].tolist(), 0)], "id long, vector array<float>, label int")
    grown = index.insert(new)
    assert grown.rows.count() == 601
    assert [r.id for r in grown.search(queries.where("q_id = 0"), 2, 12).orderBy("rank").collect()] == [0, 900]
    assert grown.remove(new).rows.count() == 599
    empty = ivf.IvfIndex(np.zeros((0, 16)), df.selectExpr("*", "0L AS cid"))
    assert Counter((r.q_id, r.rank, r.id) for r in empty.search(queries, 10).collect()) == flat  # falls back to all rows
    assert ivf.auto_parameters(100) == (10, 1, 10) and ivf.auto_parameters(100_000) == (316, 10, 10)


def test_rows_wait_until_there_are_as_many_as_lists(spark, cloud):
    df, v = cloud
    queries = spark.createDataFrame([(1, v[1].tolist())], "q_id long, vector array<double>")
    few = ivf.IvfIndex.build(df.where("id < 3"), 4)
    assert len(few.centroids) == 0 and [r.id for r in few.search(queries, 1).collect()] == [1]
    more = few.insert(df.where("id < 5"))
    assert len(more.centroids) == 4 and more.rows.count() == 5 == sum(r.n for r in more.insert(df.where("id < 2")).sizes().collect())


def test_clustered_index_probes_until_recall_is_reached(spark, cloud):
    df, v = cloud
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 600, 10)], "q_id long, vector array<double>")
    index = ivf.IvfIndex.build(df)
    for metric in ("cosine", "euclidean"):
        flat = {(r.q_id, r.id) for r in knn.knn_batch(df, queries, 10, metric).collect()}
        near = {(r.q_id, r.id) for r in index.search(queries, 10, metric=metric).collect()}
        assert len(near & flat) / len(flat) >= 0.9
    assert index.search(queries.where("q_id = 0"), 10, nprobe=1).count() <= 10


def test_pivots_keep_far_rows_apart(spark):
    pick = np.random.default_rng(3)
    v = np.concatenate([pick.normal(size=16) * 8 + pick.normal(size=(60, 16)) * 0.1 for _ in range(20)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").repartition(4)
    pivots = dedup._pivots(df, len(v), "id", "vector")
    copies = dedup._meeting(df, pivots, float(np.arccos(0.999)), "cosine", "bigint", 2000).groupBy("id").count().agg({"count": "avg"}).first()[0]
    assert copies < 5 < len(pivots)  # of about 34 homes


def test_graph_index(spark, cloud, tmp_path):
    df, v = cloud
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(20)], "q_id long, vector array<double>")
    for metric in ("cosine", "euclidean", "dot"):
        flat = {(r.q_id, r.id) for r in knn.knn_batch(df, queries, 10, metric).collect()}
        index = graph.GraphIndex.build(df, f"{tmp_path}/{metric}", metric)
        near = {(r.q_id, r.id) for r in index.search(queries, 10, ef=100).collect()}
        assert len(near & flat) / len(flat) >= 0.95
    index = graph.GraphIndex.load(spark, f"{tmp_path}/cosine")  # stored: no graph is built again
    some = df.where("label = 2")
    flat = {(r.q_id, r.id) for r in knn.knn_batch(some, queries, 10).collect()}
    near = {(r.q_id, r.id) for r in index.search(queries, 10, allowed=some).collect()}
    assert near == flat  # so few that they are compared directly
    gone = df.where("label = 1")
    assert index.remove(gone) == 150 and index.remove(gone) == 0
    live = df.where("label <> 1")
    flat = {(r.q_id, r.id) for r in knn.knn_batch(live, queries, 10).collect()}
    near = {(r.q_id, r.id) for r in graph.GraphIndex.load(spark, f"{tmp_path}/cosine").search(queries, 10).collect()}
    assert len(near & flat) / len(flat) >= 0.95 and not {i % 4 for _, i in near} & {1}
    assert index.insert(df.where("id < 20")) == 5  # those that were removed come back
    stats = index.stats().collect()
    assert sum(r.tombstones for r in stats) == 150 and sum(r.nodes for r in stats) == 455 and all(r.layers[0] == r.nodes + r.tombstones and r.average_degree > 3 for r in stats)
    with pytest.raises(IndexStateError):
        graph.Graph.loaded(b"broken")


def test_one_graph():
    pick = np.random.default_rng(6)
    v = pick.normal(size=(3000, 24))
    one = graph.Graph(v, np.arange(3000))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    asked, allowed = pick.normal(size=(30, 24)), np.arange(3000) % 2 == 0
    for mask in (None, allowed, np.arange(3000) % 100 == 0):
        value = asked @ unit.T
        if mask is not None:
            value[:, ~mask] = -np.inf
        want = np.argsort(-value, axis=1)[:, :10]
        hits = [len({i for i, _ in got} & set(w)) for got, w in zip(one.search_many(asked, 10, 200, mask), want.tolist())]
        assert sum(hits) / 300 >= 0.95
    again = graph.Graph.loaded(one.dumped())
    assert [i for i, _ in again.search(v[7], 5)] == [i for i, _ in one.search(v[7], 5)]
    assert again.remove([7, 8, 9999]) == 2 and again.remove([7]) == 0 and again.search(v[7], 1)[0][0] != 7 and len(again) == 2998
    none = graph.Graph(np.zeros((0, 3)), np.zeros(0))
    assert none.search(np.ones(3), 5) == [] and none.stats()["nodes"] == 0
    single = graph.Graph(np.ones((1, 3)), np.array(["a"]))
    assert single.search(np.ones(3), 5) == [("a", pytest.approx(1))] and single.remove(["a"]) == 1 and single.search(np.ones(3), 5) == []
    far = np.concatenate([pick.normal(size=8) * 30 + pick.normal(size=(50, 8)) * 0.1 for _ in range(30)])
    apart = graph.Graph(far, np.arange(len(far)), "euclidean")
    assert all(got[0][0] // 50 == i // 50 for i, got in zip(range(0, 1500, 50), apart.search_many(far[::50], 5, 50)))


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_exact_graph_search_misses_nothing(spark, tmp_path, metric):
    pick = np.random.default_rng(9)
    v = np.repeat(pick.normal(size=(2500, 48)), 2, axis=0).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>")
    queries, some = df.where("id % 50 = 0").selectExpr("id AS q_id", "vector"), df.where("id % 3 = 0")
    index = graph.GraphIndex.build(df, f"{tmp_path}/g", metric)
    found = lambda rows: {(r.q_id, r.id) for r in rows.collect()}
    for allowed, rows in ((None, df), (some, some)):
        want = found(knn.knn_batch(rows, queries, 10, metric))
        assert len(found(index.search(queries, 10, 20, allowed=allowed))) == len(want)
        assert found(index.search(queries, 10, 20, allowed=allowed, exact=True)) == want
    assert found(index.search(queries, 10, 20)) != found(index.search(queries, 10, 20, exact=True))
    lists = VectorIndex.build(df, IndexConfig(kind="ivf", metric=metric, clusters=12, nprobe=1, iterations=1), path=f"{tmp_path}/i")
    want = found(knn.knn_batch(df, queries, 10, metric))
    assert found(lists.search(queries, 10)) != want and found(lists.search(queries, 10, SearchConfig(exact=True))) == want


def test_stored_lists_are_pruned(spark, cloud, tmp_path):
    df, v = cloud
    ivf.IvfIndex.build(df, 12, 3).save(f"{tmp_path}/i")
    index = ivf.IvfIndex.load(spark, f"{tmp_path}/i")
    queries = spark.createDataFrame([(0, v[0].tolist())], "q_id long, vector array<double>")
    found = index.search(queries, 3, nprobe=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cid" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert found.count() == 3


@pytest.mark.parametrize("config", [IndexConfig(), IndexConfig(flat_below=10, ivf_below=1000, clusters=8, nprobe=8), IndexConfig(kind="hnsw", ef=300)])
def test_every_access_path_answers_alike(spark, cloud, tmp_path, config):
    df, v = cloud
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(6)], "q_id long, vector array<double>")
    flat = {(r.q_id, r.id) for r in knn.knn_batch(df, queries, 10).collect()}
    index = VectorIndex.build(df, config)
    assert index.kind == config.access_path(600) and index.stats().first().vectors == 600
    index.save(f"{tmp_path}/i")
    for own in (index, VectorIndex.load(spark, f"{tmp_path}/i", index.kind, config)):
        near = {(r.q_id, r.id) for r in own.search(queries).collect()}
        assert len(near & flat) / len(flat) >= (0.95 if index.kind == "hnsw" else 1)
    new = spark.createDataFrame([(700, v[0].tolist(), 0), (700, v[0].tolist(), 0), (1, v[2].tolist(), 0)], "id long, vector array<float>, label int")
    grown = index.insert(new)
    assert [r.id for r in grown.search(queries.where("q_id = 0"), 2).orderBy("rank").collect()] == [0, 700]
    assert grown.remove(new).stats().first().vectors == 599
