import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from arrowfen.functions.vector import check_batch_size
from arrowfen.plans import catalogue

REPO = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rounded(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(rounded, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in catalogue.ORACLES:
        assert got
        return
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    pick = [want.columns.index(c) for c in columns]
    assert sorted(repr(rounded([r[c] for c in columns])) for r in got) == sorted(repr(rounded([r[k] for k in pick])) for r in want.fetchall())


def test_graph_recall(spark):
    rows = catalogue.QUERIES["index_hnsw_recall"](spark, DATA).collect()
    assert sum(r.recall for r in rows) / len(rows) >= 0.95


def written(folder, n, copies=1, dims=8):
    """A folder with ``embeddings`` of n random rows, ``copies`` of each under ids far apart, and the other tables that their SQL reads."""
    import duckdb
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    v = np.tile(np.random.default_rng(3).normal(size=(n // copies, dims)).astype(np.float32), (copies, 1))
    ids = pa.array(range(len(v)), pa.int64())
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(v.tolist(), pa.list_(pa.float32())), "label": pa.array([i % 10 for i in range(len(v))], pa.int32())}), f"{folder}/embeddings.parquet")
    duck = duckdb.connect()
    for name, path in (("embeddings", f"{folder}/embeddings.parquet"), ("documents", f"{DATA}/documents.parquet")):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return str(folder), duck


def answers(spark, folder, duck, name):
    """The rows of a query and of its SQL, columns by name."""
    from arrowfen.plans import lifecycle  # noqa: F401  adds its queries

    df, want = catalogue.QUERIES[name](spark, folder), duck.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    pick = [want.columns.index(c) for c in columns]
    return sorted(tuple(r[c] for c in columns) for r in df.collect()), sorted(tuple(r[k] for k in pick) for r in want.fetchall())


def test_collection_searches_break_ties_by_number(spark, tmp_path):
    folder, duck = written(tmp_path, 1500, copies=3)
    for name in ("collection_search_flat", "collection_search_graph"):
        got, want = answers(spark, folder, duck, name)
        assert got == want


def test_automatic_index_misses_nothing_in_large_tables(spark, tmp_path):
    folder, duck = written(tmp_path, 10_100)
    got, want = answers(spark, folder, duck, "index_auto_search")
    assert got == want


def test_automatic_index_stats_of_large_tables(spark, tmp_path):
    folder, duck = written(tmp_path, 10_100)
    got, want = answers(spark, folder, duck, "index_auto_stats")
    assert got == want


def test_automatic_index_stats_beyond_all_thresholds(spark, tmp_path):
    folder, duck = written(tmp_path, 100_100)
    got, want = answers(spark, folder, duck, "index_auto_stats")
    assert got == want


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("vectors", [[], [None, None], [None, [1.0, 2.0]], [None, []]])
def test_automatic_index_stats_of_missing_vectors(spark, tmp_path, vectors, ansi):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    n, path = len(vectors), f"{tmp_path}/embeddings.parquet"
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * n, pa.int32())}), path)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got, want = answers(spark, str(tmp_path), duck, "index_auto_stats")
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert got == want


def test_queries_ask_for_every_hundredth_row_and_every_passage(spark):
    want = {r.id for r in catalogue.vectors(spark, DATA).where("id % 100 = 0").collect()}
    for name in ("knn_batch", "knn_batch_l2", "ivf_search_np1", "ivf_search_full", "hnsw_recall", "hnsw_tombstones", "hnsw_filtered", "index_auto_search"):
        assert {r.q_id for r in catalogue.QUERIES[name](spark, DATA).select("q_id").collect()} == want
    passages = {r.item_id for r in catalogue.table(spark, DATA, "benchmark").collect()}
    assert {r.q_id for r in catalogue.QUERIES["text_search_hashed"](spark, DATA).collect()} == passages
    asked = spark.range(0, 2_500_000, 100).withColumnRenamed("id", "q_id")
    sizes = []

    def search(some):
        check_batch_size(n := some.count())
        sizes.append(n)
        return some

    catalogue.in_batches(asked, search, apart=100)
    assert sizes == [10_000, 10_000, 5_000]
    assert all(r.reached for r in catalogue.QUERIES["hnsw_tombstones"](spark, DATA).collect())


def test_text_search_equals_brute_force(spark):
    import numpy as np

    from arrowfen.functions.embed import hashing

    embed = hashing(64)
    docs = {r.doc_id: np.array(embed(r.text)[0], np.float32).astype(float) for r in catalogue.table(spark, DATA, "documents").collect() if r.text is not None}
    got = {}
    for r in catalogue.QUERIES["text_search_hashed"](spark, DATA).collect():
        got.setdefault(r.q_id, {})[r["rank"]] = r.id
    ids, rows = np.array(list(docs)), np.array(list(docs.values()))
    for r in catalogue.table(spark, DATA, "benchmark").collect():
        q = np.array(embed(r.text)[0], np.float32).astype(float)
        lengths = np.linalg.norm(rows, axis=1) * np.linalg.norm(q)
        value = np.round(np.divide(rows @ q, lengths, out=np.zeros(len(rows)), where=lengths > 0), 9)
        mine = [value[np.flatnonzero(ids == got[r.item_id][k])[0]] for k in range(1, 11)]
        assert mine == sorted(value, reverse=True)[:10]


def test_clustered_recall(spark):
    for at in (DATA, DATA.replace("sf0.001", "sf0.1")):
        rows = catalogue.QUERIES["ivf_recall"](spark, at).collect()
        assert sum(r.recall for r in rows) / len(rows) >= 0.9


@pytest.mark.parametrize("name", ["index_ivf_recall", "index_hnsw_recall"])
def test_every_index_kind_reaches_its_recall(spark, name):
    rows = catalogue.QUERIES[name](spark, DATA.replace("sf0.001", "sf0.1")).collect()
    assert len(rows) == 20 and sum(r.recall for r in rows) / len(rows) >= 0.9


@pytest.mark.parametrize("gone", [("arrowfen/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_works_without_the_optional_parts(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for g in gone:
        target = copy / g
        if target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_cosine' in q and 'pipeline' not in q and e.oracle_sql(); import bench"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": f"{copy}:{REPO}"})
