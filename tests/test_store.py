import json
import math
import random
import threading
import time

import pytest

from arrowfen.config import AppConfig, Limits
from arrowfen.errors import ConfigError, EmbeddingError, InvalidRequestError, NotFoundError, StorageError
from arrowfen.functions import embed as E
from arrowfen.functions import telemetry as T
from arrowfen.operators import mutate
from arrowfen.sources.store import Catalogue, Collection
from arrowfen.sources.wal import read_wal, replayed, write_wal
from arrowfen.streaming.wal_stream import merge_log, merged_rows, windowed_counts

ROW = "id string, vector array<float>, text string, metadata string"


def rows(spark, *items):
    return spark.createDataFrame([(i, [float(x) for x in v], t, m) for i, v, t, m in items], ROW)


def state(c):
    return {r.id: (r.vector, r.text, r.metadata) for r in c.rows().collect()}


def test_life_of_a_collection(spark, tmp_path):
    cat = Catalogue(spark, str(tmp_path))
    with pytest.raises(NotFoundError):
        cat.get("docs")
    assert cat.names() == []
    for bad in ("", "bad name", "a/b"):
        with pytest.raises(InvalidRequestError):
            cat.get_or_create(bad)
    c = cat.get_or_create("docs")
    c.insert(rows(spark, ("a", [1, 2], "first", "{}"), ("b", [3, 4], "second", None)))
    assert state(cat.get("docs")) == {"a": ([1, 2], "first", "{}"), "b": ([3, 4], "second", None)}
    c.upsert(rows(spark, ("b", [5, 6], "new", "{}"), ("c", [7, 8], "third", None)))
    log = {(r.type, r.id) for r in c.log().collect()}
    assert log == {("Insert", "a"), ("Insert", "b"), ("Update", "b"), ("Insert", "c")}
    assert c.delete(rows(spark, ("a", [0, 0], "", None), ("zz", [0, 0], "", None))) == 1
    before = state(c)
    assert set(before) == {"b", "c"} and c.dimensions() == 2
    c.checkpoint()
    c.upsert(rows(spark, ("d", [1, 1], "after", None)))
    assert set(state(cat.get("docs"))) == {"b", "c", "d"}
    stats = c.compact()
    assert stats["live"] == 3 and set(state(c)) == {"b", "c", "d"}
    c.upsert(rows(spark, ("d", [2, 2], "again", None)))
    assert state(c)["d"] == ([2, 2], "again", None)
    info = c.info().first()
    assert (info["count"], info.dimensions) == (3, 2)
    assert [h["ok"] for h in cat.health()] == [True]
    assert c.drop() and cat.names() == []


def test_nothing_is_logged_of_an_invalid_write(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path), AppConfig(limits=Limits(max_vectors=2))).get_or_create("x")
    c.insert(rows(spark, ("a", [1, 2], "t", None)))
    for bad in (rows(spark, ("b", [1, 2, 3], "t", None)), rows(spark, ("b", [math.nan, 1], "t", None))):
        with pytest.raises(Exception, match="invalid vector"):
            c.insert(bad)
    with pytest.raises(InvalidRequestError, match="limits"):
        c.insert(rows(spark, ("b", [1, 2], "t", None), ("c", [1, 2], "t", None)))
    c.upsert(rows(spark, ("a", [9, 9], "same size", None), ("b", [1, 1], "t", None)))  # replacing doesn't add
    assert set(state(c)) == {"a", "b"}


def test_automatic_checkpoint(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path), AppConfig(checkpoint_every=2)).get_or_create("x")
    for k in range(5):
        c.insert(rows(spark, (f"r{k}", [k, k], "t", None)))
    kinds = [x["type"] for x in c.commits()]
    assert kinds.count("Checkpoint") > 1 and len(state(c)) == 5
    timed = Catalogue(spark, str(tmp_path), AppConfig(checkpoint_seconds=1)).get_or_create("y")
    timed.insert(rows(spark, ("a", [1], "t", None)))
    time.sleep(1.2)
    timed.insert(rows(spark, ("b", [1], "t", None)))
    assert [x["type"] for x in timed.commits()][-1] == "Checkpoint" and len(state(timed)) == 2


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path)
    Catalogue(spark, root).get_or_create("x")
    errors = []

    def write(k):
        try:
            c = Collection(spark, root, "x", AppConfig(checkpoint_every=2))
            c.lock = threading.RLock()  # as if in a process of its own
            for j in range(3):
                c.upsert(rows(spark, (f"{k}-{j}", [k, j], "t", None)))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    c = Collection(spark, root, "x")
    numbers = [x["seq"] for x in c.commits()]
    assert not errors and set(state(c)) == {f"{k}-{j}" for k in range(4) for j in range(3)} and numbers == list(range(1, len(numbers) + 1))


def test_a_write_during_a_checkpoint_stays(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path)).get_or_create("x")
    c.insert(rows(spark, ("a", [1], "t", None)))
    inner, late = c._rows, rows(spark, ("b", [2], "t", None))

    def slow(known):
        found = inner(known)
        if not any(x["type"] == "Batch" and x["seq"] > known.seq for x in c.commits()) and known.seq == 2:
            other = Collection(spark, str(tmp_path), "x")
            other.insert(late)
        return found

    c._rows = slow
    c.checkpoint()
    del c._rows
    assert set(state(c)) == {"a", "b"}
    c.vacuum(0)
    assert set(state(c)) == {"a", "b"} and c.compact()["live"] == 2


def test_record_is_kept(spark, tmp_path):
    c = Catalogue(spark, str(tmp_path), AppConfig(retain_seconds=0)).get_or_create("x")
    first = c.record()
    assert first.dimensions is None and first.version == 2 and first.created_at == first.updated_at and state(c) == {}
    c.insert(rows(spark, ("a", [1, 2], "t", None)))
    assert c.delete(rows(spark, ("a", [0], "", None))) == 1 and c.dimensions() == 2  # stays without rows
    with pytest.raises(Exception, match="invalid vector"):
        c.insert(rows(spark, ("b", [1, 2, 3], "t", None)))
    c.insert(rows(spark, ("b", [1, 2], "t", None), ("c", [3, 4], "u", None)))
    assert c.update(spark.createDataFrame([("b", '{"k":1}'), ("zz", "{}")], "id string, metadata string"), "metadata") == 1
    assert c.update(spark.createDataFrame([("c", [9.0, 9.0])], "id string, vector array<float>"), "vector") == 1
    stats = c.compact()
    assert stats["live"] == 2 and stats["removed"] > 0 and c.used_bytes() > 0 and c.log_bytes() == 0
    assert state(c) == {"b": ([1, 2], "t", '{"k":1}'), "c": ([9, 9], "u", None)}
    after = c.record()
    assert (after.dimensions, after.created_at, after.version) == (2, first.created_at, 2) and after.updated_at >= first.updated_at
    assert {x.getPath().getName() for x in c._listed("snapshots")} == {after.snapshot} and c._listed("wal") == []


def test_corrupt_files_are_reported(spark, tmp_path):
    cat = Catalogue(spark, str(tmp_path))
    c = cat.get_or_create("x")
    c.insert(rows(spark, ("a", [1], "t", None)))
    c.checkpoint()
    (tmp_path / "x" / "snapshots" / c.record().snapshot / "_SUCCESS").unlink()
    with pytest.raises(StorageError, match="complete"):
        c.rows()
    (tmp_path / "x" / "commits" / "000000000009.json").write_text("{broken")
    with pytest.raises(StorageError, match="corrupt"):
        c.rows()
    assert [h["ok"] for h in cat.health()] == [False]
    (tmp_path / "y" / "commits").mkdir(parents=True)
    (tmp_path / "y" / "commits" / "000000000001.json").write_text('{"type": "Create", "version": 1, "at": 0}')
    with pytest.raises(StorageError, match="version"):
        cat.get("y").rows()


def test_mutations_of_tables(spark):
    base = rows(spark, ("a", [1], "x", None), ("b", [2], "y", None))
    new = rows(spark, ("b", [3], "z", None), ("c", [4], "w", None))
    assert {(r.id, r.created) for r in mutate.created_flags(base, new).collect()} == {("b", False), ("c", True)}
    once = mutate.upserted(base, new)
    assert sorted(map(tuple, mutate.upserted(once, new).collect())) == sorted(map(tuple, once.collect()))
    ids = rows(spark, ("a", [0], "", None), ("a", [0], "", None), ("q", [0], "", None))
    assert mutate.deleted_count(base, ids).first().n == 1 and mutate.deleted(base, ids).count() == 1
    assert {r.id: r.text for r in mutate.updated(base, new, "text").collect()} == {"a": "x", "b": "z"}
    assert mutate.insert_batch(base, [[1.0], [2.0]], ["p", "q"], ['{"k":1}']).where("metadata = '{}'").count() == 1
    for v, t in (([], []), ([[1.0]], ["a", "b"])):
        with pytest.raises(InvalidRequestError):
            mutate.insert_batch(base, v, t)


def test_log_replay_and_stream_agree(spark, tmp_path):
    log = [("Insert", 1, "a", "x"), ("Insert", 2, "b", "y"), ("Update", 3, "a", "z"), ("Delete", 4, "b", None), ("Checkpoint", 5, None, None), ("Delete", 6, "nobody", None), ("Insert", 7, "b", "back")]
    df = spark.createDataFrame(log, "type string, seq long, id string, text string")
    write_wal(df.where("seq < 4"), f"{tmp_path}/wal")
    spark.createDataFrame([('{"version":1}',)], "value string").write.mode("append").text(f"{tmp_path}/wal")
    want = {"a": "z", "b": "back"}
    progress = lambda: merge_log(spark, f"{tmp_path}/wal", f"{tmp_path}/state", f"{tmp_path}/ck").awaitTermination()
    progress()
    write_wal(df.where("seq >= 4"), f"{tmp_path}/wal")
    progress()
    assert {r.id: r.text for r in replayed(read_wal(spark, f"{tmp_path}/wal")).collect()} == want
    assert {r.id: r.text for r in merged_rows(spark, f"{tmp_path}/state").collect()} == want
    base = spark.createDataFrame([("a", "old"), ("kept", "k")], "id string, text string")
    assert {r.id: r.text for r in replayed(read_wal(spark, f"{tmp_path}/wal", 2), base).collect()} == {"a": "z", "b": "back", "kept": "k"}
    spark.createDataFrame([('{"version":9}',)], "value string").write.mode("append").text(f"{tmp_path}/wal")
    with pytest.raises(Exception, match="version"):
        read_wal(spark, f"{tmp_path}/wal").collect()


def test_stream_rewrites_touched_parts_only(spark, tmp_path):
    log, state = f"{tmp_path}/wal", f"{tmp_path}/state"
    want = {}
    for k in range(6):
        entries = [("Insert" if k == 0 else "Update", 100 * k + i, f"id{i}", f"{k}") for i in (range(40) if k == 0 else [k])]
        write_wal(spark.createDataFrame(entries, "type string, seq long, id string, text string"), log)
        merge_log(spark, log, state, f"{tmp_path}/ck", parts=8).awaitTermination()
        want |= {i: t for _, _, i, t in entries}
        assert {r.id: r.text for r in merged_rows(spark, state).collect()} == want
    last = max((tmp_path / "state" / "manifests").glob("*.json"), key=lambda p: int(p.stem))
    folders = json.loads(last.read_text())["folders"]
    assert len(folders) == 8 and len(set(folders.values())) > 2  # parts of several batches
    assert len(list((tmp_path / "state" / "manifests").glob("*.json"))) == 3


def test_windowed_stream_equals_batch(spark, tmp_path):
    events = spark.range(200).selectExpr("timestamp_seconds(id * 7200) AS ts", "concat('e', id % 3) AS kind")
    events.repartition(2).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_counts(events, "ts", "kind").collect()))


def test_embedders():
    waits, calls = [], []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise EmbeddingError("no")
        return [1.0], 1

    assert E.retried(flaky, 3, sleep=waits.append)("a") == ([1.0], 1) and waits == [1.0, 2.0]

    def failing(text):
        raise EmbeddingError("no")

    with pytest.raises(EmbeddingError):
        E.retried(failing, 2, sleep=waits.append)("a")
    count = []
    lru = E.remembered(lambda t: (count.append(t) or [float(len(t))], 5), 2)
    assert [lru(t)[1] for t in ("hello", "hello", "world", "third", "hello")] == [5, None, 5, 5, 5] and len(count) == 4
    for bad in ("nobody", "local", "openai"):
        with pytest.raises(ConfigError):
            E.embedder(bad)
    assert E.embedder("MOCK")("é")[0] == [2.0]
    v, n = E.hashing(8)("a b a")
    assert n == 3 and sum(x * x for x in v) == pytest.approx(1) and E.hashing(8)("")[0] == [0.0] * 8


def test_embedded_table_asks_once_for_each_text(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, None), (4, "b")], "id int, text string")
    got = {r.id: r.vector for r in E.embedded(df, E.mock()).collect()}
    assert got == {1: [2.0], 2: [2.0], 3: None, 4: [1.0]}


def test_telemetry(spark):
    xs = [10_000, 20_000, 30_000, 10, 20, 30, 40, 1]
    average = 0
    for n, x in enumerate(xs):
        average = T.average_step(average, n, x)
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)] + [("j", 0, 5)], "op string, i int, us long").repartition(3)
    assert {r.op: (r.n, r.average) for r in T.latency_average(df, "op", ["i"], "us").collect()} == {"k": (8, average), "j": (1, 5)}
    assert 10_000 < T.average_step(10_000, 1, 20_000) < 20_100
    pick = random.Random(4)
    every = {"a": [pick.randrange(10**6) for _ in range(3000)], "b": [7] * 2500, "c": [5, 6], "d": [pick.randrange(5) for _ in range(2100)]}
    want = {}
    for k, values in every.items():
        average = 0
        for n, x in enumerate(values):
            average = T.average_step(average, n, x)
        want[k] = (len(values), average)
    many = spark.createDataFrame([(k, i, x) for k, values in every.items() for i, x in enumerate(values)] + [("c", 9, None), (None, 1, 4)], "op string, i int, us long").repartition(5)
    for hot, tail in ((2000, 300), (2000, 3), (10**6, 5)):
        assert {r.op: (r.n, r.average) for r in T.latency_average(many, "op", ["i"], "us", hot, tail).collect()} == {**want, None: (1, 4)}
    sizes = spark.createDataFrame([("a", 10), ("b", 30), ("c", 20)], "name string, size long")
    evict = lambda budget: {r.name for r in T.evicted(sizes, "name", "size", budget).collect() if r.evict}
    assert evict(60) == set() and evict(35) == {"b"} and evict(29) == {"b", "c"} and evict(1) == {"a", "b", "c"}
    none = spark.createDataFrame([], "texts int, tokens int, nanoseconds long")
    assert T.embedding_totals(none).first().mean_ms is None
