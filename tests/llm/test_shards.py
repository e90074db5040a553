import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from arrowfen.llm.shards import _spread, interleave

from .conftest import messy_rows


def test_law_of_rows_slots_and_mixture(messy):
    rows = interleave(messy, n_shards=7).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in messy_rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    sizes = [len(s) for s in slots.values()]
    assert set(slots) == set(range(7)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute(df, n_shards, seed=17):
    """Every row's place: ranked by hash in its source, sorted by fractional rank, cut into equal shards."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("v"), "source")).alias("src"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "crc", "size", "src"), 33)).withColumn("s", F.xxhash64(F.lit(seed), "src")).collect()
    key = lambda r: ((r.doc_id is not None, r.doc_id or 0), r.crc, r.size)  # noqa: E731  null first
    sources, placed = defaultdict(list), []
    for r in rows:
        sources[r.src].append(r)
    for src, some in sources.items():
        some.sort(key=lambda r: (r.h, *key(r)))
        placed += [((k + 0.5) / len(some), r.s, src, key(r), r) for k, r in enumerate(some)]
    placed.sort(key=lambda x: x[:4])
    total, out = len(placed), Counter()
    for p, x in enumerate(placed):
        shard = p * n_shards // total
        out[x[4].doc_id, x[4].size, x[4].crc, shard, p - -(-shard * total // n_shards)] += 1
    return out


def places(df, **more):
    return Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in interleave(df, **more).collect())


def test_placement_matches_brute_force(messy):
    assert places(messy, n_shards=7) == brute(messy, 7)


def test_masses_of_equal_rows_are_ranked_in_many_ranges(spark):
    rows = [(7, "same", "a")] * 1500 + [(8, "same", "a")] * 900 + [(i, f"t{i}", "a") for i in range(100, 900)] + [(i, "x", "b") for i in range(1000, 1300)] + [(None, None, None)] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert places(df, n_shards=11, range_rows=50) == places(df, n_shards=11) == brute(df, 11)
    keyed = df.select(F.coalesce("source", F.lit("n")).alias("src"), F.lit(0).alias("b"), F.xxhash64("doc_id").alias("h"))
    assert max(r["count"] for r in _spread(keyed, 50).groupBy("src", "sub").count().collect()) < 1000


def test_every_shard_has_the_mixture(spark):
    share = {"big": 2000, "mid": 400, "small": 40}
    docs = spark.createDataFrame([(k * 10000 + i, f"t{i}", k_name) for k, (k_name, n) in enumerate(share.items()) for i in range(n)], "doc_id long, text string, source string")
    kind = {r.doc_id: r.source for r in docs.collect()}
    found = defaultdict(Counter)
    for r in interleave(docs, n_shards=20).collect():
        found[r.shard][kind[r.doc_id]] += 1
    for c in found.values():
        for name, n in share.items():
            assert abs(c[name] - n / 20) <= 1


def test_same_result_for_any_partitioning_and_another_for_another_seed(messy):
    some = lambda df, **k: Counter(tuple(r) for r in interleave(df, n_shards=5, **k).collect())
    assert some(messy) == some(messy.repartition(11)) != some(messy, seed=18)


def test_empty_table_and_more_shards_than_rows(spark, no_docs):
    assert interleave(no_docs).collect() == []
    few = spark.createDataFrame([(1, "a", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.slot) for r in interleave(few).collect()) == [(1, 0), (2, 0)]
