import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from arrowfen.config import AppConfig, IndexConfig, SearchConfig, load_config, metric_name, search_config
from arrowfen.errors import ConfigError, InvalidRequestError, NotFoundError, RateLimitedError
from arrowfen.functions import distance as D
from arrowfen.functions import vector as V
from arrowfen.functions.metadata import Filter, flat_json, scalars_of


def pair(spark, a, b, f):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    return df.select(f(F.col("a"), F.col("b"))).first()[0]


@pytest.mark.parametrize(
    "f,a,b,want",
    [
        (D.euclidean, [1, 2, 3], [1, 2, 3], 0), (D.euclidean, [0, 0], [3, 4], 5), (D.squared_euclidean, [0, 0], [3, 4], 25),
        (D.dot, [1, 2, 3], [4, 5, 6], 32), (D.dot, [1, 0], [0, 1], 0), (D.cosine, [1, 2, 3], [1, 2, 3], 1), (D.cosine, [1, 0], [0, 1], 0),
        (D.cosine, [0, 0], [1, 1], 0), (D.euclidean_score, [1, 0], [1, 0], 1), (D.binary_cosine, [1, -1, 0, 2], [1, 1, -1, 2], 0),
        (D.binary_dot, [1, -1, 0, 2], [1, 1, -1, 2], 2), (D.binary_squared_euclidean, [1, -1], [-1, 1], 2), (D.binary_euclidean, [1, -1, 1, 1], [-1, 1, -1, -1], 2),
    ],
)
def test_distances(spark, f, a, b, want):
    assert pair(spark, [float(x) for x in a], [float(x) for x in b], f) == pytest.approx(want)


@pytest.mark.parametrize("f", [D.euclidean, D.dot, D.cosine, D.binary_dot])
def test_lengths_must_match(spark, f):
    with pytest.raises(PySparkException, match="same length"):
        pair(spark, [1.0, 2.0], [1.0], f)


def one(spark, kind, value, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_validation(spark):
    ok = lambda v: one(spark, "array<float>", v, V.is_valid_vector)
    assert ok([1.0, 2.0, 3.0]) and ok([0.0, -1.5, 100.0])
    assert not ok([]) and not ok([math.nan]) and not ok([1.0, math.inf]) and not ok(None)
    assert one(spark, "array<float>", [0.0, 1.0, math.nan], V.first_bad_index) == 2
    assert one(spark, "array<float>", [3.0, 4.0], V.normalized) == pytest.approx([0.6, 0.8])
    assert one(spark, "array<float>", [0.0, 0.0], V.normalized) == [0, 0]
    name = lambda s: one(spark, "string", s, V.is_valid_name)
    assert name("my_collection-1") and name("größe") and not name("") and not name("bad name") and not name("a" * 256) and not name("a\n") and not name(None)
    text = lambda s: one(spark, "string", s, V.is_valid_text)
    assert text("a") and not text("") and not text(None) and text("x" * 1_000_000) and not text("é" * 500_001)
    V.check_batch_size(10, 100)
    for n in (0, 101):
        with pytest.raises(InvalidRequestError):
            V.check_batch_size(n, 100)


@pytest.mark.parametrize("v,error", [([0.0, 0.5, 1.0, 1.5, 2.0], 0.01), ([1.0] * 4, 0.001), ([-1.0, -0.5, 0.0, 0.5, 1.0], 0.01)])
def test_int8_round_trip(spark, v, error):
    back = one(spark, "array<float>", v, lambda x: V.dequantized_int8(V.quantized_int8(x)))
    assert max(abs(a - b) for a, b in zip(v, back)) < error


def test_block_round_trip_and_corruption(spark):
    v = [k / 10 for k in range(32)]
    for m in (1, 4, 5, 32, 100):
        q = one(spark, "array<float>", v, lambda x: V.quantized_blocks(x, m))  # noqa: B023
        assert len(q.codes) == q.dim == 32
        back = one(spark, "array<float>", v, lambda x: V.dequantized_blocks(V.quantized_blocks(x, m)))  # noqa: B023
        assert max(abs(a - b) for a, b in zip(v, back)) < 0.01
    bad = spark.sql("SELECT named_struct('codes', array(1), 'mins', array(0.0), 'maxs', array(1.0), 'dim', 4, 'blocks', 1) AS q")
    with pytest.raises(PySparkException, match="corrupted"):
        bad.select(V.dequantized_blocks(F.col("q"))).collect()
    with pytest.raises(InvalidRequestError):
        V.quantized(F.lit(1), "float16")


def kept(df, f, metadata=None):
    return [r.id for r in df.where(f.column(df, metadata)).orderBy("id").collect()]


def test_typed_filters_on_columns_struct_and_variant(spark):
    cols = spark.createDataFrame([(1, "tech", "active", 75, 7.5), (2, "sports", None, None, math.nan), (3, "tech", "pending", 10, 10.0)], "id int, category string, status string, score long, rate double")
    struct = cols.select("id", F.struct("category", "status", "score", "rate").alias("m"))
    variant = spark.sql("""SELECT id, parse_json(j) AS m FROM VALUES (1, '{"category":"tech","status":"active","score":75,"rate":7.5}'), (2, '{"category":"sports"}'), (3, '{"category":"tech","status":"pending","score":10,"rate":10.0}') t(id, j)""")
    for df, at in ((cols, None), (struct, "m"), (variant, "m")):
        f = Filter()
        assert kept(df, f, at) == [1, 2, 3] and f.is_empty()
        assert kept(df, f.eq("category", "tech"), at) == [1, 3] and kept(df, f.eq("category", "x"), at) == []
        assert kept(df, f.is_in("status", ["active", "pending"]), at) == [1, 3] and kept(df, f.is_in("status", []), at) == []
        assert kept(df, f.gt("score", 50), at) == [1] and kept(df, f.lte("score", 75), at) == [1, 3] and kept(df, f.gt("score", 80), at) == []
        assert kept(df, f.ne("status", "active"), at) == [2, 3] and kept(df, f.ne("nothing", 1), at) == [1, 2, 3] and kept(df, f.eq("nothing", 1), at) == []
        assert kept(df, f.eq("score", 75.0), at) == [] and kept(df, f.eq("score", 75), at) == [1] and kept(df, f.eq("rate", 7.5), at) == [1]
        assert kept(df, f.gte("rate", 0), at) == [1, 3] and kept(df, f.gt("category", 1), at) == []
        assert kept(df, f.eq("category", "tech").lt("score", 50), at) == [3]
    with pytest.raises(InvalidRequestError):
        Filter().eq("a", object()).column(cols.withColumnRenamed("id", "a"))


def test_metadata_accessors_are_strict(spark):
    df = spark.sql("""SELECT parse_json('{"name":"test","count":42,"score":3.14,"active":true,"none":null}') AS m""")
    get = lambda k, t: df.select(scalars_of(F.col("m"), k, t)).first()[0]
    assert (get("name", str), get("count", int), get("score", float), get("active", bool)) == ("test", 42, 3.14, True)
    assert get("name", int) is get("count", str) is get("count", float) is get("none", str) is get("absent", str) is None
    flat = spark.sql("""SELECT '{"a":1,"b":[1],"c":{"d":2},"e":null,"f":"x"}' AS j""").select(flat_json(F.col("j")).alias("m")).first().m
    assert flat == {"a": "1", "e": None, "f": "x"}


def test_requests_and_config(tmp_path):
    assert metric_name(None) == "cosine" and metric_name("dot_product") == "dot"
    for bad in ("cosinee", "Cosine"):
        with pytest.raises(InvalidRequestError):
            metric_name(bad)
    assert search_config(preset="fast") == SearchConfig(50, 1, 10) and search_config(preset="high", ef=9).ef == 9
    for bad in ({"preset": "balanced"}, {"overfetch": 0}):
        with pytest.raises(InvalidRequestError):
            search_config(**bad)
    assert [IndexConfig().choose(n) for n in (1_000, 50_000, 500_000)] == ["flat", "ivf", "hnsw"]
    assert [IndexConfig(flat_below=5, ivf_below=10).choose(n) for n in (4, 7, 12)] == ["flat", "ivf", "hnsw"]
    for bad in ({"recall_target": 1.5}, {"execution": "gpu"}):
        with pytest.raises(ConfigError):
            AppConfig(**bad)
    path = tmp_path / "c.json"
    path.write_text('{"cache_rows": 5, "index": {"kind": "flat"}}')
    assert load_config(str(path), {"CACHE_MAX_SIZE": "7"}).cache_rows == 7
    assert load_config(env={"INDEX_TYPE": "ivf"}).index.clusters == 256
    with pytest.raises(ConfigError):
        load_config(env={"SLOW_QUERY_MS": "x"})
    path.write_text('{"unknown": 1}')
    with pytest.raises(ConfigError):
        load_config(str(path), {})
    assert NotFoundError.status == 404 and RateLimitedError.recoverable
