"""Queries over the library's operators and their DuckDB counterparts.

The collection is ``embeddings`` with the text and metadata of the document of
the same id; the change log is ``events`` by user. Scores are rounded to six
digits, ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MAX_BATCH, IndexConfig, Limits, SearchConfig, search_config
from ..errors import InvalidRequestError
from ..functions import distance as D
from ..functions import embed as E
from ..functions import telemetry as T
from ..functions import vector as V
from ..functions.metadata import Filter, flat_json, scalars_of
from ..functions.sql import register
from ..operators import dedup, graph, ivf, knn, mutate
from ..operators.index import VectorIndex
from ..sources.shared import shared_path
from ..sources.wal import read_wal, replayed, write_wal
from ..streaming.wal_stream import merge_log, merged_rows, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

C_SQL = "c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, text, lang, source, n_chars FROM embeddings LEFT JOIN documents ON vec_id = doc_id)"
Q_SQL = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)"
COS_SQL, DOT_SQL, L2_SQL = "list_cosine_similarity(v, qv)", "list_dot_product(v, qv)", "1 / (1 + list_distance(v, qv))"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def r6(x: Column) -> Column:
    return F.round(x, 6) + F.lit(0.0)  # no negative zero


def q6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def collection(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return vectors(spark, sf).join(docs, F.col("id") == F.col("doc_id"), "left").drop("doc_id")


def first_vector(spark: SparkSession, sf: str) -> list[float]:
    return vectors(spark, sf).where("id = 0").select("vector").first()[0]


def in_batches(asked: DataFrame, search: Callable[[DataFrame], DataFrame], q_id: str = "q_id", apart: int = 1) -> DataFrame:
    """``search`` of all of ``asked``, MAX_BATCH at a time at most; ids are whole numbers at least ``apart`` apart."""
    try:
        return search(asked)
    except InvalidRequestError:  # too many for one batch
        if asked.limit(MAX_BATCH + 1).count() <= MAX_BATCH:
            raise
    part = F.floor(F.col(q_id) / (apart * MAX_BATCH))
    parts = [r[0] for r in asked.select(part.alias("p")).distinct().orderBy("p").collect()]
    return reduce(DataFrame.unionByName, [search(asked.where(part == n)) for n in parts])


def sampled(spark: SparkSession, sf: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``search`` of every row with id % 100 = 0, however many."""
    asked = vectors(spark, sf).where(F.col("id") % 100 == 0).select(F.col("id").alias("q_id"), "vector")
    return in_batches(asked, search, apart=100)


def recall_of(near: DataFrame, exact: DataFrame) -> DataFrame:
    """(q_id, recall) of ``near`` against the exact result."""
    hits = exact.select("q_id", "id").join(near.select("q_id", "id", F.lit(1).alias("hit")), ["q_id", "id"], "left")
    return hits.groupBy("q_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The change log: (seq, id, type, value)."""
    kind = F.when(F.col("event_type") == "signup", "Insert").when(F.col("event_type") == "error", "Delete").otherwise("Update")
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), kind.alias("type"), "value")


EVENTS_SQL = "w AS (SELECT event_id AS seq, user_id AS id, CASE event_type WHEN 'signup' THEN 'Insert' WHEN 'error' THEN 'Delete' ELSE 'Update' END AS type, value FROM events)"


# scans


@query("SELECT count(*) AS n FROM embeddings")
def scan_count(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).agg(F.count("*").alias("n"))


@query("SELECT vec_id AS id, label FROM embeddings ORDER BY vec_id LIMIT 100 OFFSET 20")
def scan_page(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("id", "label").orderBy("id").offset(20).limit(100)


@query(f"WITH {C_SQL} SELECT id, label, text, lang, source, n_chars FROM c WHERE id = 7")
def get_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return collection(spark, sf).where("id = 7").drop("vector")


@query(f"WITH {C_SQL} SELECT id, label, lang FROM c WHERE id IN (3, 5, 8, 123456789)")
def get_batch(spark: SparkSession, sf: str) -> DataFrame:
    return collection(spark, sf).where(F.col("id").isin(3, 5, 8, 123456789)).select("id", "label", "lang")


@query(f"WITH {C_SQL} SELECT 'collection' AS name, count(*) AS n, max(len(v))::BIGINT AS dimensions FROM c")
def collection_info(spark: SparkSession, sf: str) -> DataFrame:
    return collection(spark, sf).agg(F.lit("collection").alias("name"), F.count("*").alias("n"), F.max(F.size("vector")).cast("long").alias("dimensions"))


@query(f"WITH {C_SQL} SELECT id, len(v)::BIGINT AS dim, {q6('list_sum(v)')} AS total FROM c")
def vectors_view(spark: SparkSession, sf: str) -> DataFrame:
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return vectors(spark, sf).select("id", F.size("vector").cast("long").alias("dim"), r6(total).alias("total"))


@query(f"WITH {C_SQL} SELECT id, label, lang, source, n_chars FROM c")
def metadata_view(spark: SparkSession, sf: str) -> DataFrame:
    return collection(spark, sf).select("id", "label", "lang", "source", "n_chars")


# distances


def _distance(name: str, f: Callable[[Column, Column], Column], sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        q = knn.query_column(first_vector(spark, sf))
        return vectors(spark, sf).select("id", r6(f(F.col("vector"), q)).alias("value"))

    query(f"WITH {C_SQL}, {Q_SQL} SELECT id, {q6(sql)} AS value FROM c, q", name)(run)


SIGNS = "list_sum(list_transform(list_zip(v, qv), lambda t: CASE WHEN (t[1] >= 0) <> (t[2] >= 0) THEN 1.0::DOUBLE ELSE 0.0 END))"
BOTH = "list_sum(list_transform(list_zip(v, qv), lambda t: CASE WHEN t[1] >= 0 AND t[2] >= 0 THEN 1.0::DOUBLE ELSE 0.0 END))"
for _name, _f, _sql in (
    ("dist_cosine", D.cosine, COS_SQL), ("dist_dot", D.dot, DOT_SQL), ("dist_l2", D.euclidean, "list_distance(v, qv)"),
    ("dist_l2sq", D.squared_euclidean, "power(list_distance(v, qv), 2)"), ("score_l2", D.euclidean_score, L2_SQL),
    ("bin_cosine", D.binary_cosine, f"1 - 2 * {SIGNS} / len(v)"), ("bin_dot", D.binary_dot, BOTH),
    ("bin_l2", D.binary_euclidean, f"sqrt({SIGNS})"), ("bin_l2sq", D.binary_squared_euclidean, SIGNS),
):
    _distance(_name, _f, _sql)


@query("SELECT vec_id AS id, CASE WHEN label < 5 THEN 0.0 ELSE round(list_cosine_similarity(embedding::DOUBLE[], embedding::DOUBLE[]), 6) END AS value FROM embeddings")
def cos_zero_vector(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.when(F.col("label") < 5, F.transform("vector", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("vector"))
    return vectors(spark, sf).select("id", r6(D.cosine(F.col("vector"), zero)).alias("value"))


# search


def _top(score: str, k: int = 10, where: str = "", more: str = "") -> str:
    return f"WITH {C_SQL}, {Q_SQL}, s AS (SELECT id, {score} AS score FROM c, q {where} ORDER BY {score} DESC, id LIMIT {k}) SELECT id, {q6('score')} AS score FROM s {more}"


def _hits(df: DataFrame) -> DataFrame:
    return df.select("id", r6(F.col("score")).alias("score"))


for _name, _metric, _sql in (("knn_cosine", "cosine", COS_SQL), ("knn_dot", "dot", DOT_SQL), ("knn_l2", "euclidean", L2_SQL)):
    query(_top(_sql), _name)(lambda spark, sf, m=_metric: _hits(knn.knn(vectors(spark, sf), first_vector(spark, sf), 10, m)))


def _batch_sql(k: int, score: str = "list_cosine_similarity(c.v, q.v)", where: str = "true") -> str:
    return f"""WITH {C_SQL}, s AS (SELECT q.id AS q_id, c.id AS id, {score} AS score FROM c q, c WHERE q.id % 100 = 0 AND {where}),
        r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM s)
        SELECT q_id, rank, id, {q6('score')} AS score FROM r WHERE rank <= {k}"""


def rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("score", r6(F.col("score")))


@query(_batch_sql(10))
def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sampled(spark, sf, lambda asked: knn.knn_batch(vectors(spark, sf), asked, 10)))


@query(_batch_sql(5, "1 / (1 + list_distance(c.v, q.v))"))
def knn_batch_l2(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sampled(spark, sf, lambda asked: knn.knn_batch(vectors(spark, sf), asked, 5, "euclidean")))


@query(f"WITH {C_SQL}, {Q_SQL}, s AS (SELECT id, {L2_SQL} AS score FROM c, q ORDER BY {COS_SQL} DESC, id LIMIT 10) SELECT id, {q6('score')} AS score FROM s")
def knn_metric_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(knn.knn(vectors(spark, sf), first_vector(spark, sf), 10, "euclidean", rank_metric="cosine"))


@query(_top(COS_SQL, 10, "", "WHERE score >= 0.3"))
def range_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(knn.range_topk(vectors(spark, sf), first_vector(spark, sf), 0.3))


@query(f"WITH {C_SQL}, {Q_SQL} SELECT id, {q6('list_distance(v, qv)')} AS distance FROM c, q WHERE list_distance(v, qv) <= 1.2")
def radius(spark: SparkSession, sf: str) -> DataFrame:
    return knn.radius(vectors(spark, sf), first_vector(spark, sf), 1.2).select("id", r6(F.col("distance")).alias("distance"))


@query(f"WITH {C_SQL}, {Q_SQL}, s AS (SELECT id, label, {COS_SQL} AS score FROM c, q ORDER BY {COS_SQL} DESC, id LIMIT 100) SELECT id, {q6('score')} AS score FROM (SELECT * FROM s WHERE label = 3 ORDER BY score DESC, id LIMIT 10)")
def knn_postfilter(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(knn.knn(vectors(spark, sf), first_vector(spark, sf), 10, where=Filter().eq("label", 3), filter_mode="post", config=SearchConfig(filter_overfetch=10)))


@query(_top(COS_SQL, 10, "WHERE label = 3"))
def knn_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(knn.knn(vectors(spark, sf), first_vector(spark, sf), 10, where=Filter().eq("label", 3)))


# metadata predicates


def _filter(name: str, f: Filter, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = collection(spark, sf)
        return rows.where(f.column(rows)).select("id", "label", "lang", "n_chars")

    query(f"WITH {C_SQL} SELECT id, label, lang, n_chars FROM c WHERE {sql}", name)(run)


for _name, _f, _sql in (
    ("filter_eq", Filter().eq("lang", "en"), "coalesce(lang = 'en', false)"),
    ("filter_ne", Filter().ne("lang", "en"), "NOT coalesce(lang = 'en', false)"),
    ("filter_ne_missing", Filter().ne("no_such_key", 1), "true"),
    ("filter_gt", Filter().gt("n_chars", 1000), "coalesce(n_chars > 1000, false)"),
    ("filter_gte", Filter().gte("label", 5), "label >= 5"),
    ("filter_lt", Filter().lt("n_chars", 1000.5), "coalesce(n_chars < 1000.5, false)"),
    ("filter_lte", Filter().lte("label", 5), "label <= 5"),
    ("filter_in", Filter().is_in("lang", ["de", "fr"]), "coalesce(lang IN ('de', 'fr'), false)"),
    ("filter_in_empty", Filter().is_in("lang", []), "false"),
    ("filter_and", Filter().eq("lang", "en").gt("n_chars", 500).ne("label", 2), "coalesce(lang = 'en', false) AND coalesce(n_chars > 500, false) AND label <> 2"),
    ("filter_empty", Filter(), "true"),
    ("filter_nonnumeric", Filter().gt("lang", 5), "false"),
    ("filter_typed", Filter().eq("label", 3.0), "false"),
):
    _filter(_name, _f, _sql)


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::DOUBLE > 50 AND NOT coalesce((props->>'$.k')::BIGINT = 77, false)")
def filter_variant(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.parse_json("props").alias("meta"))
    kept = rows.where(Filter().gt("k", 50).ne("k", 77).column(rows, "meta"))
    return kept.select("event_id", scalars_of(F.col("meta"), "k", int).alias("k"))


@query("SELECT event_id, props->>'$.k' AS k, NULL::BOOLEAN AS flag FROM events")
def metadata_accessors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.parse_json("props").alias("meta"))
    return rows.select("event_id", scalars_of(F.col("meta"), "k", int).cast("string").alias("k"), scalars_of(F.col("meta"), "k", bool).alias("flag"))


@query("SELECT event_id, props->>'$.k' AS k, 1::BIGINT AS n FROM events")
def json_metadata(spark: SparkSession, sf: str) -> DataFrame:
    with_list = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "list": [1], "deep": {"a": 1}}'))
    rows = table(spark, sf, "events").select("event_id", flat_json(with_list).alias("m"))
    return rows.select("event_id", F.col("m")["k"].alias("k"), F.size("m").cast("long").alias("n"))


@query(f"WITH {C_SQL} SELECT id, '{{' || array_to_string(list_filter(['\"label\":' || label, '\"lang\":\"' || lang || '\"', '\"n_chars\":' || n_chars], lambda x: x IS NOT NULL), ',') || '}}' AS json FROM c")
def metadata_to_json(spark: SparkSession, sf: str) -> DataFrame:
    return collection(spark, sf).select("id", F.to_json(F.struct("label", "lang", "n_chars")).alias("json"))


# near-duplicates

PAIRS_SQL = "p AS (SELECT a.id AS id_a, b.id AS id_b, list_cosine_similarity(a.v, b.v) AS score FROM c a JOIN c b ON a.id < b.id)"


@query(f"WITH {C_SQL}, {PAIRS_SQL} SELECT id_a, id_b, {q6('score')} AS score FROM p WHERE score >= 0.35")
def dup_exact(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.pairs_above(vectors(spark, sf), 0.35).withColumn("score", r6(F.col("score")))


BOUNDED_SQL = f"""WITH {C_SQL}, s AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS score FROM c a, c b),
    r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, y) AS rank FROM s),
    p AS (SELECT least(x, y) AS id_a, greatest(x, y) AS id_b, max(score) AS score FROM r WHERE rank <= %d AND x <> y AND score >= 0.35 GROUP BY ALL)
    SELECT id_a, id_b, {q6('p.score')} AS score FROM p %s"""


@query(BOUNDED_SQL % (3, ""))
def dup_knn_bounded(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.pairs_of_neighbours(vectors(spark, sf), 0.35, k=3).withColumn("score", r6(F.col("score")))


@query(BOUNDED_SQL % (40, "ORDER BY p.score DESC, id_a, id_b LIMIT 20"))
def dup_limit(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.pairs_of_neighbours(vectors(spark, sf), 0.35, limit=20).withColumn("score", r6(F.col("score")))


# vector functions


@query("SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) + 0.0) AS v FROM embeddings")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("id", F.transform(V.normalized(F.col("vector")), r6).alias("v"))


@query("SELECT vec_id AS id, label <> 1 AND label <> 2 AS valid, CASE label WHEN 1 THEN 2 END::INTEGER AS bad FROM embeddings")
def validate_vectors(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.when(F.col("label") == 1, F.transform("vector", lambda x, i: F.when(i == 2, float("nan")).otherwise(x))).when(F.col("label") == 2, F.array().cast("array<double>")).otherwise(F.col("vector").cast("array<double>"))
    rows = vectors(spark, sf).select("id", broken.alias("v"))
    return rows.select("id", V.is_valid_vector(F.col("v")).alias("valid"), V.first_bad_index(F.col("v")).alias("bad"))


@query("SELECT doc_id, coalesce(octet_length(encode(text)) BETWEEN 1 AND 1000000, false) AS valid FROM documents")
def validate_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", V.is_valid_text(F.col("text")).alias("valid"))


@query("SELECT doc_id, regexp_full_match(source || CASE WHEN doc_id % 3 = 0 THEN ' x' ELSE '-1' END, '[A-Za-z0-9_-]{1,255}') AS valid FROM documents")
def validate_name(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat("source", F.when(F.col("doc_id") % 3 == 0, " x").otherwise("-1"))
    return table(spark, sf, "documents").select("doc_id", V.is_valid_name(name).alias("valid"))


@query("SELECT vec_id AS id, len(embedding) = 64 AS ok FROM embeddings")
def validate_dims(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).select("id", V.has_dimensions(F.col("vector"), 64).alias("ok"))


INT8 = "(SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_min(embedding::DOUBLE[]) AS mn, list_max(embedding::DOUBLE[]) AS mx FROM embeddings)"
CODES = "list_transform(v, lambda x: round((x - mn) / (mx - mn) * 254 - 127)::INTEGER)"


@query(f"SELECT id, md5(array_to_string({CODES}, ',')) AS codes, {q6('mn')} AS mn, {q6('mx')} AS mx FROM {INT8}")
def quant_int8(spark: SparkSession, sf: str) -> DataFrame:
    q = vectors(spark, sf).select("id", V.quantized(F.col("vector"), "int8").alias("q"))
    return q.select("id", F.md5(F.array_join(F.col("q.codes").cast("array<string>"), ",")).alias("codes"), r6(F.col("q.min").cast("double")).alias("mn"), r6(F.col("q.max").cast("double")).alias("mx"))


@query(f"SELECT id, round(list_max(list_transform(list_zip(v, {CODES}), lambda t: abs(t[1] - ((t[2] + 127) / 254.0 * (mx - mn) + mn)))), 5) <= (mx - mn) / 254 AS close FROM {INT8}")
def dequant_int8_error(spark: SparkSession, sf: str) -> DataFrame:
    q = vectors(spark, sf).select("id", "vector", V.quantized_int8(F.col("vector")).alias("q"))
    worst = F.array_max(F.zip_with("vector", V.dequantized_int8(F.col("q")), lambda x, y: F.abs(x - y)))
    return q.select("id", (F.round(worst, 5) <= (F.col("q.max").cast("double") - F.col("q.min")) / 254).alias("close"))


BLOCK_CODES = "flatten(list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: list_transform(list_slice(v, i * 8 + 1, i * 8 + 8), lambda x: round((x - list_min(list_slice(v, i * 8 + 1, i * 8 + 8))) / greatest(list_max(list_slice(v, i * 8 + 1, i * 8 + 8)) - list_min(list_slice(v, i * 8 + 1, i * 8 + 8)), 1.1920928955078125e-07) * 255)::INTEGER)))"


@query(f"SELECT id, md5(array_to_string({BLOCK_CODES}, ',')) AS codes, 64 AS dim, 8 AS blocks FROM {INT8}")
def quant_block(spark: SparkSession, sf: str) -> DataFrame:
    q = vectors(spark, sf).select("id", V.quantized(F.col("vector"), "block", 8).alias("q"))
    return q.select("id", F.md5(F.array_join(F.col("q.codes").cast("array<string>"), ",")).alias("codes"), "q.dim", "q.blocks")


BACK = "flatten(list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: list_transform(list_slice(v, i * 8 + 1, i * 8 + 8), lambda x: round((x - list_min(list_slice(v, i * 8 + 1, i * 8 + 8))) / greatest(list_max(list_slice(v, i * 8 + 1, i * 8 + 8)) - list_min(list_slice(v, i * 8 + 1, i * 8 + 8)), 1.1920928955078125e-07) * 255) / 255.0 * greatest(list_max(list_slice(v, i * 8 + 1, i * 8 + 8)) - list_min(list_slice(v, i * 8 + 1, i * 8 + 8)), 1.1920928955078125e-07) + list_min(list_slice(v, i * 8 + 1, i * 8 + 8)))))"


@query(f"SELECT id, round(list_max(list_transform(list_zip(v, {BACK}), lambda t: abs(t[1] - t[2]))), 5) + 0.0 AS worst, round(list_sum({BACK}), 4) + 0.0 AS total FROM {INT8}")
def dequant_block_error(spark: SparkSession, sf: str) -> DataFrame:
    """The largest error of a component, and the sum of the components that come back."""
    q = vectors(spark, sf).select("id", "vector", V.quantized_blocks(F.col("vector"), 8).alias("q"))
    q = q.withColumn("back", V.dequantized_blocks(F.col("q")))
    worst = F.array_max(F.zip_with("vector", "back", lambda x, y: F.abs(x - y)))
    return q.select("id", (F.round(worst, 5) + F.lit(0.0)).alias("worst"), (F.round(F.aggregate("back", F.lit(0.0), lambda a, x: a + x), 4) + F.lit(0.0)).alias("total"))


@query("SELECT m AS model, d::INTEGER AS dimensions FROM (VALUES ('text-embedding-3-large', 3072), ('all-minilm', 384), ('other', NULL)) t(m, d)")
def model_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("text-embedding-3-large",), ("all-minilm",), ("other",)], "model string")
    return names.select("model", V.model_dimensions(F.col("model")).alias("dimensions"))


# clustered index

SEEDS = "s AS (SELECT id AS cid, v AS cv FROM c WHERE id < 16)"
ASSIGN = "a AS (SELECT c.id, arg_max(cid, (round(list_cosine_similarity(v, cv), 12), cid)) AS cid FROM c, %s GROUP BY c.id)"
MEANS = """u AS (SELECT a.cid, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a JOIN c ON a.id = c.id),
    g AS (SELECT cid, i, avg(x) AS x FROM u GROUP BY cid, i), m AS (SELECT cid, list(x ORDER BY i) AS cv FROM g GROUP BY cid)"""


@query(f"WITH {C_SQL}, {SEEDS}, {ASSIGN % 's'} SELECT id, cid FROM a")
def ivf_assign0(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return ivf.assigned(rows, ivf.seeds(rows, 16)).select("id", "cid")


@query(f"WITH {C_SQL}, {SEEDS}, {ASSIGN % 's'}, {MEANS} SELECT cid, list_transform(cv, lambda x: round(x, 6) + 0.0) AS centroid FROM m")
def ivf_lloyd1(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    found = ivf.lloyd_step(rows, ivf.seeds(rows, 16))
    df = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "cid bigint, centroid array<double>")
    return df.select("cid", F.transform("centroid", r6).alias("centroid"))


@query(f"WITH {C_SQL}, {SEEDS}, {ASSIGN % 's'}, {MEANS}, {(ASSIGN % 'm').replace('a AS', 'b AS')} SELECT cid, count(*) AS n FROM b GROUP BY cid")
def ivf_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return ivf.IvfIndex.build(vectors(spark, sf), 16, iterations=1).sizes()


def _probe_sql(nprobe: int) -> str:
    return f"""WITH {C_SQL}, {SEEDS}, {ASSIGN % 's'},
    pr AS (SELECT q.id AS q_id, cid, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, cv), 12) DESC, cid) AS k FROM c q, s WHERE q.id % 100 = 0),
    h AS (SELECT q_id, c.id, list_cosine_similarity(c.v, q.v) AS score FROM pr JOIN a USING (cid) JOIN c ON c.id = a.id JOIN c q ON q.id = q_id WHERE k <= {nprobe}),
    r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM h)
    SELECT q_id, rank, id, {q6('score')} AS score FROM r WHERE rank <= 10"""


_HELD: dict[tuple, str] = {}


def held(spark: SparkSession, sf: str, name: str, make: Callable[[str], None]) -> str:
    """Where ``make`` has written what ``name`` says about the rows at ``sf``; once for each application and state of the table, as an index is built once."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/embeddings.parquet")
    status = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(files)
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), sf, status.getModificationTime(), name)
    if key not in _HELD:
        path = shared_path(spark, name)
        make(path)
        _HELD[key] = path
    return _HELD[key]


_OPENED: dict[str, ivf.IvfIndex | graph.GraphIndex] = {}


def opened(path: str, load: Callable) -> ivf.IvfIndex | graph.GraphIndex:
    """The stored index at a path, which is loaded once."""
    if path not in _OPENED:
        _OPENED[path] = load(path)
    return _OPENED[path]


def lists16(spark: SparkSession, sf: str) -> ivf.IvfIndex:
    """A stored clustered index around the vectors of the 16 lowest ids."""

    def make(path: str) -> None:
        rows = vectors(spark, sf)
        centroids = ivf.seeds(rows, 16)
        ivf.IvfIndex(centroids, ivf.assigned(rows, centroids)).save(path)

    return opened(held(spark, sf, "lists16", make), lambda path: ivf.IvfIndex.load(spark, path))


for _name, _nprobe in (("ivf_search_np1", 1), ("ivf_search_full", 16)):
    query(_probe_sql(_nprobe), _name)(lambda spark, sf, n=_nprobe: rounded(sampled(spark, sf, lambda asked: lists16(spark, sf).search(asked, 10, n))))


@query(_probe_sql(1))
def ivf_search_preset(spark: SparkSession, sf: str) -> DataFrame:
    """The preset ``fast`` probes one list."""
    own = lists16(spark, sf)
    index = VectorIndex("ivf", own.rows, ivf=own)
    return rounded(sampled(spark, sf, lambda asked: index.search(asked, 10, search_config(preset="fast"))))


@query(f"""WITH {C_SQL}, {SEEDS}, n AS (SELECT id + 1000000 AS id, v FROM c WHERE label = 1), t AS (SELECT id, v FROM c WHERE label <> 2 UNION ALL SELECT id, v FROM n),
    a AS (SELECT t.id, arg_max(cid, (round(list_cosine_similarity(v, cv), 12), cid)) AS cid FROM t, s GROUP BY t.id) SELECT cid, count(*) AS n FROM a GROUP BY cid""")
def ivf_insert_remove(spark: SparkSession, sf: str) -> DataFrame:
    """List sizes after new rows, rows that are there already, and a removal."""
    rows = vectors(spark, sf)
    new = rows.where("label = 1").withColumn("id", F.col("id") + 1000000)
    return lists16(spark, sf).insert(new.union(rows.where("label = 3"))).remove(rows.where("label = 2")).sizes()


@query()
def ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """(q_id, recall) at 10 of the clustered index as built by default against the exact result, for every row with id % 100 = 0."""
    rows = vectors(spark, sf)
    index = ivf.IvfIndex.build(rows)
    return sampled(spark, sf, lambda asked: recall_of(index.search(asked, 10), knn.knn_batch(rows, asked, 10)))


@query("SELECT count(*) AS n, greatest(floor(sqrt(count(*))), 10)::BIGINT AS clusters, floor(least(greatest(0.1 * greatest(floor(sqrt(count(*))), 10), 1), 10))::BIGINT AS nprobe, 10::BIGINT AS iterations FROM embeddings")
def ivf_auto_params(spark: SparkSession, sf: str) -> DataFrame:
    n = vectors(spark, sf).count()
    return spark.createDataFrame([(n, *ivf.auto_parameters(n))], "n bigint, clusters bigint, nprobe bigint, iterations bigint")


@query(f"WITH {C_SQL}, {SEEDS}, {ASSIGN % 's'} SELECT count(*) AS n, count(DISTINCT cid) AS lists, sum(16 + 4 * len(v))::BIGINT AS bytes FROM a JOIN c ON a.id = c.id")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    held = ivf.assigned(rows, ivf.seeds(rows, 16))
    return held.agg(F.count("*").alias("n"), F.countDistinct("cid").alias("lists"), F.sum(T.vector_bytes()).alias("bytes"))


@query("SELECT n, CASE WHEN n < 10000 THEN 'flat' WHEN n < 100000 THEN 'ivf' ELSE 'hnsw' END AS kind FROM (SELECT count(*) AS n FROM embeddings UNION ALL SELECT count(*) * 10 FROM documents UNION ALL SELECT count(*) * 100 FROM events)")
def select_index_type(spark: SparkSession, sf: str) -> DataFrame:
    counts = [vectors(spark, sf).count(), table(spark, sf, "documents").count() * 10, table(spark, sf, "events").count() * 100]
    return spark.createDataFrame([(n, IndexConfig().choose(n)) for n in counts], "n bigint, kind string")


def graphs(spark: SparkSession, sf: str) -> graph.GraphIndex:
    """The stored graph index of all rows."""
    path = held(spark, sf, "graphs", lambda path: graph.GraphIndex.build(vectors(spark, sf), path))
    return opened(path, lambda path: graph.GraphIndex.load(spark, path))


REACHED_SQL = "SELECT vec_id AS q_id, true AS reached FROM embeddings WHERE vec_id % 100 = 0"


def _reached(recall: DataFrame) -> DataFrame:
    return recall.select("q_id", (F.col("recall") >= 0.9).alias("reached"))


@query(REACHED_SQL)
def hnsw_recall(spark: SparkSession, sf: str) -> DataFrame:
    """(q_id, reached): whether the graph index finds nine of the ten rows that the exact search finds, for every row with id % 100 = 0."""
    return _reached(sampled(spark, sf, lambda asked: recall_of(graphs(spark, sf).search(asked, 10, 400), knn.knn_batch(vectors(spark, sf), asked, 10))))


@query(_batch_sql(10, where="c.label = 3"))
def hnsw_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The graph search among the rows that a filter leaves, with the exact check."""
    rows = vectors(spark, sf)
    some = rows.where(Filter().eq("label", 3).column(rows))
    return rounded(sampled(spark, sf, lambda asked: graphs(spark, sf).search(asked, 10, allowed=some, exact=True)))


def without_fours(spark: SparkSession, sf: str) -> graph.GraphIndex:
    """A stored graph index whose rows of label 4 were removed and are tombstones."""

    def make(path: str) -> None:
        rows = vectors(spark, sf)
        graph.GraphIndex.build(rows, path).remove(rows.where("label = 4"))

    return graph.GraphIndex.load(spark, held(spark, sf, "tombstones", make))


@query(REACHED_SQL)
def hnsw_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    """(q_id, reached): whether a walk past tombstones finds nine of ten of the exact search's rows and no removed one."""
    live = vectors(spark, sf).where("label <> 4")

    def run(asked: DataFrame) -> DataFrame:
        near = without_fours(spark, sf).search(asked, 10, 400).join(live.select("id"), "id", "left_semi")
        return recall_of(near, knn.knn_batch(live, asked, 10))

    return _reached(sampled(spark, sf, run))


@query("SELECT count(*) FILTER (label <> 4) AS nodes, count(*) FILTER (label = 4) AS tombstones, count(*) AS lowest_layer, true AS linked FROM embeddings")
def hnsw_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes, tombstones, the nodes of the lowest layer, and whether they have 4 to 32 links on average."""
    found = without_fours(spark, sf).stats()
    linked = F.bool_and(F.col("average_degree").between(4, 32)).alias("linked")
    return found.agg(F.sum("nodes").alias("nodes"), F.sum("tombstones").alias("tombstones"), F.sum(F.get("layers", F.lit(0))).alias("lowest_layer"), linked)


@query("SELECT count(*) FILTER (label <> 4) + count(*) FILTER (label = 1) AS live FROM embeddings")
def hnsw_insert_remove(spark: SparkSession, sf: str) -> DataFrame:
    """Live nodes after a removal, new rows, and rows that are there already."""
    rows, index = vectors(spark, sf), graph.GraphIndex.build(vectors(spark, sf))
    index.remove(rows.where("label = 4"))
    index.insert(rows.where("label = 1").withColumn("id", F.col("id") + 1000000).union(rows.where("label = 2")))
    return index.stats().agg(F.sum("nodes").alias("live"))


@query(_batch_sql(10))
def index_auto_search(spark: SparkSession, sf: str) -> DataFrame:
    """The index that is built where the settings name none: the scan, so that no row is missed, however many there are."""
    index = VectorIndex.build(vectors(spark, sf))
    return rounded(sampled(spark, sf, index.search))


def _index(spark: SparkSession, sf: str, kind: str) -> VectorIndex:
    config = IndexConfig(kind=kind)
    path = held(spark, sf, f"index-{kind}", lambda path: VectorIndex.build(vectors(spark, sf), config, path=path))
    return VectorIndex.load(spark, path, kind, config, rows=vectors(spark, sf))


def _index_recall(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """(q_id, recall) at 10 of a stored index of that kind, however many rows there are, for every row with id % 100 = 0."""
    return sampled(spark, sf, lambda asked: recall_of(_index(spark, sf, kind).search(asked), knn.knn_batch(vectors(spark, sf), asked, 10)))


def _kind_reached(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """(queries, reached): whether the mean recall at 10 is 0.9 or more."""
    return _index_recall(spark, sf, kind).agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("reached"))


@query(_batch_sql(10))
def index_flat_search(spark: SparkSession, sf: str) -> DataFrame:
    index = VectorIndex.build(vectors(spark, sf), IndexConfig(kind="flat"))
    return rounded(sampled(spark, sf, index.search))


@query(f"""WITH t AS (SELECT vec_id AS id FROM embeddings WHERE label <> 2 UNION ALL SELECT vec_id + 1000000 FROM embeddings WHERE label = 1) SELECT count(*) AS vectors, max(id) AS last FROM t""")
def index_flat_insert_remove(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    new = rows.where("label = 1").withColumn("id", F.col("id") + 1000000)
    index = VectorIndex.build(rows, IndexConfig(kind="flat")).insert(new.union(rows.where("label = 3"))).remove(rows.where("label = 2"))
    return index.rows.agg(F.count("*").alias("vectors"), F.max("id").alias("last"))


MEAN_SQL = "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0"
query(MEAN_SQL, "index_ivf_reached")(lambda spark, sf: _kind_reached(spark, sf, "ivf"))
query(MEAN_SQL, "index_hnsw_reached")(lambda spark, sf: _kind_reached(spark, sf, "hnsw"))
query(None, "index_ivf_recall")(lambda spark, sf: _index_recall(spark, sf, "ivf"))
query(None, "index_hnsw_recall")(lambda spark, sf: _index_recall(spark, sf, "hnsw"))


@query("SELECT 'flat' AS kind, count(*) AS vectors, sum(16 + 4 * len(embedding))::BIGINT AS bytes, 0::BIGINT AS lists FROM embeddings")
def index_auto_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What the index of ``index_auto_search`` holds; as in the SQL, bytes are null where no row has a vector."""
    found = VectorIndex.build(vectors(spark, sf)).stats()
    return found.select("kind", "vectors", F.nullif("bytes", F.lit(0)).alias("bytes"), "lists")  # a vector takes 16 at least


@query(f"WITH {C_SQL}, {Q_SQL} SELECT id, {q6(COS_SQL)} AS cosine, {q6('list_distance(v, qv)')} AS l2 FROM c, q WHERE {COS_SQL} > 0.2")
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The distance functions as SQL users call them."""
    register(spark)
    vectors(spark, sf).createOrReplaceTempView("arrowfen_vectors")
    q = "array(" + ", ".join(f"{x!r}D" for x in first_vector(spark, sf)) + ")"
    return spark.sql(f"SELECT id, round(vec_cosine(vector, {q}), 6) + 0D AS cosine, round(vec_l2(vector, {q}), 6) + 0D AS l2 FROM arrowfen_vectors WHERE vec_cosine(vector, {q}) > 0.2")


# mutations

NEW_SQL = "n AS (SELECT vec_id + (SELECT count(*) // 2 FROM embeddings) AS id, label + 100 AS label FROM embeddings WHERE label < 8)"


def _new_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of most labels moved by half the table, so some replace others and some are new."""
    half = vectors(spark, sf).count() // 2
    return vectors(spark, sf).where("label < 8").select((F.col("id") + half).alias("id"), "vector", (F.col("label") + 100).alias("label"))


@query(f"WITH {NEW_SQL} SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM n) UNION ALL SELECT id, label FROM n")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.upserted(vectors(spark, sf), _new_rows(spark, sf)).select("id", "label")


@query(f"WITH {NEW_SQL} SELECT id, id NOT IN (SELECT vec_id FROM embeddings) AS created FROM n")
def upsert_created_flags(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.created_flags(vectors(spark, sf), _new_rows(spark, sf))


@query(f"""WITH {C_SQL}, n AS (SELECT unnest(range(10)) AS k) SELECT id::VARCHAR AS id, {q6('list_sum(v)')} AS total, 't' || label AS text, '{{}}' AS metadata FROM c
    UNION ALL SELECT 'new', 64 * (k + 1) / 8.0, 'new ' || k, CASE WHEN k < 3 THEN '{{"k":' || k || '}}' ELSE '{{}}' END FROM n""")
def insert_batch(spark: SparkSession, sf: str) -> DataFrame:
    """All rows with ten new ones, whose ids are fresh; the first three bring metadata."""
    base = vectors(spark, sf).select(F.col("id").cast("string"), "vector", F.concat(F.lit("t"), "label").alias("text"), F.lit("{}").alias("metadata"))
    rows = mutate.insert_batch(base, [[(k + 1) / 8] * 64 for k in range(10)], [f"new {k}" for k in range(10)], [f'{{"k":{k}}}' for k in range(3)])
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    id = F.when(F.col("id").rlike("^[0-9a-f]{8}-"), "new").otherwise(F.col("id"))
    return rows.select(id.alias("id"), r6(total).alias("total"), "text", "metadata")


GONE_SQL = "d AS (SELECT doc_id * 3 AS id FROM documents UNION ALL SELECT doc_id * 3 FROM documents WHERE doc_id % 7 = 0)"


def _gone(spark: SparkSession, sf: str) -> DataFrame:
    """Ids to delete: some twice, some of no row."""
    ids = table(spark, sf, "documents").select((F.col("doc_id") * 3).alias("id"))
    return ids.union(ids.where("id % 7 = 0"))


@query(f"WITH {GONE_SQL} SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM d)")
def delete_batch(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.deleted(vectors(spark, sf), _gone(spark, sf)).select("id", "label")


@query(f"WITH {GONE_SQL} SELECT count(*) AS n FROM embeddings WHERE vec_id IN (SELECT id FROM d)")
def delete_count(spark: SparkSession, sf: str) -> DataFrame:
    return mutate.deleted_count(vectors(spark, sf), _gone(spark, sf))


@query("SELECT vec_id AS id, CASE WHEN vec_id < 50 THEN -vec_id ELSE label END::INTEGER AS label FROM embeddings")
def update_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    changes = rows.where("id < 50").select("id", (-F.col("id")).cast("int").alias("label"))
    return mutate.updated(rows, changes, "label").select("id", "label")


@query(f"SELECT vec_id AS id, {q6('list_sum(embedding::DOUBLE[]) * CASE WHEN vec_id < 50 THEN 2 ELSE 1 END')} AS total FROM embeddings")
def update_vector(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    changes = mutate.checked(rows.where("id < 50").select("id", F.transform("vector", lambda x: x * F.lit(2.0).cast("float")).alias("vector")), 64)
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return mutate.updated(rows, changes, "vector").select("id", r6(total).alias("total"))


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), h AS (SELECT count(*) AS k FROM embeddings WHERE vec_id + (SELECT n // 2 FROM n) NOT IN (SELECT vec_id FROM embeddings))
    SELECT 'max_vectors' AS rule, n + k AS value, n AS bound FROM n, h UNION ALL SELECT 'max_bytes', (n + k) * (16 + 4 * 64 + 3), n * 100 FROM n, h UNION ALL SELECT 'max_vector_bytes', 16 + 4 * 64 + 3, 200 FROM n""")
def limits_violations(spark: SparkSession, sf: str) -> DataFrame:
    """All rows moved by half the table are inserted: some are there already, the others break every limit."""
    base = vectors(spark, sf).select("id", "vector", F.lit("abc").alias("text"))
    n = base.count()
    return mutate.limit_violations(base, base.withColumn("id", F.col("id") + n // 2), Limits(max_vectors=n, max_bytes=100 * n, max_vector_bytes=200))


# change log

REPLAY_SQL = "SELECT id, seq, type, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM w %s) WHERE r = 1 AND type <> 'Delete'"


@query(f"WITH {EVENTS_SQL} {REPLAY_SQL % ''}")
def wal_replay(spark: SparkSession, sf: str) -> DataFrame:
    return replayed(events(spark, sf)).select("id", "seq", "type", "value")


@query(f"WITH {EVENTS_SQL} {REPLAY_SQL % 'WHERE seq > 700'}")
def wal_replay_from_seq(spark: SparkSession, sf: str) -> DataFrame:
    return replayed(events(spark, sf).where("seq > 700")).select("id", "seq", "type", "value")


def _log_lines(spark: SparkSession, sf: str) -> str:
    """The change log as JSON lines in the shared folder."""
    path = shared_path(spark, "wal")
    write_wal(events(spark, sf).select("type", "seq", F.col("id").cast("string"), F.col("value").cast("string").alias("text")), path)
    return path


LINES_SQL = f"WITH {EVENTS_SQL} SELECT id::VARCHAR AS id, seq, type FROM ({REPLAY_SQL % ''})"


@query(LINES_SQL)
def wal_file_replay(spark: SparkSession, sf: str) -> DataFrame:
    return replayed(read_wal(spark, _log_lines(spark, sf))).select("id", "seq", "type")


@query(LINES_SQL)
def wal_stream_replay(spark: SparkSession, sf: str) -> DataFrame:
    state = shared_path(spark, "state")
    merge_log(spark, _log_lines(spark, sf), state, shared_path(spark, "progress")).awaitTermination()
    return merged_rows(spark, state).select("id", "seq", "type")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark: SparkSession, sf: str) -> DataFrame:
    return windowed_counts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", "event_type")


# telemetry


@query("SELECT vec_id AS id, label FROM embeddings ORDER BY vec_id DESC LIMIT 64")
def meta_cache_fifo(spark: SparkSession, sf: str) -> DataFrame:
    return T.newest_kept(vectors(spark, sf).select("id", "label"), "id", 64)


@query("""WITH s AS (SELECT source AS name, sum(n_chars)::BIGINT AS size FROM documents GROUP BY source),
    o AS (SELECT *, sum(size) OVER () - coalesce(sum(size) OVER (ORDER BY size DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM s)
    SELECT name, size, left_ > (SELECT sum(size) // 2 FROM s) AS evict FROM o""")
def cache_budget_evict(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").alias("size"))
    return T.evicted(sizes, "name", "size", sizes.agg(F.sum("size")).first()[0] // 2)


@query("""SELECT event_type AS operation, len(xs)::BIGINT AS n, list_reduce(xs, lambda acc, x, i: CASE WHEN i <= 5 THEN (acc * (i - 1) + x) // i ELSE (4 * acc + x) // 5 END) AS average
    FROM (SELECT event_type, list(floor(value * 1000)::BIGINT ORDER BY ts, event_id) AS xs FROM events GROUP BY event_type)""")
def latency_ema(spark: SparkSession, sf: str) -> DataFrame:
    samples = table(spark, sf, "events").select(F.col("event_type").alias("operation"), "ts", "event_id", F.floor(F.col("value") * 1000).alias("us"))
    return T.latency_average(samples, "operation", ["ts", "event_id"], "us")


@query(f"""SELECT role, count(*) AS requests, sum(1)::BIGINT AS texts, sum(len(string_split(text, ' ')))::BIGINT AS tokens,
    {q6("sum(octet_length(encode(text)) * 1000) / count(*) / 1e6")} AS mean_ms FROM conversations GROUP BY role""")
def embed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "conversations").select("role", F.lit(1).alias("texts"), F.size(F.split("text", " ")).alias("tokens"), (F.octet_length("text") * 1000).alias("nanoseconds"))
    return T.embedding_totals(calls, "role").withColumn("mean_ms", r6(F.col("mean_ms")))


@query("SELECT label, count(*) AS n, sum(16 + 4 * len(embedding))::BIGINT AS bytes FROM embeddings GROUP BY label")
def memory_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.sum(T.vector_bytes()).alias("bytes"))


@query("SELECT count(*) AS collections, sum(n)::BIGINT AS vectors FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def collection_totals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").count().agg(F.count("*").alias("collections"), F.sum("count").alias("vectors"))


# embedding


@query("SELECT count(text) AS requests, count(DISTINCT text) AS calls, sum(octet_length(encode(text)))::DOUBLE AS total FROM conversations")
def embed_dedupe_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a vector, the calls that an embedder counts while a table is embedded, and the sum of the vectors."""
    calls, mock = spark.sparkContext.accumulator(0), E.mock()

    def counted(text: str) -> tuple[list[float], int | None]:
        calls.add(1)
        return mock(text)

    done = E.embedded(table(spark, sf, "conversations"), counted).agg(F.count("vector").alias("n"), F.sum(F.get("vector", F.lit(0)).cast("double")).alias("total")).first()
    return spark.createDataFrame([(done.n, calls.value, done.total)], "requests bigint, calls bigint, total double")


@query("""WITH e AS (SELECT doc_id AS id, octet_length(encode(text))::DOUBLE AS x FROM documents WHERE text IS NOT NULL)
    SELECT id, round(score, 6) + 0.0 AS score FROM (SELECT id, 1 / (1 + abs(x - 500)) AS score FROM e) ORDER BY score DESC, id LIMIT 10""".replace("ORDER BY score", "ORDER BY round(score, 12)"))
def text_search_mock(spark: SparkSession, sf: str) -> DataFrame:
    """Texts embedded by their length, searched with a text of 500 bytes."""
    docs = E.embedded(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), E.mock())
    return _hits(knn.knn(docs, E.mock()("x" * 500)[0], 10, "euclidean"))


@query()
def text_search_hashed(spark: SparkSession, sf: str) -> DataFrame:
    """(q_id, rank, id, score): the documents nearest to each benchmark passage by hashed words."""
    asked = E.embedded(table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), "text"), E.hashing(64)).select("q_id", "vector")
    docs = E.embedded(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), E.hashing(64))
    return in_batches(asked, lambda some: knn.knn_batch(docs, some, 10)).withColumn("score", r6(F.col("score")))


@query("SELECT count(*) AS n, count(*) AS fresh, true AS well_formed FROM embeddings")
def uuid_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = vectors(spark, sf).select(F.expr("uuid()").alias("u"))
    good = F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return ids.agg(F.count("*").alias("n"), F.countDistinct("u").alias("fresh"), F.bool_and(good).alias("well_formed"))


from . import lifecycle  # noqa: E402, F401  registers its queries
