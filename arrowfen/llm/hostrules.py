"""Quality rules judged per host, with DataFrame functions only.

Every document is measured; rule failures are counted by host; each host's
failure rate is shrunk towards the rate of all hosts by an empirical beta
prior, so hosts with few documents aren't judged on chance; and the verdict on
a host is joined back to its documents. A host whose documents mostly fail is
rejected as a whole; of a host that fails surely more often than hosts do on
the whole, the documents that break any rule go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import beside
from .scratch import stored

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: With more repeated windows than this, they are found by sorting instead of by search.
FEW = 16
#: A host is rejected if its failure rate, less so many standard deviations, exceeds the limit, and suspect if it exceeds so many times the mean of all hosts.
HOST_LIMIT, DEVIATIONS, MULTIPLE = 0.5, 2.0, 1.5


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))


def _covered(places: Column) -> Column:
    """Words in the three-word windows that begin at these ascending places."""
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
    return F.aggregate(places, zero, step, lambda acc: acc["n"])


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with the measures of each text beside ``keep``.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and rule_failed. A document fails a rule if it breaks the base
    rules, has over a tenth of symbols among its characters, or over three
    tenths of repeated lines. A null text counts as empty and has no words.
    Windows of equal hash are compared word by word.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select(*keep, text.alias("_text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"))  # _w: words
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    hashes = F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), window)).otherwise(F.array().cast("array<bigint>"))
    one = cut.select(
        *keep, F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"), _lines(F.col("_text")).alias("_lines"), "_w", hashes.alias("_h"),
    )
    # most texts repeat no window: sort only where one does
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    two = one.withColumn("_s", F.when(some, F.sort_array("_h")).otherwise(F.array().cast("array<bigint>")))
    three = two.withColumn("_v", F.array_distinct(F.filter("_s", lambda x, k: (k > 0) & (F.get("_s", k - 1) == x))))
    find = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: F.array_contains("_v", F.get("_h", i)))
    four = three.withColumn("_t", F.when(F.size("_v") > FEW, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, k: F.coalesce(F.get("_t", k)["h"] == x["h"], F.lit(False))
    sift = F.sort_array(F.transform(F.filter("_t", lambda x, k: twin(x, k - 1) | twin(x, k + 1)), lambda x: x["i"]))
    none = F.array().cast("array<int>")
    five = four.withColumn("_q", F.when(F.size("_v") == 0, none).when(F.size("_v") <= FEW, find).otherwise(sift))
    # of the places with a repeated hash, those whose words repeat
    words_at = F.sort_array(F.transform("_q", lambda i: F.struct(F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("s"), i.alias("i"))))
    five = five.withColumn("_x", words_at)
    same = lambda x, k: F.coalesce(F.get("_x", k)["s"] == x["s"], F.lit(False))
    twice = F.sort_array(F.transform(F.filter("_x", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    five = five.withColumn("_p", twice)
    n_dup = F.size("_lines") - F.size(F.array_distinct("_lines"))
    measures = [
        "n_words", "word_chars", "n_symbols", n_dup.cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"), _covered(F.col("_p")).alias("n_repeat_words"),
    ]
    # as a generator's output, so that no filter on a measure is pushed down and repeats what makes it
    six = five.select(*keep, F.inline(F.array(F.struct(*measures))))
    seven = six.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    soft = (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
    return seven.withColumn("rule_failed", F.col("base_failed") | soft).drop("n_lines")


def host_verdicts(rows: DataFrame, limit: float = HOST_LIMIT, deviations: float = DEVIATIONS, multiple: float = MULTIPLE) -> DataFrame:
    """(host, rejected) of the hosts of a table (host, rule_failed) that aren't trusted.

    Each host's failure rate is shrunk by the beta prior; less ``deviations``
    of its standard deviations it must exceed ``limit`` for the host to be
    rejected, or ``multiple`` times the mean rate for it to be suspect. The
    prior is fitted to the rates of all hosts by moments; only its two numbers
    reach the driver. Null hosts are one host; null failures count as none; an
    empty table has no hosts.
    """
    hosts = stored(rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if("rule_failed").alias("f")))
    rate = F.col("f") / F.col("n")
    mean, spread, chance = hosts.agg(F.sum("f") / F.sum("n"), F.var_samp(rate), F.avg(1 / F.col("n"))).first()
    mean = mean or 0.0
    chance = (chance or 0.0) * mean * (1 - mean)
    between = max((spread or 0.0) - chance, 1e-6)
    weight = min(max(mean * (1 - mean) / between - 1, 1.0), 1000.0)
    shrunk = (F.col("f") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    sure = shrunk - deviations * F.sqrt(shrunk * (1 - shrunk) / (F.col("n") + F.lit(weight + 1)))
    return hosts.select("host", (sure > limit).alias("rejected"), (sure > F.lit(multiple * mean)).alias("suspect")).where("rejected or suspect").select("host", "rejected")


def host_key(source: str) -> Column:
    """A host for each source; null sources form one of their own."""
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(source))).alias("host")


def _verdict(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``rows`` (host, base_failed, rule_failed, ...) with ``kept``, by the host's verdict."""
    both = beside(rows, stored(verdicts), F.octet_length("host"), ["host"])
    gone = F.col("base_failed") | F.coalesce("rejected", F.lit(False)) | F.col("rejected").isNotNull() & F.col("rule_failed")
    return both.withColumn("kept", ~gone).drop("rejected")


def judged(docs: DataFrame, source: str = "source", limit: float = HOST_LIMIT, multiple: float = MULTIPLE) -> DataFrame:
    """Every row of ``docs``: doc_id, its measures, base_failed and kept.

    kept is false where the base rules fail, the row's host is rejected, or it
    is suspect and the row fails any rule. Texts are measured whole, however
    long. Repeated rows, null ids and null sources, which form a host of their
    own, are rows like any other; a null text has no words and fails. An empty
    table gives an empty table.
    """
    rows = stored(measured(docs.select("doc_id", "text", host_key(source)), "doc_id", "host"))
    return _verdict(rows, host_verdicts(rows, limit, multiple=multiple)).drop("host", "rule_failed")


def without_failing(docs: DataFrame, source: str = "source", limit: float = HOST_LIMIT, multiple: float = MULTIPLE) -> DataFrame:
    """``docs``, all columns, without the rows that ``judged`` doesn't keep.

    Nulls, empty and long texts, repeated rows and empty tables count as there.
    Every text is measured once; rows that pass the base rules are stored
    beside their measures, so texts never take part in a shuffle.
    """
    rows = measured(docs.select(F.struct("*").alias("_row"), "text", host_key(source)), "_row", "host")
    held = stored(rows.select("host", "base_failed", "rule_failed", F.when(~F.col("base_failed"), F.col("_row")).alias("_row")))
    passed = held.where("not base_failed")
    return _verdict(passed, host_verdicts(held, limit, multiple=multiple)).where("kept").select("_row.*")
