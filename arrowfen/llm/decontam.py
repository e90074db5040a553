"""Benchmark decontamination by a prefix-filtered join of word windows.

Only DataFrame functions run here. Each window of a benchmark item is a set of
one-word shingles that a document must contain whole. Ordered by rarity in the
documents, its first shingle is the necessary prefix: a document without that
word can't contain the window. Document words are joined with these prefixes;
length and positional bounds leave one place where the window may lie, and the
words there are compared with the window exactly.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

WINDOW = 13
#: Bytes of windows that one broadcast holds; more windows are joined block by block.
BLOCK_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that no word holds, before A-Z are lower-cased. Listed one by one, as Java tests such a class by a table.
_GAPS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
GAP, WORD = f"[{_GAPS}]", f"[^{_GAPS}]++"


def fold(text: Column) -> Column:
    """A-Z to lower case, nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, as written."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    count = F.length(F.regexp_replace(text, f"{GAP}*+{WORD}{GAP}*+", "x"))
    return F.when(text.rlike(WORD), count).otherwise(0).cast("long")


def _each(ws: str) -> Column:
    """``ws`` for a generator; as a plain column it would be filtered by size first, and so made twice."""
    return F.coalesce(F.col(ws), F.array().cast("array<string>"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, items) of a table (item_id, text): each distinct window, and the ids that have it as sorted strings.

    An item of fewer words, but not none, is one window. A null item_id counts as ''.
    """
    found = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(fold(F.col("text"))).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - size + 1, F.lit(1)))
    each = found.select("item", F.explode(F.transform(starts, lambda i: F.slice("ws", i, F.lit(size)))).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items"))


def _prefixes(held: DataFrame, seen: DataFrame) -> DataFrame:
    """Adds each window's rarest word (``token``), its place (``off``) and the window's length and text."""
    spread = held.select("window", "items", F.posexplode("window").alias("off", "word")).withColumn("token", F.lower("word"))
    counted = spread.join(F.broadcast(seen), "token", "left")
    rarest = counted.groupBy("window").agg(F.first("items").alias("items"), F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "off")).alias("p"))
    return rarest.where("p.n > 0").select("items", F.col("p.token").alias("token"), F.col("p.off").alias("off"), F.size("window").alias("len"), F.array_join("window", " ").alias("joined"))


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_hash, start, len, items): each place of a document where a window occurs, counted in words from 0.

    Null and empty texts have no places; texts are read whole, however long;
    repeated rows repeat their places; an empty benchmark or table gives none.
    """
    held = stored(windows(items, size))
    total = held.agg(F.sum(F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", " ")) + 64)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    text = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("ws"))
    parts = []
    for k in range(blocks):
        some = held.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k) if blocks > 1 else held
        vocabulary = some.select(F.explode("window").alias("word")).select(F.lower("word").alias("token")).distinct()
        every = text.select(F.explode(_each("ws")).alias("word")).select(F.lower("word").alias("token"))
        seen = every.join(F.broadcast(vocabulary), "token").groupBy("token").agg(F.count("*").alias("n"))
        prefix = _prefixes(some, seen)
        placed = text.select("doc_id", "text_hash", "ws", F.posexplode(_each("ws")).alias("pos", "word"))
        start = F.col("pos") - F.col("off")
        fits = (start >= 0) & (start + F.col("len") <= F.size("ws"))
        same = F.expr("array_join(slice(ws, greatest(pos - off, 0) + 1, len), ' ')")
        found = placed.join(F.broadcast(prefix), (F.lower("word") == F.col("token")) & fits & (fold(same) == F.col("joined")))
        parts.append(found.select("doc_id", "text_hash", start.alias("start"), "len", "items"))
    return reduce(DataFrame.union, parts)


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every row of ``docs`` (doc_id, text, ...): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing
    A-Z. A word inside any occurrence of an item's window is hit; a document
    is contaminated if a twentieth of its words are. Null texts have no words.
    Repeated rows and null doc_ids are judged like any other: rows are told
    apart by doc_id and text. An empty benchmark hits nothing; an empty table
    gives an empty table.
    """
    hits = occurrences(docs, items, size, block_bytes).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "len")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found"),
    )
    inside = F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.size(F.array_distinct(F.flatten(inside))).cast("long").alias("n"), "found")
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), n_words(F.col("text")).alias("n_words"))
    both = base.join(hits, base.doc_id.eqNullSafe(hits.d) & (base.text_hash == hits.t), "left")
    none = F.array().cast("array<string>")
    out = both.select(
        "doc_id", "text_hash", "n_words", F.coalesce("n", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("found", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("found", none), ","), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
