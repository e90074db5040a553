"""The change log: JSON lines of inserts, updates, deletes and checkpoints, replayed last writer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 1
SCHEMA = "type string, seq long, id string, vector array<float>, text string, metadata string, timestamp long, version int"
ENTRY = ("type", "seq", "id", "vector", "text", "metadata", "timestamp")


def parsed(lines: DataFrame, *keep: str) -> DataFrame:
    """Entries of a table (value) of log lines, batch or streaming, with its columns ``keep``; a header of another version raises."""
    entries = lines.where(F.trim("value") != "").select(*keep, F.from_json("value", SCHEMA, {"mode": "FAILFAST"}).alias("e")).select(*keep, "e.*")
    known = F.col("version").isNull() | (F.col("version") == VERSION)
    checked = entries.withColumn("version", F.when(known, F.col("version")).otherwise(F.raise_error(F.lit("unknown log version")).cast("int")))
    return checked.where("version is null").select(*keep, *ENTRY)


def read_wal(spark: SparkSession, path: str, min_seq: int = -1) -> DataFrame:
    """Entries after ``min_seq``."""
    return parsed(spark.read.text(path)).where(F.col("seq") > min_seq)


def stream_wal(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.readStream.format("text").load(path))


def write_wal(entries: DataFrame, path: str, mode: str = "append") -> None:
    """Appends entries (the columns of ENTRY that they have) as log lines."""
    have = [c for c in ENTRY if c in entries.columns]
    entries.select(F.to_json(F.struct(*have)).alias("value")).write.mode(mode).text(path)


def last_entries(entries: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last entry of each key, as ``key`` and struct ``e``; an aggregate with map-side combine, so hot keys don't gather."""
    others = [c for c in entries.columns if c not in (key, seq)]
    return entries.groupBy(key).agg(F.max_by(F.struct(seq, *others), F.col(seq)).alias("e"))


def replayed(entries: DataFrame, base: DataFrame | None = None, key: str = "id", seq: str = "seq", op: str = "type") -> DataFrame:
    """The rows that a log leaves, over the rows ``base`` that were there before it.

    Inserts and updates replace the whole row, deletes remove it, checkpoints
    change nothing.
    """
    last = last_entries(entries.where(F.col(op).isin("Insert", "Update", "Delete")), key, seq)
    alive = last.where(F.col(f"e.{op}") != "Delete").select(key, "e.*")
    if base is None:
        return alive
    kept = base.join(last.select(key), key, "left_anti")
    return kept.unionByName(alive.select(*[c for c in base.columns]))


def log_offsets(entries: DataFrame, order: str = "seq", ranges: int = 256) -> DataFrame:
    """(order, offset, length) of each entry's log line in one file; the next line begins where the last one ends.

    Offsets are sums over ranges of ``order``, a long, plus sums within a range, so no task holds the whole log.
    """
    have = [c for c in ENTRY if c in entries.columns]
    lines = entries.select(order, (F.octet_length(F.to_json(F.struct(*have))) + 1).cast("long").alias("length"))
    low, high = lines.agg(F.min(order), F.max(order)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // ranges))
    lines = lines.withColumn("_r", F.floor((F.col(order) - F.lit(low or 0)) / width))
    earlier = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = lines.groupBy("_r").agg(F.sum("length").alias("_n")).select("_r", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = lines.withColumn("_own", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    return own.join(F.broadcast(before), "_r").select(order, (F.col("_before") + F.col("_own")).alias("offset"), "length")


def used_bytes(offsets: DataFrame) -> DataFrame:
    """One row: used_bytes, where the next line begins."""
    return offsets.agg(F.coalesce(F.max(F.col("offset") + F.col("length")), F.lit(0)).alias("used_bytes"))
