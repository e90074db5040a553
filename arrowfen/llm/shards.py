"""Proportional stratified interleaving of rows into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import beside
from .scratch import stored

#: Rows that one ranking task holds at most, about; and the fewest ranges used.
RANGE_ROWS, RANGES = 65536, 256


#: So many times RANGE_ROWS make a range be searched for rows that share a hash.
CROWDED = 4


def _before(counts: DataFrame, by: list, *order: str) -> DataFrame:
    """Adds ``before``, the rows of all earlier ranges."""
    earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _spread(rows: DataFrame, range_rows: int) -> DataFrame:
    """``rows`` with ``sub``: 0, but in ranges that a mass of equal rows crowds, by which the range is cut further.

    Rows that are equal in every column share a hash, and any order of them is
    as good, so they are dealt over several ranks by their place in the table.
    """
    plain = rows.withColumn("sub", F.lit(0).cast("bigint"))
    crowded = rows.groupBy("src", "b").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED * range_rows).select("src", "b")
    crowded = stored(crowded)
    if crowded.isEmpty():
        return plain
    held = stored(rows.withColumn("place", F.monotonically_increasing_id()))  # places must stay as they are
    often = held.join(crowded, ["src", "b"], "left_semi").groupBy("src", "b", "h").agg(F.count("*").alias("n")).where(F.col("n") > range_rows)
    masses = stored(often.groupBy("src", "b").agg(F.array_sort(F.collect_list(F.struct("h", "n"))).alias("masses")))  # at most a range's rows over range_rows
    both = beside(held, masses, F.octet_length("src") + 16 * F.size("masses") + 8, ["src", "b"])
    below = F.size(F.filter("masses", lambda m: m["h"] < F.col("h")))
    own = F.get(F.filter("masses", lambda m: m["h"] == F.col("h")), 0)["n"]
    cuts = F.ceil(own / range_rows)
    # an even number between masses, an odd one and a cut for a mass
    sub = F.when(own.isNotNull(), (2 * below + 1) * F.lit(1 << 40) + F.pmod(F.xxhash64("place"), cuts)).otherwise(2 * below * F.lit(1 << 40))
    return both.withColumn("sub", F.coalesce(sub, F.lit(0)).cast("bigint")).drop("masses", "place")


def interleave(docs: DataFrame, n_shards: int = 40, seed: int = 17, source: str = "source", range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    Rows are shuffled by a seeded hash within each source, ranked there, and
    sorted by fractional rank (rank - 1/2) / rows of the source; equal cuts of
    that order are the shards, so each has the mixture of the whole and their
    row counts are at most one apart (law ``rows``). ``slot`` is the place in
    the shard, from 0. Ranks are prefix sums over ranges of the hash plus a
    rank within a range, so no task holds a whole source, nor a mass of equal
    rows.

    A null text has size 16 and checksum 0; null sources form a source of
    their own; null ids and repeated rows are rows like any other. Fewer rows
    than shards leave shards empty. An empty table gives an empty table.
    """
    total = docs.count()
    ranges = max(RANGES, -(-total // range_rows))
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(source)))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("src"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", "src"), 33))
    rows = rows.withColumn("b", F.shiftright(F.col("h") * F.lit(ranges), 31))
    rows = _spread(rows, range_rows)
    counts = rows.groupBy("src", "b", "sub").agg(F.count("*").alias("n"))
    counts = _before(counts, ["src"], "b", "sub").withColumn("all", F.sum("n").over(Window.partitionBy("src"))).drop("n")
    order = Window.partitionBy("src", "b", "sub").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("r", F.row_number().over(order)).join(counts, ["src", "b", "sub"])
    ranked = ranked.withColumn("at", (F.col("before") + F.col("r") - F.lit(0.5)) / F.col("all"))
    ranked = stored(ranked.select("doc_id", "size", "text_crc32", F.xxhash64(F.lit(seed), "src").alias("s"), "src", "at", F.floor(F.col("at") * ranges).alias("g")))
    cuts = _before(ranked.groupBy("g").agg(F.count("*").alias("n")), [], "g").drop("n")  # a row for each range
    order = Window.partitionBy("g").orderBy("at", "s", "src", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("r", F.row_number().over(order)).join(F.broadcast(cuts), "g")
    placed = placed.withColumn("p", F.col("before") + F.col("r") - 1).withColumn("shard", F.expr(f"p * {n_shards} div {max(total, 1)}"))
    first = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), (F.col("p") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
