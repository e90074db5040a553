"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, stored

#: A vertex that many edges share is dealt over so many tasks.
SALTS = 16


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Adds ``m``, the least of ``u`` and all its ``v``; a hot ``u`` is salted, one copy for each salt that its edges have."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    least = dealt.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("salt").alias("salts"))
    spread = least.select("u", F.least("u", "m").alias("m"), F.explode("salts").alias("salt"))
    return dealt.join(spread, ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    linked = _least_neighbour(down)
    own = linked.where("u <> m").select("u", F.col("m").alias("v"))
    rest = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(rest).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """For edges (u, v) of longs: (u, root), root being the least vertex that u reaches.

    Vertices that are their own root or have no edge aren't listed. Nulls,
    loops and repeated edges are ignored. Only a count and a checksum reach
    the driver; the number of rounds is logarithmic in the longest path.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        after = stored(_small_star(_large_star(now)))
        discard(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select("u", F.col("v").alias("root"))
