"""Latency averages, totals and size estimates over tables of samples and rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_step(average: int, n: int, x: int) -> int:
    """The next average of whole microseconds: the mean of the first five samples, then four parts old and one new."""
    return (average * n + x) // (n + 1) if n < 5 else (4 * average + x) // 5


#: Samples from which a key's average is folded from its last ones, about TAIL; keys that are broadcast at most.
HOT, TAIL, MOST_KEYS = 100_000, 2_000, 1_000_000


def _folded(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """(by, n, low, high): each key's averages folded from its bounds ``_low`` and ``_high`` after ``_before`` samples; two numbers are kept."""
    kind = rows.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, low, high, started, out = None, 0, 0, 0, False, []
        for batch in batches:
            for k, x, before, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or k != key:
                    if started:
                        out.append((key, n, low, high))
                    key, n, low, high, started = k, before, first, last, True
                low, high, n = average_step(low, n, x), average_step(high, n, x), n + 1
        if started:
            out.append((key, n, low, high))
        columns = zip(*out) if out else ((), (), (), ())
        types = [pa.string() if kind == "string" else pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[by, "n", "low", "high"])

    dealt = rows.repartition(by).sortWithinPartitions(by, *order)
    return dealt.select(by, value, "_before", "_low", "_high").mapInArrow(run, f"{by} {kind}, n bigint, low bigint, high bigint")


def latency_average(samples: DataFrame, by: str, order: list[str], value: str, hot: int = HOT, tail: int = TAIL) -> DataFrame:
    """(by, n, average) of samples in order.

    Of a key with more than ``hot`` samples only the last ones are folded,
    once from the least and once from the greatest average that the others can
    have left: each step brings the two nearer, and where they meet the others
    don't matter. Where they don't, the key is folded whole. The first column
    of ``order`` is a number or a time; null values don't count.
    """
    rows = samples.where(F.col(value).isNotNull()).select(by, *order, F.col(value).cast("long").alias("_x"))
    whole = lambda some: some.select("*", *[F.lit(0).cast("bigint").alias(c) for c in ("_before", "_low", "_high")])
    counts = rows.groupBy(by).agg(F.count("*").alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most")).where((F.col("_n") > hot) & F.col(by).isNotNull())
    large = counts.limit(MOST_KEYS + 1).collect()
    if not large or len(large) > MOST_KEYS:
        return _folded(whole(rows), by, order, "_x").select(by, "n", F.col("low").alias("average"))
    keys = F.broadcast(rows.sparkSession.createDataFrame(large, counts.schema))
    own = rows.join(keys, by)
    cut = own.groupBy(by).agg(F.percentile_approx(order[0], F.array(*[F.lit(1 - tail / (4**k * hot)) for k in range(8)]), 100_000).alias("_cuts"))
    # of the cuts the one that leaves about ``tail`` samples of a key of this size
    place = F.greatest(F.lit(0), F.least(F.lit(7), F.floor(F.log2(F.col("_n") / hot) / 2).cast("int")))
    cuts = F.broadcast(cut.join(keys, by).select(by, F.get("_cuts", place).alias("_cut")))
    late = own.join(cuts, by).where(F.col(order[0]) >= F.col("_cut"))
    kept = F.broadcast(late.groupBy(by).agg(F.count("*").alias("_kept")))
    late = late.join(kept, by).select(by, *order, "_x", (F.col("_n") - F.col("_kept")).alias("_before"), F.col("_least").alias("_low"), F.col("_most").alias("_high"))
    ends = _folded(late, by, order, "_x").collect()  # a row for each large key
    met = [r for r in ends if r.low == r.high]
    done = rows.sparkSession.createDataFrame([(r[by], r.n, r.low) for r in met], f"{by} {rows.schema[by].dataType.simpleString()}, n bigint, average bigint")
    rest = rows.join(F.broadcast(done.select(by)), by, "left_anti")
    return _folded(whole(rest), by, order, "_x").select(by, "n", F.col("low").alias("average")).unionByName(done)


def embedding_totals(calls: DataFrame, *by: str) -> DataFrame:
    """requests, texts, tokens and mean milliseconds of calls (texts, tokens, nanoseconds); null without requests."""
    return calls.groupBy(*by).agg(
        F.count("*").alias("requests"), F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.try_divide(F.sum("nanoseconds"), F.count("*") * F.lit(1e6)).alias("mean_ms"),
    )


def vector_bytes(vector: str = "vector") -> Column:
    """What a cached vector takes: its id and four bytes for each component; null without one, whatever the session's ANSI mode."""
    return 16 + 4 * F.array_size(vector)


def newest_kept(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The last inserted ``most`` rows, which a first-in-first-out cache holds."""
    return rows.orderBy(F.col(order).desc()).limit(most)


def evicted(collections: DataFrame, name: str, size: str, budget: int) -> DataFrame:
    """(name, size, evict): which collections' metadata go, largest first, until the rest fits the budget."""
    order = Window.orderBy(F.col(size).desc(), name).rowsBetween(Window.unboundedPreceding, -1)  # a row for each collection
    total = F.sum(size).over(Window.partitionBy())
    before = F.coalesce(F.sum(size).over(order), F.lit(0))
    return collections.select(name, size, (total - before > budget).alias("evict"))
