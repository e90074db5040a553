"""Change-log ingestion by Structured Streaming.

The state is dealt by a hash of the key into parts. A micro-batch rewrites the
parts that it touches and then writes a manifest, which names the folder of
each part; readers follow the newest manifest, so they never see half a batch.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import filesystem, hadoop_path, read_text, write_new
from ..sources.wal import last_entries, stream_wal

#: Parts of the state, and manifests that stay with their folders for slow readers.
PARTS, KEPT = 64, 3


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")


def merge_log(spark: SparkSession, log: str, state: str, checkpoint: str, available_now: bool = True, parts: int = PARTS):
    """Keeps the last entry of each id below ``state``; returns the started query.

    A micro-batch that is repeated after a failure writes the same again; one
    whose manifest is there has been done. ``parts`` stays what it was when the
    state was begun.
    """

    def merge(batch: DataFrame, number: int) -> None:
        done = _manifests(spark, state)
        if number in done:
            return
        held = json.loads(read_text(spark, f"{state}/manifests/{max(done)}.json")) if done else {"parts": parts, "folders": {}}
        n, folders = held["parts"], held["folders"]
        now = last_entries(batch.where("type in ('Insert', 'Update', 'Delete')")).select("id", "e.*").withColumn("part", _part(n))
        now = now.persist()  # read to find the touched parts and to merge them
        touched = [str(r.part) for r in now.select("part").distinct().collect()]  # at most PARTS numbers
        if touched:
            before = [f"{state}/batch={folders[p]}/part={p}" for p in touched if p in folders]
            merged = now
            if before:
                old = spark.read.schema(now.drop("part").schema).parquet(*before).withColumn("part", _part(n))
                merged = last_entries(old.unionByName(now).drop("part")).select("id", "e.*").withColumn("part", _part(n))
            merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{state}/batch={number}")
        now.unpersist()
        write_new(spark, f"{state}/manifests/{number}.json", json.dumps({"parts": n, "folders": {**folders, **dict.fromkeys(touched, number)}}))
        _retire(spark, state)

    writer = stream_wal(spark, log).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _numbers(spark: SparkSession, folder: str, pattern: str) -> list[int]:
    fs, path = filesystem(spark, folder), hadoop_path(spark, folder)
    found = [re.fullmatch(pattern, s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(m[1]) for m in found if m)


def _manifests(spark: SparkSession, state: str) -> list[int]:
    return _numbers(spark, f"{state}/manifests", r"(\d+)\.json")


def _retire(spark: SparkSession, state: str) -> None:
    """Removes what the last few manifests don't name."""
    done, fs = _manifests(spark, state), filesystem(spark, state)
    needed = {int(b) for k in done[-KEPT:] for b in json.loads(read_text(spark, f"{state}/manifests/{k}.json"))["folders"].values()}
    for b in _numbers(spark, state, r"batch=(\d+)"):
        if b not in needed and b < done[-1]:
            fs.delete(hadoop_path(spark, f"{state}/batch={b}"), True)
    for k in done[:-KEPT]:
        fs.delete(hadoop_path(spark, f"{state}/manifests/{k}.json"), False)


def merged_rows(spark: SparkSession, state: str) -> DataFrame:
    """The rows alive after the last micro-batch."""
    folders = json.loads(read_text(spark, f"{state}/manifests/{_manifests(spark, state)[-1]}.json"))["folders"]
    paths = [f"{state}/batch={b}/part={p}" for p, b in folders.items()]
    return spark.read.parquet(*paths).where("type <> 'Delete'")


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by key and tumbling window with a watermark; works on streams and tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
