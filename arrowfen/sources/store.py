"""Collections on disk: numbered commits, Parquet snapshots, a change log between them, and a catalogue.

A collection is what its commits say. Commit N is the file ``commits/N.json``,
made by exclusive creation: of writers that want the same number one gets it
and the others take the next. A commit names the batch of log lines that it
adds, or the snapshot that it makes and the number up to which that holds.
Batches and snapshots are new folders that nobody reads before their commit, so
readers never see half a write, and a writer that dies leaves nothing behind
but a folder that ``vacuum`` removes.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections import defaultdict
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AppConfig
from ..errors import InvalidRequestError, NotFoundError, StorageError
from ..operators.mutate import checked, limit_violations, row_bytes
from .shared import filesystem, hadoop_path, read_text, write_new
from .wal import last_entries, parsed, replayed, write_wal

ROW = "id string, vector array<float>, text string, metadata string"
NAME = re.compile(r"[\w-]{1,255}\Z")
#: The version of the folder's layout; another one isn't read.
VERSION = 2
_LOCKS: dict[str, threading.RLock] = defaultdict(threading.RLock)


@dataclass(frozen=True)
class Record:
    """What is known of a collection without reading its rows."""

    name: str
    version: int
    created_at: int
    updated_at: int
    dimensions: int | None
    seq: int
    snapshot: str | None
    snapshot_seq: int
    snapshot_at: int
    batches: tuple[tuple[str, int], ...]


@dataclass
class Collection:
    """One named collection below ``root``."""

    spark: SparkSession
    root: str
    name: str
    config: AppConfig = AppConfig()

    def __post_init__(self) -> None:
        if not NAME.match(self.name) or len(self.name.encode()) > 255:
            raise InvalidRequestError(f"bad collection name {self.name!r}")
        self.path = f"{self.root.rstrip('/')}/{self.name}"
        self.fs = filesystem(self.spark, self.path)
        self.lock = _LOCKS[self.path]  # writers of one process take turns; those of others meet at the commit

    def _at(self, *parts: str):
        return hadoop_path(self.spark, "/".join([self.path, *parts]))

    def _listed(self, folder: str) -> list:
        return list(self.fs.listStatus(self._at(folder))) if self.fs.exists(self._at(folder)) else []

    def exists(self) -> bool:
        return self.fs.exists(self._at("commits"))

    def create(self) -> Collection:
        """Makes the collection unless it is there."""
        if not self.exists():
            write_new(self.spark, f"{self.path}/commits/{1:012d}.json", json.dumps({"type": "Create", "version": VERSION, "at": int(time.time())}))
        return self

    def drop(self) -> bool:
        with self.lock:
            return self.fs.delete(self._at(), True)

    def commits(self) -> list[dict]:
        """All commits that are still there, by number."""
        if not self.exists():
            raise NotFoundError(self.name)
        found = []
        for status in self._listed("commits"):
            m = re.fullmatch(r"(\d+)\.json", status.getPath().getName())
            if m and status.getLen():
                try:
                    found.append({**json.loads(read_text(self.spark, f"{self.path}/commits/{m[0]}")), "seq": int(m[1])})
                except ValueError as e:
                    raise StorageError(f"{self.name}: commit {m[1]} is corrupt") from e
        return sorted(found, key=lambda c: c["seq"])

    def record(self) -> Record:
        every = self.commits()
        if not every:
            raise StorageError(f"{self.name} has no commit")
        version = next((c["version"] for c in every if "version" in c), None)
        if version != VERSION:
            raise StorageError(f"{self.name} has version {version}, not {VERSION}")
        last = max((c for c in every if c["type"] == "Checkpoint"), key=lambda c: (c["upto"], c["seq"]), default=None)
        upto = last["upto"] if last else 0
        dimensions = next((c["dimensions"] for c in ([last] if last else []) + every if c.get("dimensions")), None)
        created = next((c["created_at"] for c in every if "created_at" in c), every[0]["at"])
        batches = tuple((c["batch"], c["seq"]) for c in every if c["type"] == "Batch" and c["seq"] > upto)
        at = last["at"] if last else created
        return Record(self.name, version, created, every[-1]["at"], dimensions, every[-1]["seq"], last and last["snapshot"], upto, at, batches)

    def _commit(self, entry: dict, at: int | None = None) -> int:
        """The number that the entry got."""
        seq = self.record().seq + 1
        while True:
            if write_new(self.spark, f"{self.path}/commits/{seq:012d}.json", json.dumps({**entry, "at": int(time.time())})):
                return seq
            known = self.record()
            if entry.get("dimensions") and known.dimensions and known.dimensions != entry["dimensions"]:
                raise InvalidRequestError(f"the collection has {known.dimensions} dimensions")
            seq = max(seq, known.seq) + 1

    def log(self, known: Record | None = None) -> DataFrame:
        """Entries of the committed batches after the snapshot; ``seq`` is their commit's number."""
        known = known or self.record()
        if not known.batches:
            return parsed(self.spark.createDataFrame([], "value string"))
        numbers = self.spark.createDataFrame(list(known.batches), "batch string, seq long")
        lines = self.spark.read.option("basePath", f"{self.path}/wal").text([f"{self.path}/wal/batch={b}" for b, _ in known.batches])
        return parsed(lines, "batch").drop("seq").join(F.broadcast(numbers), "batch").drop("batch")

    def _rows(self, known: Record) -> DataFrame:
        if known.snapshot is None:
            base = self.spark.createDataFrame([], ROW)
        elif not self.fs.exists(self._at("snapshots", known.snapshot, "_SUCCESS")):
            raise StorageError(f"{self.name}: snapshot {known.snapshot} isn't complete")
        else:
            base = self.spark.read.schema(ROW).parquet(f"{self.path}/snapshots/{known.snapshot}")
        return replayed(self.log(known), base) if known.batches else base

    def rows(self) -> DataFrame:
        """The collection: its newest snapshot and the log after it."""
        return self._rows(self.record())

    def last_seq(self) -> int:
        return self.record().seq

    def dimensions(self) -> int | None:
        """The dimensions of the first vector ever written; they stay."""
        return self.record().dimensions

    def _append(self, entries: DataFrame, **more) -> int:
        """Logs entries of distinct ids as one batch; how many there were. Nothing is committed if one of them is invalid."""
        batch = uuid.uuid4().hex
        path = f"{self.path}/wal/batch={batch}"
        write_wal(entries, path, "errorifexists")
        n = self.spark.read.text(path).count()
        if n:
            self._commit({"type": "Batch", "batch": batch, "n": n, **more})
            known = self.record()
            timed = self.config.checkpoint_seconds is not None and time.time() - known.snapshot_at >= self.config.checkpoint_seconds
            if timed or known.seq - known.snapshot_seq > self.config.checkpoint_every:
                self.checkpoint()
        return n

    def upsert(self, new: DataFrame) -> None:
        """Rows (id, vector, text, metadata) added or replaced; nothing is logged if any is invalid or a limit breaks."""
        with self.lock:
            known = self.record()
            first = None if known.dimensions else new.select(F.size("vector")).first()
            dimensions = known.dimensions or (first[0] if first else None)
            new = checked(new.select("id", "vector", "text", "metadata"), dimensions)
            if known.seq > 1 or self.config.limits != type(self.config.limits)():
                rows = self._rows(known)
                broken = limit_violations(rows, new, self.config.limits).collect() if self.config.limits != type(self.config.limits)() else []
                if broken:
                    raise InvalidRequestError(f"limits exceeded: {[tuple(r) for r in broken]}")
                there = rows.select("id").withColumn("_there", F.lit(True))
            else:
                there = self.spark.createDataFrame([], "id string, _there boolean")
            kind = F.when(F.col("_there"), "Update").otherwise("Insert")
            self._append(new.dropDuplicates(["id"]).join(there, "id", "left").withColumn("type", kind).drop("_there"), dimensions=dimensions)

    insert = upsert

    def update(self, changes: DataFrame, column: str) -> int:
        """Replaces ``column`` (vector, text or metadata) of the rows that ``changes`` (id, column) lists; how many there were."""
        with self.lock:
            known = self.record()
            if column == "vector":
                changes = checked(changes, known.dimensions)
            new = changes.select("id", F.col(column).alias("_new")).dropDuplicates(["id"])
            found = self._rows(known).join(new, "id").withColumn(column, F.col("_new")).select("id", "vector", "text", "metadata")
            return self._append(found.withColumn("type", F.lit("Update")))

    def delete(self, ids: DataFrame) -> int:
        """How many rows went."""
        with self.lock:
            found = self.rows().select("id").join(ids.select("id").distinct(), "id", "left_semi")
            return self._append(found.withColumn("type", F.lit("Delete")))

    def checkpoint(self, files: int | None = None) -> int:
        """A snapshot of all commits so far; its commit's number. Later ones stay in the log."""
        known = self.record()  # the number first: rows of later commits aren't in it
        name = uuid.uuid4().hex
        rows = self._rows(known)
        (rows.coalesce(files) if files else rows).write.parquet(f"{self.path}/snapshots/{name}")
        entry = {"type": "Checkpoint", "snapshot": name, "upto": known.seq, "dimensions": known.dimensions, "version": VERSION, "created_at": known.created_at}
        return self._commit(entry)

    def vacuum(self, older_than: int | None = None) -> int:
        """Removes batches, snapshots and commits that the collection no longer needs and that are older than so many seconds; how many."""
        known = self.record()
        before = 1000 * (time.time() - (self.config.retain_seconds if older_than is None else older_than))
        checkpoints = [c["seq"] for c in self.commits() if c["type"] == "Checkpoint" and c["snapshot"] == known.snapshot]
        index = self.index_commit() or {"index": None, "seq": 0}
        needed = {f"batch={b}" for b, _ in known.batches} | {known.snapshot, index["index"]} | {f"{c:012d}.json" for c in [*checkpoints, index["seq"]]}
        gone = 0
        for folder in ("wal", "snapshots", "indexes", "commits"):
            for status in self._listed(folder):
                name = status.getPath().getName()
                number = re.fullmatch(r"(\d+)\.json", name)
                if name in needed or status.getModificationTime() > before or folder == "commits" and (not number or int(number[1]) > known.snapshot_seq):
                    continue
                gone += bool(self.fs.delete(status.getPath(), True))
        return gone

    def index_commit(self) -> dict | None:
        """The commit of the newest index: its folder, kind, metric, and the number up to which it holds."""
        return max((c for c in self.commits() if c["type"] == "Index"), key=lambda c: (c["upto"], c["seq"]), default=None)

    def changes_since(self, seq: int) -> DataFrame | None:
        """(id, e): the last entry of each row that changed after commit ``seq``; None if some commits are gone."""
        later = [c for c in self.commits() if c["seq"] > seq]
        if [c["seq"] for c in later] != list(range(seq + 1, seq + 1 + len(later))):
            return None
        batches = tuple((c["batch"], c["seq"]) for c in later if c["type"] == "Batch")
        if any(not self.fs.exists(self._at("wal", f"batch={b}")) for b, _ in batches):
            return None
        return last_entries(self.log(replace(self.record(), batches=batches)))

    def compact(self) -> dict:
        """A fresh snapshot in few files, and ``vacuum``; log entries that come meanwhile stay."""
        known = self.record()
        raw = (self.spark.read.schema(ROW).parquet(f"{self.path}/snapshots/{known.snapshot}").count() if known.snapshot else 0) + self.log(known).count()
        size = self.fs.getContentSummary(self._at()).getLength()
        seq = self.checkpoint(max(1, -(-size // (128 << 20))))
        gone = self.vacuum()
        return {"raw": raw, "live": self.rows().count(), "version": seq, "removed": gone}

    def used_bytes(self) -> int:
        """Bytes of all files below the collection, old ones included."""
        return self.fs.getContentSummary(self._at()).getLength()

    def log_bytes(self) -> int:
        """Bytes of the log since the snapshot."""
        return sum(self.fs.getContentSummary(self._at("wal", f"batch={b}")).getLength() for b, _ in self.record().batches)

    def info(self) -> DataFrame:
        known = self.record()
        size = F.coalesce(F.sum(row_bytes()), F.lit(0)).alias("bytes")
        own = [F.lit(known.dimensions).cast("int").alias("dimensions"), F.lit(known.created_at).alias("created_at"), F.lit(known.updated_at).alias("updated_at")]
        return self._rows(known).agg(F.lit(self.name).alias("name"), F.count("*").alias("count"), *own[:1], size, *own[1:])


class Catalogue:
    """All collections below a root, loaded or not."""

    def __init__(self, spark: SparkSession, root: str, config: AppConfig = AppConfig()) -> None:
        self.spark, self.root, self.config = spark, root, config

    def get(self, name: str) -> Collection:
        """An existing collection; reading never creates one."""
        found = Collection(self.spark, self.root, name, self.config)
        if not found.exists():
            raise NotFoundError(name)
        return found

    def get_or_create(self, name: str) -> Collection:
        return Collection(self.spark, self.root, name, self.config).create()

    def names(self) -> list[str]:
        fs, path = filesystem(self.spark, self.root), hadoop_path(self.spark, self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def health(self) -> list[dict]:
        out = []
        for name in self.names():
            try:
                own = self.get(name)
                out.append({"name": name, "ok": True, "count": own.rows().count(), "log_bytes": own.log_bytes()})
            except Exception as e:  # noqa: BLE001  the report names what fails
                out.append({"name": name, "ok": False, "error": str(e)})
        return out
