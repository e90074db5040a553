"""Rows of collections in memory, within a budget.

A cached collection is valid for the commit that it was read at: when another
commit has come the rows are read anew, so a cache never serves old rows. Over
budget the largest collections go first.
"""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mutate import row_bytes
from .store import Collection


@dataclass
class Held:
    seq: int
    rows: DataFrame
    n: int
    bytes: int


class RowCache:
    """Persisted rows by collection path: at most ``rows`` of a collection and ``bytes`` of all."""

    def __init__(self, rows: int = 10_000, bytes: int | None = None) -> None:
        self.most_rows, self.most_bytes = rows, bytes
        self.held: dict[str, Held] = {}
        self.lock = threading.RLock()

    def rows(self, c: Collection) -> DataFrame:
        """The collection's rows as they are now, from memory if they are there and still hold."""
        with self.lock:
            own = self.held.get(c.path)
            if own is None:
                return c.rows()
            if own.seq != c.last_seq():
                self.drop(c)
                return self.warm(c)
            return own.rows

    def warm(self, c: Collection) -> DataFrame:
        """Reads the collection into memory, if it fits the budget; its rows either way."""
        with self.lock:
            self.drop(c)
            known = c.record()
            rows = c._rows(known).persist(StorageLevel.MEMORY_AND_DISK)
            n, size = rows.agg(F.count("*"), F.coalesce(F.sum(row_bytes()), F.lit(0))).first()
            if n > self.most_rows or self.most_bytes is not None and size > self.most_bytes:
                rows.unpersist()
                return c._rows(known)
            self.held[c.path] = Held(known.seq, rows, n, size)
            while self.most_bytes is not None and sum(h.bytes for h in self.held.values()) > self.most_bytes:
                self._drop(max(self.held, key=lambda p: (self.held[p].bytes, p)))
            return rows

    def _drop(self, path: str) -> None:
        own = self.held.pop(path, None)
        if own is not None:
            own.rows.unpersist()

    def drop(self, c: Collection) -> None:
        with self.lock:
            self._drop(c.path)

    def sizes(self) -> dict[str, int]:
        return {path: h.bytes for path, h in self.held.items()}
