"""Parts of Arrow batches, bounded by bytes.

Spark bounds the batches that it sends to Python by
``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB unless set). What Python
makes of a batch takes several times its bytes, so operators on texts work on
smaller parts of it, which share its memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts in a part; a longer text is a part of its own.
PART_BYTES = 4 << 20


def _sizes(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1 + column.offset)
    return np.diff(offsets[column.offset :])


def parts(batches: Iterable[pa.RecordBatch], column: int, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, cut where the texts of ``column`` (string or binary) exceed ``most`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_sizes(batch.column(column)), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(first, last - first)
            first = last
    pa.default_memory_pool().release_unused()  # the worker waits for its next task
