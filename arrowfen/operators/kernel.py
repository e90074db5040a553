"""Arrow and numpy pieces that the search operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..functions.distance import MISMATCH


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as a matrix of doubles; all lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError(MISMATCH)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, int(sizes[0]))


def scores(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Scores of each row with each query."""
    if rows.shape[1:] != queries.shape[1:] and len(rows) and len(queries):
        raise ValueError(MISMATCH)
    if not len(rows) or not len(queries):
        return np.zeros((len(rows), len(queries)))
    products = rows @ queries.T
    if metric == "dot":
        return products
    a, b = np.einsum("ij,ij->i", rows, rows), np.einsum("ij,ij->i", queries, queries)
    if metric == "cosine":
        both = np.sqrt(a)[:, None] * np.sqrt(b)[None, :]
        return np.divide(products, both, out=np.zeros_like(products), where=both > 0)
    return 1 / (1 + np.sqrt(np.maximum(a[:, None] + b[None, :] - 2 * products, 0)))


def best(ids: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest values, ties by ascending id; minus infinity never counts."""
    some = np.flatnonzero(values > -np.inf)
    if len(some) > k:
        cut = np.partition(values[some], len(some) - k)[len(some) - k]
        some = some[values[some] >= cut]
    return some[np.lexsort((ids[some], -values[some]))][:k]
