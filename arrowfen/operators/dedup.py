"""Near-duplicate pairs of vectors.

Few rows are compared in pairs of blocks. Of many, each row has a home, the
nearest of some pivots, and visits the other homes that can hold a row within
the threshold: by the triangle inequality those whose pivot is no farther than
the home's radius plus the threshold's distance. So a pair that far apart is
never compared and none that is nearer is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import metric_name
from .kernel import best, matrix, scores
from .knn import _id_type

#: Rows of a block, about; each task multiplies two blocks.
BLOCK_ROWS = 2000
#: Rows from which pivots are used, and components of all pivots at most.
PIVOT_ROWS, PIVOT_CELLS = 20_000, 4_000_000
#: What rounding may add to a distance.
SLACK = 1e-6


def _grid(base: DataFrame, n: int, id: str, vector: str, block_rows: int, least_blocks: int) -> DataFrame:
    """Each of n rows once for every pair of blocks that its own block is in."""
    blocks = max(least_blocks, -(-n // block_rows))
    rows = base.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    own = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    other = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return other.select("id", "vector", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))


def _split(key: tuple, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    i, j = (x.as_py() for x in key)
    ids = np.array(table.column("id").to_pylist(), object if pa.types.is_string(table.schema.field("id").type) else None)
    vectors, own = matrix(table.column("vector")), table.column("b").to_numpy()
    return ids[own == i], vectors[own == i], ids[own == j], vectors[own == j]


def _distances(rows: np.ndarray, pivots: np.ndarray, metric: str) -> np.ndarray:
    """Angles for the cosine, else Euclidean distances."""
    value = scores(rows, pivots, metric)
    return np.arccos(np.clip(value, -1, 1)) if metric == "cosine" else 1 / value - 1


def _pivots(base: DataFrame, n: int, id: str, vector: str) -> np.ndarray:
    """The vectors of about the root of n rows, drawn by a hash of their ids."""
    rows = base.where(F.col(vector).isNotNull())
    first = rows.select(F.size(vector)).first()
    most = max(1, min(int(n**0.5), PIVOT_CELLS // max(1, first[0] if first else 1)))
    return np.array([r[0] for r in rows.orderBy(F.xxhash64(id), id).limit(most).select(vector).collect()], np.float64)


def _going(vectors: np.ndarray, pivots: np.ndarray, radius: np.ndarray, reach: float, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The home of each row, and flags of the later homes that it visits."""
    far = _distances(vectors, pivots, metric)
    home = far.argmin(axis=1)
    return home, (far <= radius[None, :] + reach + SLACK) & (np.arange(len(pivots))[None, :] > home[:, None])


def _meeting(rows: DataFrame, pivots: np.ndarray, reach: float, metric: str, kind: str, block_rows: int) -> DataFrame:
    """(id, vector, at, i, j, side): each row for every task that compares it.

    Residents of a home meet each other in pairs of blocks i <= j. Its guests
    are in blocks too, whose number is -1 - j: they meet each block of residents.
    """

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = _distances(matrix(batch.column(1)), pivots, metric)
                yield pa.RecordBatch.from_arrays([pa.array(far.argmin(axis=1), pa.int64()), pa.array(far.min(axis=1), pa.float64())], names=["home", "far"])

    radius, residents, guests = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
    for r in rows.mapInArrow(homes, "home bigint, far double").groupBy("home").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect():  # a row for each pivot
        radius[r.home], residents[r.home] = r.radius, r.n

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivots), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += _going(matrix(batch.column(1)), pivots, radius, reach, metric)[1].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots)), pa.int64()), pa.array(total, pa.int64())], names=["at", "n"])

    for r in rows.mapInArrow(counts, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        guests[r["at"]] = r.n
    own_blocks, guest_blocks = -(-residents // block_rows), -(-guests // block_rows)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home, going = _going(matrix(batch.column(1)), pivots, radius, reach, metric)
                going[np.arange(len(home)), home] = True
                row, at = np.nonzero(going)
                resident = at == home[row]
                columns = [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(at, pa.int64()), pa.array(own_blocks[at], pa.int64()), pa.array(guest_blocks[at], pa.int64()), pa.array(resident)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "at", "m", "g", "resident"])

    vectors = rows.schema["vector"].dataType.simpleString()
    each = rows.mapInArrow(visits, f"id {kind}, vector {vectors}, at bigint, m bigint, g bigint, resident boolean").withColumn("b", F.pmod(F.xxhash64("id"), F.when(F.col("resident"), F.col("m")).otherwise(F.col("g"))))
    numbers = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    among = F.transform(numbers("m"), lambda o: F.struct(F.least("b", o).alias("i"), F.greatest("b", o).alias("j")))
    hosts = F.when(F.col("g") > 0, F.transform(numbers("g"), lambda g: F.struct(F.col("b").alias("i"), (-1 - g).alias("j")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>"))
    visiting = F.transform(numbers("m"), lambda o: F.struct(o.alias("i"), (-1 - F.col("b")).alias("j")))
    tasks = F.when(F.col("resident"), F.concat(among, hosts)).otherwise(visiting)
    side = F.when(F.col("resident"), F.col("b")).otherwise(-1 - F.col("b")).alias("side")
    return each.select("id", "vector", "at", side, F.explode(tasks).alias("t")).select("id", "vector", "at", "t.i", "t.j", "side")


def _meet(base: DataFrame, threshold: float, metric: str, id: str, vector: str, block_rows: int, n: int) -> DataFrame:
    kind = _id_type(base, id)
    reach = float(np.arccos(np.clip(threshold, -1, 1))) if metric == "cosine" else 1 / threshold - 1

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        ids = np.array(table.column("id").to_pylist(), object if kind == "string" else None)
        vectors, side = matrix(table.column("vector")), table.column("side").to_numpy()
        x, y = np.flatnonzero(side == i), np.flatnonzero(side == j)
        value = scores(vectors[x], vectors[y], metric)
        p, q = np.nonzero(value >= threshold)
        left, right, worth = ids[x[p]], ids[y[q]], value[p, q]
        if i == j:
            keep = left < right
            left, right, worth = left[keep], right[keep], worth[keep]
        swap = left > right
        to = pa.string() if kind == "string" else pa.int64()
        return pa.table({"id_a": pa.array(np.where(swap, right, left).tolist(), to), "id_b": pa.array(np.where(swap, left, right).tolist(), to), "score": pa.array(worth, pa.float64())})

    pivots = _pivots(base, n, id, vector)
    if not len(pivots):
        return base.sparkSession.createDataFrame([], f"id_a {kind}, id_b {kind}, score double")
    rows = base.where(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    return _meeting(rows, pivots, reach, metric, kind, block_rows).groupBy("at", "i", "j").applyInArrow(run, f"id_a {kind}, id_b {kind}, score double")


def pairs_above(base: DataFrame, threshold: float = 0.95, metric: str | None = None, id: str = "id", vector: str = "vector", block_rows: int = BLOCK_ROWS, blocks: int = 4, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """(id_a, id_b, score), id_a < id_b: all pairs that score ``threshold`` or more.

    Rows are dealt into blocks by hash and every pair of blocks is one product;
    from ``pivot_rows`` rows on, only rows that may be near by their pivots
    meet. Only pairs over the threshold leave a task. Products of vectors obey
    no triangle inequality and zero vectors have no angle: the dot product
    compares all pairs, and so does a threshold of zero or less.
    """
    name, kind = metric_name(metric), _id_type(base, id)
    n = base.count()
    if name != "dot" and threshold > 0 and n >= pivot_rows:
        return _meet(base, threshold, name, id, vector, block_rows, n)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, va, b, vb = _split(key, table)
        every = scores(va, vb, name)
        x, y = np.nonzero(every >= threshold)
        worth = every[x, y]
        keep = a[x] < b[y] if key[0] == key[1] else np.ones(len(x), bool)
        left, right = a[x][keep], b[y][keep]
        swap = left > right
        low, high = np.where(swap, right, left), np.where(swap, left, right)
        to = pa.string() if kind == "string" else pa.int64()
        return pa.table({"id_a": pa.array(low.tolist(), to), "id_b": pa.array(high.tolist(), to), "score": worth[keep]})

    return _grid(base, n, id, vector, block_rows, blocks).groupBy("i", "j").applyInArrow(run, f"id_a {kind}, id_b {kind}, score double")


def neighbour_count(n: int, k: int | None = None, limit: int | None = None) -> int:
    """Neighbours that the bounded search looks at: k, else twice the limit (10 at least), else 49; 1 to n - 1."""
    wanted = k if k is not None else max(2 * limit, 10) if limit is not None else 49
    return max(1, min(wanted, n - 1))


def pairs_of_neighbours(base: DataFrame, threshold: float = 0.95, metric: str | None = None, k: int | None = None, limit: int | None = None, id: str = "id", vector: str = "vector", block_rows: int = BLOCK_ROWS, blocks: int = 4) -> DataFrame:
    """(id_a, id_b, score) of pairs over ``threshold`` of which either lists the other among its nearest.

    A row counts among its own nearest. With ``limit``, the best pairs only.
    """
    name, kind, n = metric_name(metric), _id_type(base, id), base.count()
    most = neighbour_count(n, k, limit)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, va, b, vb = _split(key, table)
        worth = scores(va, vb, name)
        out: list[tuple] = []
        for own, other, values in ((a, b, worth), *([(b, a, worth.T)] if key[0] != key[1] else [])):
            for r in range(len(own)):
                out += [(own[r], other[c], values[r, c]) for c in best(other, values[r], most)]
        to = pa.string() if kind == "string" else pa.int64()
        x, y, s = zip(*out) if out else ((), (), ())
        return pa.table({"id": pa.array(list(x), to), "other": pa.array(list(y), to), "score": pa.array(list(s), pa.float64())})

    near = _grid(base, n, id, vector, block_rows, blocks).groupBy("i", "j").applyInArrow(run, f"id {kind}, other {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "other"))
    kept = near.withColumn("r", rank).where((F.col("r") <= most) & (F.col("id") != F.col("other")) & (F.col("score") >= threshold))
    pairs = kept.groupBy(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).agg(F.max("score").alias("score"))
    return pairs if limit is None else pairs.orderBy(F.col("score").desc(), "id_a", "id_b").limit(limit)
