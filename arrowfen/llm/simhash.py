"""SimHash fingerprints and exact near-duplicate groups by covering-code anchors.

The space of 64-bit fingerprints is covered by a code: two blocks of 23 bits
under the binary Golay code, two of 7 bits under the Hamming code, and 4 bits
that no anchor fixes. In each block a word has one nearest codeword, so every
fingerprint has one anchor within the covering radius. Two fingerprints at
distance 2r have a midpoint within r of both, and the midpoint's anchor lies
within the covering radius plus r of both. Each fingerprint is therefore
replicated to the anchors of all words within r of it - about 15 for r = 1 -
and compared per anchor. No link is lost.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import parts
from .components import components
from .scratch import stored

SEED = 42
SHINGLE = 3
#: An anchor with more fingerprints is linked through midpoints instead of by comparing pairs.
PAIRWISE = 64
#: (first bit, length, generator polynomial) of each block of the covering code.
BLOCKS = ((0, 23, 0b101011100011), (23, 23, 0b101011100011), (46, 7, 0b1011), (53, 7, 0b1011))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text; 0 if it has no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = ends[shingle - 1 :] or ends[-1:]
    hashes = [xxhash.xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, last)]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fp) for every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2):
            fps = np.fromiter((fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle, seed) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed(fps)], names=["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _leaders(n: int, generator: int) -> tuple[np.ndarray, int]:
    """For a perfect cyclic code: the error pattern of each syndrome, and the syndrome's bits."""
    check = generator.bit_length() - 1
    radius = {23: 3, 7: 1}[n]
    table = np.zeros(1 << check, np.uint64)
    for weight in range(1, radius + 1):
        for bits in combinations(range(n), weight):
            word = sum(1 << b for b in bits)
            table[_remainder(word, generator)] = word
    return table, check


def _remainder(word: int, generator: int) -> int:
    while word.bit_length() >= generator.bit_length():
        word ^= generator << (word.bit_length() - generator.bit_length())
    return word


class _Decoder:
    """Nearest codeword of each block, vectorised over fingerprints."""

    def __init__(self) -> None:
        self.blocks = []
        for first, n, generator in BLOCKS:
            leaders, _ = _leaders(n, generator)
            # remainders are linear: one table for each byte of the block
            parts = [np.array([_remainder((b << shift) & ((1 << n) - 1), generator) for b in range(256)], np.uint64) for shift in range(0, n, 8)]
            self.blocks.append((np.uint64(first), np.uint64((1 << n) - 1), leaders, parts))

    def anchor(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        for first, mask, leaders, parts in self.blocks:
            word = (x >> first) & mask
            rest = np.zeros_like(word)
            for k, table in enumerate(parts):
                rest ^= table[((word >> np.uint64(8 * k)) & np.uint64(255)).astype(np.intp)]
            out |= (word ^ leaders[rest.astype(np.intp)]) << first
        return out


def _masks(radius: int) -> np.ndarray:
    """All 64-bit words with at most ``radius`` ones."""
    return np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)], np.uint64)


def _replicas(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, masks = _Decoder(), _masks(radius)
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            step = max(1, (1 << 20) // len(masks))
            for k in range(0, len(every), step):
                fps = every[k : k + step]
                anchors = np.sort(decoder.anchor(fps[:, None] ^ masks[None, :]), axis=1)
                new = np.ones(anchors.shape, bool)
                new[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
                yield pa.RecordBatch.from_arrays([_signed(anchors[new]), _signed(np.repeat(fps, new.sum(axis=1)))], names=["anchor", "fp"])

    return run


def _midpoints(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks(radius)
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            step = max(1, (1 << 20) // len(masks))
            for k in range(0, len(every), step):
                fps = every[k : k + step]
                yield pa.RecordBatch.from_arrays([_signed((fps[:, None] ^ masks[None, :]).ravel()), _signed(np.repeat(fps, len(masks)))], names=["m", "fp"])

    return run


def _stars(threshold: int):
    """Links of one anchor's fingerprints, as stars: at most one for each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for group in batch.column(0).to_pylist():
                fps = np.array(sorted(group), np.int64)
                near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= threshold
                label = np.arange(len(fps))
                while True:
                    least = np.where(near, label[None, :], len(fps)).min(axis=1)
                    if (least == label).all():
                        break
                    label = least
                linked = label != np.arange(len(fps))
                us += fps[linked].tolist()
                vs += fps[label[linked]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints ``fp`` exactly as 'at most threshold bits apart' does.

    Threshold is even. The edges are stars, not all pairs. A popular anchor is
    linked through the words within threshold / 2 of its fingerprints: two
    fingerprints share such a word if and only if they are near, and at most
    2081 (for threshold 2: 65) fingerprints lie around one word. Repeated
    fingerprints count once, zero is one like any other; null ones link to
    nothing; an empty table gives no edges.
    """
    if threshold % 2 or not 0 <= threshold <= 4:
        raise ValueError("threshold must be 0, 2 or 4")
    radius = threshold // 2
    single = fps.select("fp").where("fp is not null").distinct()
    held = stored(single.mapInArrow(_replicas(radius), "anchor long, fp long"))
    sizes = stored(held.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    shared = held.join(sizes, "anchor")
    few = shared.where(F.col("n") <= PAIRWISE).groupBy("anchor").agg(F.collect_list("fp").alias("fps"))
    near = few.select("fps").mapInArrow(_stars(threshold), "u long, v long")
    many = shared.where(F.col("n") > PAIRWISE).select("fp").distinct()
    around = many.mapInArrow(_midpoints(radius), "m long, fp long").groupBy("m").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    hubs = around.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u <> v").select("u", "v")
    return near.union(hubs).distinct()


def near_duplicates(docs: DataFrame, threshold: int = 2, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fingerprint, component_id) for every row of ``docs`` (doc_id, text, ...).

    Texts are lower-cased in A-Z and cut into words at ASCII white space.
    ``fingerprint`` is 16 hex digits over the text's word shingles (a shorter
    text: its words). Rows whose fingerprints differ in at most ``threshold``
    bits are linked, and ``component_id`` is the least doc_id of the linked
    group. Texts count whole, however long. Null and empty texts have fingerprint zero and link like any other.
    A null doc_id is kept; it is the component's id only if all are null.
    Repeated rows stay. An empty table gives an empty table.
    """
    fps = stored(fingerprints(docs, shingle, seed))
    first = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(first, threshold))
    held = first.join(roots, first.fp == roots.u, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    held = stored(held)
    lowest = stored(held.groupBy("root").agg(F.min("least").alias("component_id")))
    of = stored(held.join(lowest, "root").select("fp", "component_id"))
    return fps.join(of, "fp").select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
