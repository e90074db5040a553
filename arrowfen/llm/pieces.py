"""SentencePiece encoding by a forward pass over the trie of distinct words.

White space is marked and texts are cut into marked words, which pieces never
cross. The distinct words of some texts are sorted, which is a depth-first walk
of their trie: a word takes over the forward values of the prefix that it
shares with the word before and computes only the rest.

For a unigram model the forward value of a prefix is the score of its best
segmentation (Viterbi). The scores of a BPE model are merge ranks, whose sums
it doesn't maximise, so Viterbi over them gives other ids than the model's own.
There the forward value is the last piece of the prefix's own BPE encoding: of
the pieces that end the prefix it is the one that the encoding of the rest
tolerates, since a sequence of pieces is a BPE encoding if and only if each
pair of neighbours is. Either way each prefix is computed once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import parts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose encodings a worker remembers, and bytes of texts that it encodes at once.
REMEMBERED, CHUNK = 250_000, 1 << 20
#: Pairs of pieces of which a worker remembers whether they stay apart.
PAIRS = 1_000_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What an unknown character costs a unigram model beyond its lowest score.
PENALTY = 10.0


class Pieces:
    """A SentencePiece model with identity normalisation: UNIGRAM or BPE."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        how, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if kind not in (1, 2) or how.precompiled_charsmap or how.remove_extra_whitespaces or not how.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only unigram and BPE models with identity normalisation are supported")
        if any(p.type == USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined pieces are not supported")
        self.bpe, self.prefixed = kind == 2, how.add_dummy_prefix
        self.id = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = [p.score for p in proto.pieces]
        self.text = [p.piece for p in proto.pieces]
        self.bytes = {int(p.piece[3:-1], 16): k for k, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(k for k, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces must not cross words")
        if self.bpe and any(c not in self.id for p in self.id for c in p):
            raise ValueError("every character of a piece must be a piece")
        self.longest = max(map(len, self.id))
        self.lowest = min((self.score[k] for k in self.id.values()), default=0.0) - PENALTY
        raw = {UNKNOWN: lambda p: " ⁇ ".encode(), CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p.piece[3:-1], 16)])}
        self.out = [raw.get(p.type, lambda p: p.piece.replace(MARK, " ").encode())(p) for p in proto.pieces]
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.pairs: list[dict[int, bool]] = [{} for _ in self.text]
        self.n_pairs = 0
        self.known: dict[str, bytes] = {}
        self.code = [array("i", [k]).tobytes() for k in range(len(self.text))]
        self.standing = ahocorasick.Automaton()
        for p, k in self.id.items() if self.bpe else ():
            if self.merged(p) == self.code[k]:  # no other piece occurs in an encoding
                self.standing.add_word(p, (k, len(p)))
        self.standing.make_automaton()

    def merged(self, word: str) -> bytes:
        """BPE by its definition: join the best-ranked leftmost pair until none is a piece."""
        parts = list(word)
        while True:
            best, where = None, -1
            for k in range(len(parts) - 1):
                piece = self.id.get(parts[k] + parts[k + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, where = self.score[piece], k
            if best is None:
                return b"".join([self.code[self.id[p]] if p in self.id else self.fallback(p) for p in parts])
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def fallback(self, char: str) -> bytes:
        return b"".join([self.code[self.bytes[b]] for b in char.encode()]) if self.bytes else self.code[self.unknown]

    def _fits(self, left: int, right: int) -> bool:
        """Whether two pieces stay apart when their texts meet."""
        self.n_pairs += 1
        if self.n_pairs > PAIRS:
            self.n_pairs = 1
            for known in self.pairs:
                known.clear()
        ok = self.pairs[left][right] = self.merged(self.text[left] + self.text[right]) == self.code[left] + self.code[right]
        return ok

    def _best_pieces(self, word: str, first: int, last: list[int], back: list[int], best: list[float]) -> None:
        """Unigram: extends ``last``, ``back`` and ``best``, the score of the best segmentation of each prefix."""
        for end in range(first, len(word) + 1):
            top, piece, start = best[end - 1] + self.lowest, -1, end - 1
            for begin in range(max(0, end - self.longest), end):
                k = self.id.get(word[begin:end])
                if k is not None and (piece < 0 and begin == end - 1 or best[begin] + self.score[k] > top):
                    top, piece, start = best[begin] + self.score[k], k, begin
            last.append(piece)
            back.append(start)
            best.append(top)

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(word, its ids as 32-bit integers) of distinct words, in the order of their trie.

        ``last`` and ``back`` hold, for each prefix of the word at hand, the
        last piece of its encoding and where that begins. -1 is an unknown
        character, which keeps apart from all neighbours.
        """
        before, last, back, best = "", [-1], [0], [0.0]
        ending, pairs, code, bpe, longest = self.standing.iter, self.pairs, self.code, self.bpe, self.longest
        for word in sorted(words):
            size = len(word)
            if word.startswith(before):
                shared = len(before)
            else:
                shared = 0
                for a, b in zip(word, before):
                    if a != b:
                        break
                    shared += 1
            before = word
            if shared + 1 < len(last):
                del last[shared + 1 :], back[shared + 1 :]
            end = shared + 1
            if bpe:
                for at, (piece, chars) in ending(word, end - longest if end > longest else 0):
                    if at < shared:
                        continue
                    while end <= at:
                        last.append(-1)
                        back.append(end - 1)
                        end += 1
                    if end > at + 1:
                        continue
                    begin = end - chars
                    left = last[begin]
                    if left >= 0:
                        fits = pairs[left].get(piece)
                        if not (self._fits(left, piece) if fits is None else fits):
                            continue
                    last.append(piece)
                    back.append(begin)
                    end += 1
                while end <= size:
                    last.append(-1)
                    back.append(end - 1)
                    end += 1
            else:
                del best[shared + 1 :]
                self._best_pieces(word, end, last, back, best)
            parts = []
            while size:
                piece = last[size]
                parts.append(code[piece] if piece >= 0 else self.fallback(word[size - 1]))
                size = back[size]
            parts.reverse()
            yield word, b"".join(parts)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        return self.cut.findall((MARK if self.prefixed else "") + text.replace(" ", MARK))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.words(t) for t in texts]
        new = set().union(*cut) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*cut)
        self.known.update(self.walk(new))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, ws)), np.int32) for ws in cut]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        out = self.out
        text = b"".join(map(out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefixed and text.startswith(" ") else text


_LOADED: dict[int, Pieces] = {}


def _loaded(model: bytes) -> Pieces:
    """The model in this worker, with the words that it has met in earlier tasks."""
    if hash(model) not in _LOADED:
        _LOADED.clear()
        _LOADED[hash(model)] = Pieces(model)
    return _LOADED[hash(model)]


def encoded(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, ids, exact) for every row of ``docs`` (doc_id, text, ...).

    ``exact`` tells whether decoding the ids gives the text back; a mark
    U+2581 in the text reads back as a space, as in any such model. Null and
    empty texts have no pieces. Texts are encoded whole, however long. Null
    ids and repeated rows are rows like any other; an empty table gives an
    empty table. The driver reads the model and ships it to the workers.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model.value)
        for batch in parts(batches, 1, CHUNK):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = pieces.encode(texts)
            exact = [pieces.decode(i.tolist()) == t.replace(MARK, " ") for i, t in zip(ids, texts)]
            sizes = [len(i) for i in ids]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            flat = pa.array(np.concatenate(ids), pa.int32())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat), pa.array(exact)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "ids", "exact"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, exact boolean")


def decoded(rows: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) of a table (doc_id, ids, ...), the texts of ``encoded``'s ids.

    Null ids give null, no ids the empty text; ids whose bytes are no UTF-8
    give replacement characters. Texts are rebuilt one at a time, however
    long. Null doc_ids and repeated rows are rows like any other; an empty
    table gives an empty table.
    """
    with open(model_path, "rb") as f:
        model = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded(model.value)
        for batch in batches:
            texts = [pieces.decode(v.as_py()) if v.is_valid else None for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
