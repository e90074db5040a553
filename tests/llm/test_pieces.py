import random
from collections import Counter

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from arrowfen.llm.pieces import MODEL, Pieces, decoded, encoded

from .conftest import messy_rows


@pytest.fixture(scope="module")
def model():
    with open(MODEL, "rb") as f:
        return f.read()


def as_unigram(model):
    """The same pieces as a unigram model, so that the library's own Viterbi can be compared."""
    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = 1
    for k, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = -5.0 - (k * 7919 % 32000) / 3000 - len(p.piece) * 1e-4
    return proto.SerializeToString()


def texts():
    pick = random.Random(6)
    parts = ["the", "inter", "nation", "al", "ization", "Übung", "é", "日本", "\U0001f600", " ", "  ", "\n", "\t", "42", ".", "'s", "▁", "x" * 20, "́", "http://"]
    made = ["".join(pick.choice(parts) for _ in range(pick.randrange(1, 25))) for _ in range(600)]
    return made + ["", " ", "   ", "a", " a", "x" * 4000, " " * 100 + "b"] + [" " * k + "word" for k in range(1, 60)]


def test_ids_equal_the_librarys(model):
    ours, theirs = Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    made = texts()
    for text, ids in zip(made, ours.encode(made)):
        assert ids.tolist() == theirs.encode(text), text
        assert ours.decode(ids.tolist()) == theirs.decode(ids.tolist()) == text.replace("▁", " ")


def test_unigram_scores_equal_the_librarys(model):
    model = as_unigram(model)
    ours, theirs = Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text, ids in zip(texts(), ours.encode(texts())):
        want = theirs.encode(text)
        worth = lambda ids: sum(ours.score[i] for i in ids)
        assert ids.tolist() == want or abs(worth(ids) - worth(want)) < 1e-3, text


def test_shared_prefixes_change_nothing(model):
    pieces = Pieces(model)
    words = ["▁inter", "▁internal", "▁international", "▁internationalize", "▁into", "▁", "▁▁▁in", "in"]
    assert {w: pieces.merged(w) for w in words} == dict(pieces.walk(words))


def test_table_round_trip(spark, messy, no_docs):
    rows = encoded(messy)
    assert all(r.exact and r.n_pieces == len(r.ids) for r in rows.collect())
    assert Counter((r.doc_id, r.text) for r in decoded(rows).collect()) == Counter((x[0], x[1] or "") for x in messy_rows())
    assert encoded(no_docs).collect() == []
