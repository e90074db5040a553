import random
from collections import Counter

import sentencepiece

import corpus_pipeline
from arrowfen.llm.pieces import MODEL
from arrowfen.llm.pii import find, masked

from . import test_decontam, test_hostrules, test_simhash


def fixture():
    pick = random.Random(12)
    vocab = [f"word{i}" for i in range(400)]
    prose = lambda n: " ".join(pick.choice(vocab) for _ in range(n))
    items = [(i, prose(30)) for i in range(5)]
    rows = []
    for i in range(40):
        text = prose(pick.choice([20, 80, 300]))
        if i % 7 == 0:
            text += " " + items[i % 5][1]
        if i % 5 == 0:
            text += f" mail me{i}@mail.example.org or +1 (555) 555-01{i:02d}"
        rows.append((i, text))
    rows += [(100 + i, rows[2][1]) for i in range(3)] + [(3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, prose(90)), (200, None), (201, ""), (202, rows[8][1] + " word1"), (203, "a b c " * 40)]
    return [(i, t, "en", None if i == 6 else "s", 1) for i, t in rows], items


def brute(rows, items):
    keep = [r for r in rows if not test_hostrules.brute(r[1])[-1]]
    fps = [test_simhash.brute_fingerprint(r[1]) for r in keep]
    group = test_simhash.groups_of(set(fps), 2)
    best = {}
    for r, f in zip(keep, fps):
        g = group[f]
        if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = r
    keep = list(best.values())
    verdicts = [test_decontam.brute([(r[0], r[1])], items)[0][-1] for r in keep]
    keep = [r for r, bad in zip(keep, verdicts) if not bad]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return [(r[0], tuple(model.encode(masked(r[1], find(r[1]))))) for r in keep]


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, items = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter(brute(rows, items))


def test_stages_keep_the_columns_and_take_empty_and_messy_tables(spark, messy, no_docs, tmp_path):
    spark.createDataFrame([(1, "alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (messy, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.dtypes == docs.dtypes and out.count() <= docs.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
