import hashlib
import random
import re

from arrowfen.llm.decontam import contamination

from .conftest import messy_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc, text in docs:
        ws, hit, ids = words_of(text), set(), set()
        for item, passage in items:
            p = words_of(passage)
            n = min(13, len(p))
            for win in {tuple(p[i : i + n]) for i in range(len(p) - n + 1)} if p else ():
                for k in range(len(ws) - n + 1):
                    if tuple(ws[k : k + n]) == win:
                        hit |= set(range(k, k + n))
                        ids.add("" if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(ws), len(hit), len(ids), sha, len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return out


def fixture():
    pick = random.Random(8)
    vocab = [f"w{i}" for i in range(40)] + ["É", "naïve", "the", "x9", "İst", "K"]
    prose = lambda n: [pick.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(prose(pick.randrange(10, 40)))) for i in range(12)]
    items += [(20, "w1, W2"), (21, "w1, W2"), (21, None), (22, ""), (23, "?!"), (None, "naïve the X9 w5"), (3, items[4][1]), (24, "the " * 13), (25, "é w3")]
    docs = []
    for i in range(60):
        ws = prose(pick.randrange(0, 60))
        if i % 2:
            item = words_of(items[i % 12][1])
            a = pick.randrange(len(item))
            at = pick.randrange(len(ws) + 1)
            ws[at:at] = [w.upper() if w.isascii() else w for w in item[a : a + pick.randrange(9, 30)]]
        docs.append((i, pick.choice(["", "  ", "\x00--"]) + pick.choice([" ", ", ", "\n"]).join(ws) + pick.choice(["", "."])))
    docs += [(70, None), (71, ""), (72, "... !"), (None, "w1 w2"), (None, None), (73, "W1 w2"), (73, "W1 w2"), (73, "nothing"), (74, "the " * 30), (75, " ".join(prose(3000)) + " " + items[0][1])]
    return docs, items


def test_matches_brute_force_in_one_and_in_many_blocks(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "z", 1, 2) for i, t in docs], "doc_id long, text string, token string, pos int, n int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(brute(docs, items), key=key)
    for block_bytes in (1 << 20, 4000):
        got = [tuple(r) for r in contamination(d, b, block_bytes=block_bytes).drop("text_hash").collect()]
        assert sorted(got, key=key) == want


def test_messy_and_empty_tables(spark, messy, no_docs):
    items = spark.createDataFrame([(1, "alpha"), (2, "beta gamma")], "item_id long, text string")
    got = {r.doc_id: r for r in contamination(messy, items).collect()}
    for doc, n, hit, ids, _, bad in brute([(r[0], r[1]) for r in messy_rows() if r[0] in (5, 40, 201, 206, 207, 208)], [(1, "alpha"), (2, "beta gamma")]):
        assert (got[doc].n_words, got[doc].n_hit, got[doc].n_items, got[doc].contaminated) == (n, hit, ids, bad)
    assert contamination(no_docs, items).collect() == []
    assert not any(r.n_hit or r.contaminated for r in contamination(messy, items.where("false")).collect())
