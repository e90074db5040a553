import random
import re
from collections import Counter

import pytest

from arrowfen.llm.hostrules import host_verdicts, judged, measured, without_failing

from .conftest import messy_rows


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    count = Counter(wins)
    inside = {j for i, w in enumerate(wins) if count[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(ws) < 50 or 100 * len(inside) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


def texts():
    pick = random.Random(2)
    out = ["a b c a b c", "a a a a a", "x\x0by\x0cz\rq\t1 2 3", "#*$ <b>&|%", "l1\nl1\n \n\nl2\nl1", "\U0001f600 é " * 30]
    for vocab in (2, 3, 5, 9, 40, 4000):
        out += [" ".join(f"w{pick.randrange(vocab)}" for _ in range(pick.randrange(1, 400))) for _ in range(8)]
    return out


def test_measures_match_brute_force(spark):
    rows = [(i, t, "s", 1, 2) for i, t in enumerate(texts())] + [(1000 + i, r[1], "s", 1, 2) for i, r in enumerate(messy_rows())]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host int, n_lines int")
    got = {r.doc_id: tuple(r)[1:] for r in judged(df, limit=1.0, multiple=1e9).collect()}
    for doc, text, *_ in rows:
        want = brute(text)
        assert got[doc] == (*want, not want[-1]), (doc, text[:80] if text else text)


def test_host_verdict_reaches_its_documents(spark):
    good = " ".join(f"g{i}" for i in range(60))
    rows = [(i, good + f" {i}", f"h{i % 5}") for i in range(500)]
    rows += [(1000 + i, "junk" if i % 20 else good, "farm") for i in range(200)] + [(2000, "junk", "tiny"), (2001, good, "tiny"), (2002, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in judged(df).collect()}
    assert not any(kept[1000 + i] for i in range(200))
    assert all(kept[i] for i in range(500)) and kept[2001] and kept[2002] and not kept[2000]


def test_messy_empty_and_repeated(messy, no_docs):
    rows = judged(messy).collect()
    assert Counter((r.doc_id, r.n_words, r.base_failed) for r in rows) == Counter((x[0], brute(x[1])[0], brute(x[1])[-1]) for x in messy_rows())
    assert judged(no_docs).collect() == []


def test_failing_rows_go(messy):
    left = without_failing(messy)
    assert left.columns == messy.columns
    assert Counter(map(tuple, left.collect())) == Counter(x for x in messy_rows() if not brute(x[1])[-1])


def test_suspect_hosts_lose_what_breaks_any_rule(spark):
    good, soft = " ".join(f"g{i}" for i in range(60)), " ".join(f"g{i}$$" for i in range(60))
    rows = [(100 * h + i, soft if i < (30 if h == 3 else 2) else f"{good} {i}", f"h{h}") for h in range(20) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = {r.doc_id for r in judged(df).where("not kept").collect()}
    assert gone == {300 + i for i in range(30)}  # elsewhere two documents with symbols stay
    assert {r.doc_id for r in df.collect()} - {r.doc_id for r in without_failing(df).collect()} == gone


def brute_verdicts(counts, limit, multiple):
    """(rejected, suspect) by host from {host: (n, failures)}."""
    total = sum(n for n, _ in counts.values())
    mean = sum(f for _, f in counts.values()) / total
    rates = [f / n for n, f in counts.values()]
    middle = sum(rates) / len(rates)
    spread = sum((r - middle) ** 2 for r in rates) / (len(rates) - 1) if len(rates) > 1 else 0
    chance = mean * (1 - mean) * sum(1 / n for n, _ in counts.values()) / len(counts)
    weight = min(max(mean * (1 - mean) / max(spread - chance, 1e-6) - 1, 1), 1000)
    out = {}
    for host, (n, f) in counts.items():
        p = (f + mean * weight) / (n + weight)
        sure = p - 2 * (p * (1 - p) / (n + weight + 1)) ** 0.5
        out[host] = sure > limit, sure > multiple * mean
    return out


def test_verdicts_match_brute_force(spark):
    pick = random.Random(8)
    counts = {f"v{k}": (n := pick.randrange(1, 300), pick.randrange(0, max(2, n // pick.choice([1, 3, 30, 30, 30, 30])))) for k in range(60)}
    rows = [(h, i < f) for h, (n, f) in counts.items() for i in range(n)]
    for limit, multiple in ((0.5, 1.5), (0.3, 1.2)):
        got = {r.host: r.rejected for r in host_verdicts(spark.createDataFrame(rows, "host string, rule_failed boolean"), limit, multiple=multiple).collect()}
        want = {h: bad for h, (bad, some) in brute_verdicts(counts, limit, multiple).items() if bad or some}
        assert got == want and 0 < sum(want.values()) < len(want) < 60


@pytest.mark.parametrize("rates", [(0.9,), (0.1, 0.1)])
def test_few_hosts_get_a_defined_prior(spark, rates):
    rows = [(f"v{k}", i < 100 * r) for k, r in enumerate(rates) for i in range(100)]
    df = spark.createDataFrame(rows, "host string, rule_failed boolean")
    assert [r.host for r in host_verdicts(df).where("rejected").collect()] == [f"v{k}" for k, r in enumerate(rates) if r > 0.5]
    assert host_verdicts(df.where("false")).collect() == []
    assert measured(df.selectExpr("'' as text"), "text").first().n_words == 0
