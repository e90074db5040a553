import random
import re
from collections import Counter

import numpy as np
import xxhash

from arrowfen.llm.components import components
from arrowfen.llm.simhash import _Decoder, _masks, links, near_duplicates

from .conftest import messy_rows


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(fps, threshold):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def test_matches_brute_force(messy):
    rows = [(r[0], brute_fingerprint(r[1])) for r in messy_rows()]
    group = groups_of({f for _, f in rows}, 2)
    least = {}
    for doc, f in rows:
        if doc is not None:
            least[group[f]] = min(doc, least.get(group[f], doc))
    want = Counter((doc, f"{f:016x}", least.get(group[f])) for doc, f in rows)
    got = Counter(tuple(r) for r in near_duplicates(messy).drop("text_hash").collect())
    assert got == want


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_every_near_pair_shares_an_anchor():
    pick = np.random.default_rng(3)
    decoder = _Decoder()
    x = pick.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + pick.integers(0, 2, 300, dtype=np.uint64)
    for radius in (1, 2):
        masks = _masks(radius)
        for f in x[:40]:
            bits = pick.choice(64, 2 * radius, replace=False)
            g = f ^ np.uint64(sum(1 << int(b) for b in bits))
            assert set(decoder.anchor(f ^ masks).tolist()) & set(decoder.anchor(g ^ masks).tolist())


def test_links_keep_connectivity_for_small_and_popular_anchors(spark):
    pick = random.Random(11)
    centre = pick.getrandbits(64)
    fps = {pick.getrandbits(64) for _ in range(50)} | {centre}
    for _ in range(250):  # far more than one anchor compares pairwise
        f = centre
        for _ in range(pick.randrange(1, 4)):
            f ^= 1 << pick.randrange(64)
        fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = {r.u: r.root for r in components(links(df, 2)).collect()}
    want = groups_of(fps, 2)
    parts = {}
    for f in fps:
        parts.setdefault(want[f], set()).add(roots.get(signed(f), signed(f)))
    assert all(len(p) == 1 for p in parts.values())
    assert len({next(iter(p)) for p in parts.values()}) == len(parts)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5), (1001, 1002), (1000, 1001)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.u: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + k: 1000 for k in range(1, 200)}
    assert components(df.where("false")).collect() == []
