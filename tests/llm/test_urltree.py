import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from arrowfen.llm.urltree import BAD_WORDS, DEVIATIONS, LEAST, PURITY, RULES, STEPS, WEIGHT, filtered, page_label

SCHEMA = "page_id long, url string, html string, host string, n long, q double"


def split(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")


def rule_of(host, path):
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def segments(path):
    out = []
    for s in [p for p in path.split("/") if p]:
        m = re.match(r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", s)
        name = m[1]
        wild = re.search(r"^[0-9._-]*[0-9][0-9._-]*$", name) or re.search(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$", name) or re.search(r"^(?=.*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]{8,}$", name)
        out.append("*" + (m[2] or "") if wild else s)
    return tuple(out + ["$"])


def content(html):
    """What a page's own text says; the test's pages have no markup beyond plain tags."""
    if html is None:
        return None
    text = re.sub(r"<[^>]*>", " ", html)
    words, symbols = len(text.split()), len(re.findall(r"[#*$%|<>]", text))
    return True if words < 20 or 10 * symbols > len(text) else False if words >= 50 and 50 * symbols <= len(text) else None


def merged(branches):
    """Sets of segments of {segment: (n, b)}: bins of like shares, neighbours merged pair by pair."""
    bins = defaultdict(list)
    for seg, (n, b) in branches.items():
        bins[-1 if n < LEAST else STEPS * b // n].append(seg)
    sums = []
    for k, segs in bins.items():
        n, b = sum(branches[x][0] for x in segs), sum(branches[x][1] for x in segs)
        sums.append((b / n if n else 0.0, k, n, b, segs))
    out = []
    for _, _, n, b, segs in sorted(sums, key=lambda x: x[:4]):
        if out:
            on, ob, osegs = out[-1]
            p = (b + ob) / (n + on) if n + on else None
            if not (n and on and abs(ob / on - b / n) > DEVIATIONS * math.sqrt(p * (1 - p) * (1 / on + 1 / n))):
                out[-1] = (n + on, b + ob, osegs + segs)
                continue
        out.append((n, b, segs))
    return [set(segs) for _, _, segs in out]


def tally(kids):
    marks = [bad for _, _, bad in kids if bad is not None]
    return len(marks), sum(marks)


def grow(kids, q, verdict):
    """kids: (whole path, rest of it, label) of one node; q: its purity."""
    n, b = tally(kids)
    if n < 2 * LEAST or b in (0, n) or len({rest for _, rest, _ in kids}) == 1:
        for path, _, _ in kids:
            verdict[path] = q, n
        return
    by = defaultdict(list)
    for path, rest, bad in kids:
        by[rest[0] if rest else "$"].append((path, rest[1:], bad))
    groups = merged({seg: tally(some) for seg, some in by.items()}) if len(by) > 1 else [set(by)]
    for segs in groups:
        some = [k for seg in segs for k in by[seg]]
        n, b = tally(some)
        grow(some, (b + WEIGHT * q) / (n + WEIGHT) if len(groups) > 1 else q, verdict)


def brute(rows):
    seen = []
    for i, url, html, *_ in rows:
        host, path = split(url)
        rule = rule_of(host, path)
        bad = True if rule and rule[2] == "block" else True if re.search(r"(^|[.-])(" + "|".join(BAD_WORDS) + r")([.-]|$)", host) else False if rule else content(html)
        seen.append((i, host, path, rule, segments(path), bad))
    labelled = [bad for *_, bad in seen if bad is not None]
    prior = sum(labelled) / len(labelled) if labelled else 0.0
    hosts, out = defaultdict(list), Counter()
    for s in seen:
        hosts[s[1]].append(s)
    for host, some in hosts.items():
        kids = [(segs, segs, bad) for _, _, _, _, segs, bad in some]
        n, b = tally(kids)
        verdict = {}
        grow(kids, (b + WEIGHT * prior) / (n + WEIGHT), verdict)
        for i, h, p, r, segs, _ in some:
            q, m = verdict[segs]
            out[i, h, p, r and r[0] + r[1], r[2] if r else "block" if q >= PURITY and m >= LEAST else "allow", round(q, 9), m] += 1
    return out


PROSE, JUNK, SHORT, MIDDLE = "<p>" + "plain words in a row " * 12, "<p>" + "%% $$ ## " * 30, "<p>tiny", "<p>" + "some words here " * 12


def rows():
    pick = random.Random(3)
    out = []
    for i in range(2500):
        host = pick.choice(["A.example.ORG", "b.example.com", "casino-win.example.net", "x.org", "com", "org", "notorg", "c.example.net", "c.example.net", "d.example.net", "d.example.net", "d.com", "é.com:80"])
        parts = [pick.choice(["fr", "de", "en", "es", "12", "9f8e7d6c5b", "a.html", "77.html", "x1y2z3w4v5", "", "2024-01-02"]) for _ in range(pick.randrange(6))]
        bad = {"c.example.net": 0.9 if "de" in parts[:3] else 0.05, "d.example.net": 0.9 if parts[3:4] == ["es"] else 0.2}.get(host, 0.1)
        html = pick.choice([JUNK, SHORT]) if pick.random() < bad else pick.choice([PROSE, PROSE, MIDDLE, None])
        out.append((i, pick.choice(["http://", "https://", "q://r://"[:4]]) + host + "".join("/" + x for x in parts) + pick.choice(["", "?a=/de/", "#t", "/"]), html))
    ends = [None, "", "no scheme/de/", "http://", "http://org", "http://example.org/en/1x", "HTTP://EXAMPLE.org/es/\n/x", "http://a.com/" + "x" * 100000, "http://a.com/" + "x/" * 3000]
    out += [(3000 + k, u, PROSE) for k, u in enumerate(ends)] + [(None, "http://d.com/de/1", JUNK), (5, out[5][1], PROSE), (None, None, None)]
    return [(*r, "clash", 1, 0.5) for r in out]


def test_matches_brute_force(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.purity, 9), r.n_labels) for r in filtered(df).collect())
    want = brute(rows())
    assert got == want
    assert sum(k[3] is None and k[4] == "block" and "casino" not in k[1] for k in want) > 20
    assert filtered(df.where("false")).collect() == []


def test_a_bad_template_is_blocked_beside_a_good_one(spark):
    data = [(i, f"http://s.net/{'tag' if i % 2 else 'news'}/p/{i}", JUNK if i % 2 else PROSE) for i in range(60)] + [(100 + i, f"http://free-bets.net/x/{i}", None) for i in range(30)] + [(200, "http://fine.net/x/1", PROSE)]
    got = {r.page_id: r for r in filtered(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert all(got[100 + i].verdict == "block" for i in range(30)) and got[200].verdict == "allow"
    assert (got[0].verdict, got[0].template) == ("allow", "/news") and (got[1].verdict, got[1].template) == ("block", "/tag")


def test_depth_is_that_of_the_paths(spark):
    deep = lambda i: f"http://d.net/2024/05/12/a/b/c/{'bad' if i % 2 else 'good'}/{i}"
    df = spark.createDataFrame([(i, deep(i), None, bool(i % 2)) for i in range(40)], "page_id long, url string, html string, own boolean")
    got = {r.page_id: r for r in filtered(df, label=F.col("own")).collect()}
    assert [got[0].verdict, got[1].verdict] == ["allow", "block"] and got[1].template == "/*/*/*/a/b/c/bad"


def test_labels_of_pages_take_linear_time(spark):
    units = ["<p>", "<!--", "<script>", "<a ", "%", "x ", "<"]
    df = spark.createDataFrame([(u * 60000,) for u in units] + [(None,), ("",)], "html string")
    assert [r[0] for r in df.select(page_label(F.col("html"))).collect()] == [True, True, True, True, True, False, True, None, True]
