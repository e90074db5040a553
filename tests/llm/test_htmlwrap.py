import random
import re
from collections import Counter
from html import unescape

import pytest

from arrowfen.llm import htmlwrap
from arrowfen.llm.htmlwrap import aligned, extracted, main_text, parse, skeleton

SCHEMA = "page_id long, url string, html string, host string, marks string"


def plain(html):
    """What the article of the generated pages holds: its headings and paragraphs."""
    m = re.search(r"<article>(.*?)(</article>|$)", html or "", re.DOTALL)
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", m[1])) if m else []
    return "\n\n".join(x for x in (" ".join(unescape(p).split()) for p in parts) if x)


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = extracted(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_furniture_goes_and_text_stays():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>X</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side</p></div>
    <article class="post"><header><h1>Head &amp; line</h1><p>by A</p></header><p>One <b>two</b><br>three&nbsp;four
    <p>Five<script>var x = "</p>";</script> six <a href="a>b">seven</a></p><aside>Aside</aside><ul><li>L1<li>L2</ul>
    <!-- <p>no</p> --><form><p>Form</p></form><div class="comments"><article><p>Nice!</p></article></div></article>
    <div class="ad">Buy</div><footer>&copy;</footer></body></html>"""
    assert main_text(html) == "Head & line\n\nOne two three four\n\nFive six seven\n\nL1\n\nL2"
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("<p>a &lt;b&gt; &#233; &#x1F600;") == "a <b> é \U0001f600"
    assert main_text("bare < text & more") == "bare < text & more"


def test_names_that_only_hold_a_word_of_furniture_stay():
    inside = '<p class="share-price">Up</p><div class="related-work">Work</div><p id="noticeOfWar">War</p><div class="share-buttons">Tell</div><div id="relatedPosts2">More</div><div class="big newsletter-signup">Join</div><div class="cookieNotice">Yes</div>'
    assert main_text(f"<body><article><p>One</p>{inside}</article></body>") == "One\n\nUp\n\nWork\n\nWar"


def test_deep_and_wide_pages_are_extracted(spark):
    wide = lambda i, n: "<body><article>" + "".join(f"<h2>{i} {j}</h2><p>{i} said {j}</p>" for j in range(n)) + "</article></body>"
    rows = [(i, "http://deep.org/", "<div>" * 5000 + f"<p>Deep {i}") for i in range(4)] + [(10 + i, "http://wide.org/", wide(i, 10_000 + i)) for i in range(4)]
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame([(*r, "clash", "c") for r in rows], SCHEMA).repartition(2)).collect()}
    assert all(got[i] == f"Deep {i}" for i in range(4))
    assert all(got[10 + i] == "\n\n".join(x for j in range(10_000 + i) for x in (f"{i} {j}", f"{i} said {j}")) for i in range(4))


def test_template_decides_inside_articles_of_any_host(spark):
    """Furniture without telling tags or classes, on hosts of different layouts: only the template can tell it."""
    said = lambda h, i: [f"Story {i} of {h} begins.", f"It has {i * 13 % 17} parts and ends."]
    forms = {
        "a.org": lambda t: f"<body><article><div>By our staff</div><p>{t[0]}</p><p>{t[1]}</p><div>Read the rules</div></article></body>",
        "b.org": lambda t: f"<body><main><section><p>Good morning</p></section><section><p>{t[0]}</p><p>{t[1]}</p></section></main></body>",
        "c.org": lambda t: f"<body><div><div>{t[0]}</div><div>{t[1]}</div></div><div>Words of the house</div></body>",
    }
    rows = [(100 * k + i, f"http://{h}/{i}", form(said(h, i))) for k, (h, form) in enumerate(forms.items()) for i in range(6)]
    df = spark.createDataFrame([(*r, "clash", "c") for r in rows], SCHEMA).repartition(3)
    assert {r.page_id: r.text for r in extracted(df).collect()} == {100 * k + i: "\n\n".join(said(h, i)) for k, h in enumerate(forms) for i in range(6)}
    off = {r.page_id: r.text for r in extracted(df, least=100).collect()}
    assert all(off[i] != text for i, text in {r[0]: "\n\n".join(said("a.org", r[0])) for r in rows[:6]}.items())


def test_tree_matching_aligns_the_most_nodes():
    tree = lambda h: skeleton(parse(h)[0])
    a = tree("<div><h1>x</h1><p>1</p><p>2</p><ul><li>q</ul></div>")
    b = tree("<div><h1>y</h1><div>new</div><p>1</p><p>2</p><p>3</p><ul><li>q</ul></div>")
    size, pairs = aligned(a, b)
    assert size == 7 and sum(x == y for x, y in pairs) == 3  # top, div, h1, p, p, ul, li; heading differs
    assert aligned(a, a)[0] == 7 and all(x == y for x, y in aligned(a, a)[1])


def test_constant_nodes_are_template_where_no_article_is_marked(spark):
    page = lambda i: f"<body><div><p>Welcome to our site</p></div><div><p>Story {i} begins.</p><p>It goes on, {i}.</p></div><section><p>All rights</p></section></body>"
    rows = [(i, f"http://one.org/{i}", page(i)) for i in range(8)] + [(50, "http://lone.org/", page(50)), (51, None, None), (None, None, "<p>x"), (52, "http://one.org/e", ""), (3, "http://one.org/3", page(3))]
    df = spark.createDataFrame([(*r, "clash", "c") for r in rows], SCHEMA).repartition(3)
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in extracted(df).collect())
    text = lambda i, u: f"Story {i} begins.\n\nIt goes on, {i}." if "//one" in (u or "") else "Welcome to our site\n\nStory 50 begins.\n\nIt goes on, 50.\n\nAll rights"
    want = Counter()
    for i, u, h in rows:
        t = "x" if h == "<p>x" else text(i, u) if h else ""
        want[i, u, t, len(t)] += 1
    assert got == want
    assert extracted(df.where("false")).collect() == []


def test_template_counts_inside_articles_and_all_articles_stay(spark):
    story = lambda i: f"<p>Story {i} begins in town {i * 7}.</p><p>It goes on for {i} days.</p>"
    page = lambda i: f"<body><article><h2>News {i}</h2>{story(i)}<div>Get our letter</div></article><article>{story(i + 100)}</article></body>"
    copy = lambda i: f"<body><div>Page {i}</div><article>{story(5)}<p>The end of it.</p></article></body>"
    rows = [(i, f"http://one.org/{i}", page(i)) for i in range(8)] + [(i, f"http://copies.org/{i}", copy(i)) for i in range(20, 28)]
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame([(*r, "clash", "c") for r in rows], SCHEMA).repartition(3)).collect()}
    said = lambda i: f"Story {i} begins in town {i * 7}.\n\nIt goes on for {i} days."
    assert got == {i: f"News {i}\n\n{said(i)}\n\n{said(i + 100)}" for i in range(8)} | {i: f"{said(5)}\n\nThe end of it." for i in range(20, 28)}


def test_equal_siblings_and_second_layouts_are_learnt(spark):
    said = lambda i, n: [f"Part {j} of story {i} is {i * j}." for j in range(n)]
    divs = lambda i: f"<body><div>Menu of the site</div><div>Story {i}</div><div>More {i}</div><div>All rights</div></body>"
    long = lambda i: "<body>" + "".join(f"<p>{x}</p>" for x in said(i, 2 + i % 4)) + "<p>Thanks for reading</p></body>"
    other = lambda i: f"<body><section>Shop door</section><section>Ware {i}</section><section>Cash desk</section></body>"
    rows = [(i, f"http://divs.org/{i}", divs(i)) for i in range(8)] + [(i, f"http://divs.org/{i}", other(i)) for i in range(20, 26)] + [(i, f"http://long.org/{i}", long(i)) for i in range(40, 52)]
    got = {r.page_id: r.text for r in extracted(spark.createDataFrame([(*r, "clash", "c") for r in rows], SCHEMA).repartition(3)).collect()}
    want = {i: f"Story {i}\n\nMore {i}" for i in range(8)} | {i: f"Ware {i}" for i in range(20, 26)} | {i: "\n\n".join(said(i, 2 + i % 4)) for i in range(40, 52)}
    assert got == want


def test_long_lists_of_siblings_align():
    tree = lambda i, n: skeleton(parse("".join(f"<p>{i} {j}</p>" + "<p>Advert</p>" * (j % 50 == 9) for j in range(n)) + "<div>End</div>")[0])
    size, pairs = aligned(tree(1, 300), tree(2, 350))
    assert sum(x == y for x, y in pairs) == 7 and size >= 300  # six adverts and the end
    assert aligned(tree(1, 3000), tree(2, 4000))[0] > 3000
    deep = skeleton(parse("<div>" * 5000 + "x")[0])
    assert aligned(deep, deep)[0] == 5001


def test_alignment_does_not_depend_on_the_length_of_lists():
    tree = lambda words: skeleton(parse("".join(f"<p>{w}</p>" for w in words))[0])
    for n in (20, 100, 190, 210, 600):  # one equal text, first here and last there: it must not cost the others
        size, pairs = aligned(tree(["same", *(f"a{i}" for i in range(n))]), tree([*(f"b{i}" for i in range(n + 9)), "same"]))
        assert size == n + 2 and not any(x == y for x, y in pairs)
    rows = lambda c, n: skeleton(parse("<ul>" + "".join(f"<li><p>{c}{i}</p>" + "<p>x</p>" * (i % 3) + "</li>" for i in range(n)) + "</ul>")[0])
    for n in (30, 240):
        assert aligned(rows("a", n), rows("b", n + 4))[0] == worth(rows("a", n), rows("b", n + 4))[0]


def worth(a, b):
    """(nodes, equal texts) of the best alignment, by plain recursion."""
    if a[0] != b[0]:
        return 0, 0
    best = [(0, 0)] * (len(b[2]) + 1)
    for x in a[2]:
        row = [(0, 0)]
        for j, y in enumerate(b[2]):
            own = worth(x, y)
            row.append(max(row[j], best[j + 1], (best[j][0] + own[0], best[j][1] + own[1])))
        best = row
    return best[-1][0] + 1, best[-1][1] + (a[1] != 0 and a[1] == b[1])


@pytest.mark.parametrize(("held", "few"), [(1, 0), (1_000_000, 0), (1, 1_000_000)])
def test_alignment_is_the_best(monkeypatch, held, few):
    monkeypatch.setattr(htmlwrap, "HELD", held)
    pick = random.Random(4)

    def tree(depth=0, path=""):
        path += (key := pick.choice("aab") if depth else "t")
        text = pick.choice([0, htmlwrap.mark(path, "x"), htmlwrap.mark(path, "y")])
        return [key, text, [tree(depth + 1, path) for _ in range(5 if not depth else pick.choice([0, 0, 1, 2, 4]) if depth < 4 else 0)], 0]

    for _ in range(200):
        a, b = tree(), tree()
        size, pairs = aligned(a, b)
        assert (size, sum(x == y for x, y in pairs)) == worth(a, b)
        monkeypatch.setattr(htmlwrap, "FEW", few)
        assert aligned(a, b) == (size, pairs)
        monkeypatch.setattr(htmlwrap, "FEW", 400)


def test_long_and_broken_pages_take_linear_time():
    for unit in ("<p>", "<div>", "<a \"", "<", "</p>", "<b>", "<li>", "&amp;", "<!--", "<script>", "<p><b>x<br>", "İ<script></script>"):
        main_text(unit * 20000)
