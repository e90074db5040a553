"""Main-text extraction from web pages by wrapper induction.

Pages of a host with the same sections and classes have one layout; for each layout some
pages are references, drawn by a hash. The DOM tree of every page is aligned with those
of its layout by simple tree matching; aligned nodes whose text is the same on
nearly all pages are template, the others are slots. A page's text comes from its article elements in page order if it has
any, else from its main elements, else from all of the page; template and furniture
by tags and classes are left out of it, outside of articles also menus by their links.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import parts
from .joins import beside
from .scratch import stored
from .urltree import host_of

# Elements by how they are treated, and words in classes and ids of furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed xmp template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav header footer aside form button select dialog menu head object canvas label fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROOTS = frozenset("html body main article".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table tbody thead tfoot select menu html body".split())
LAYOUT = frozenset("html body div header nav main article section aside footer form".split())
WORDS = frozenset(
    "ad ads advert advertisement advertisements adsense banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar share sharing social related recommended "
    "recommendations comment comments disqus respond reply replies skip login copyright".split()
)
# Words that may stand beside those of furniture in a class or id without changing what it says.
BESIDE = frozenset(
    "area articles bar block body bottom box btn button buttons col column component container content count counter desktop entry fixed footer form global group header heading hidden holder "
    "icon icons inner item items js label large left link links list main mobile module more outer page panel position post posts primary right row secondary section site sized slot small "
    "space sticky stories text title top unit view wrap wrapper zone".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|\Z)", re.IGNORECASE)
RAW_ENDS = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in RAW}
TOKENS = re.compile(r"[a-z0-9]+")
DIGITS = re.compile(r"[0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

#: Nodes deeper than this are children of their ancestor at this depth.
DEEP = 150
#: Cells of an alignment's table that are held at once; of a larger one some rows are kept and the others made twice.
HELD = 1_000_000
#: Cells up to which plain numbers are quicker than arrays; a node's weight there, above any number of texts. The alignment is the same.
FEW, UNIT = 400, 1 << 40
#: Reference pages of each layout.
DRAWN = 4
#: Aligned pages that a template node needs, and the share of them that must have its text.
LEAST, SHARE = 3, 0.8
#: Share of a block's characters in links from which it is a menu, where no article is marked.
LINKS = 0.6
#: Share of a page's own text found in the reference from which it is a copy of it and has no vote on that text.
COPY = 0.9


class Node:
    """A block-level element; inline elements belong to the block around them."""

    __slots__ = ("tag", "key", "parent", "kids", "out", "root", "words")

    def __init__(self, tag: str, key: str, parent: Node | None, out: bool, root: Node | None) -> None:
        self.tag, self.key, self.parent, self.out, self.root = tag, key, parent, out, root
        self.kids: list[Node] = []
        self.words: list[str] = []


class Block:
    """Text between two block boundaries."""

    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int) -> None:
        self.node, self.text, self.linked = node, text, linked


def parse(html: str) -> tuple[Node, list[Block]]:
    """The tree of block-level elements and the text blocks in page order."""
    top = node = Node("#top", "", None, False, None)
    inline: list[str] = []  # open inline elements of the current block element
    blocks: list[Block] = []
    parts: list[str] = []
    linked = [0]

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append(Block(node, text, linked[0]))
                node.words.append(text)
            parts.clear()
        linked[0] = 0

    def say(text: str) -> None:
        if text:
            parts.append(text)
            if "a" in inline:
                linked[0] += len(text)

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, ending, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if ending:
            if tag in BLOCK:
                up = node
                while up is not top and up.tag != tag:
                    up = up.parent
                if up is not top:
                    close()
                    node, inline = up.parent, []
            elif tag in inline:
                del inline[len(inline) - 1 - inline[::-1].index(tag) :]
            continue
        if tag in RAW:
            end = RAW_ENDS[tag].search(html, at)
            at = end.start() if end else size
            continue
        if tag not in BLOCK:
            if tag in ("br", "wbr", "img"):
                parts.append(" " if tag == "br" else "")
            elif tag not in VOID and not attributes.endswith("/"):
                inline.append(tag)
            continue
        close()
        inline = []
        if tag != "option" and tag not in ("html", "body"):  # a paragraph ends where a block begins
            up = node
            while up is not top and up.tag not in LISTS and up.tag not in ("p", "td", "th", "article"):
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in ENDS:
            up = node
            while up is not top and up.tag not in LISTS:
                if up.tag in ENDS[tag]:
                    node = up.parent
                up = up.parent
        if tag == "hr":
            continue
        named = " ".join(f"{a[1].lower()}={a[2] or a[3] or a[4] or ''}" for a in ATTRIBUTE.finditer(attributes)) if attributes.strip() else ""
        out = node.out
        if not out and tag not in ROOTS:
            out = tag in FURNITURE and not (tag == "header" and node.root is not None)
            out = out or bool(named) and ("hidden=" in named or _furnished(named))
        if node.tag == "header" and node.root is not None and tag not in HEADINGS:
            out = True
        classes = " ".join(sorted(TOKENS.findall(named.lower()))) if named else ""
        child = Node(tag, f"{tag}.{classes}" if classes else tag, node, out, node.root)
        if tag in ("article", "main") and not out and (node.root is None or node.root.tag == "main" and tag == "article"):
            child.root = child
        node.kids.append(child)
        node = child
    close()
    return top, blocks


def _furnished(named: str) -> bool:
    """Whether a class, an id or a role says furniture: all words of one name must, or mean nothing by themselves, so 'share-price' and 'related-work' don't."""
    for part in re.split(r"\b(?=class=|id=|role=)", named):
        name, _, value = part.partition("=")
        if name == "role":
            if any(t in ROLES for t in TOKENS.findall(value.lower())):
                return True
        elif name in ("class", "id"):
            for one in value.split():
                tokens = TOKENS.findall(DIGITS.sub("", CAMEL.sub("-", one)).lower())
                if any(t in WORDS for t in tokens) and all(t in WORDS or t in BESIDE for t in tokens):
                    return True
    return False


def mark(path: str, text: str) -> int:
    """A signed 64-bit name of a node's place and text."""
    h = xxhash.xxh64_intdigest(f"{path}\0{text}")
    return h - (1 << 64) if h >> 63 else h


def skeleton(node: Node, path: str = "", marks: dict[int, int] | None = None, depth: int = 0) -> list:
    """[key, mark of the text or 0, children, characters of an article's text or 0]; fills ``marks`` by id of Node."""
    path = f"{path}/{node.key}"
    name = mark(path, "\n".join(node.words)) if node.words else 0
    if marks is not None:
        marks[id(node)] = name
    kids = [skeleton(k, path, marks, depth + 1) for k in node.kids] if depth < DEEP else _flat(node, path, marks)
    return [node.key, name, kids, _size(node)]


def _size(node: Node) -> int:
    return sum(map(len, node.words)) if node.root is not None and not node.out else 0


def _flat(node: Node, path: str, marks: dict[int, int] | None) -> list:
    """All nodes below ``node`` in page order, as its children."""
    found, todo = [], node.kids[::-1]
    while todo:
        n = todo.pop()
        todo += n.kids[::-1]
        name = mark(f"{path}/{n.key}", "\n".join(n.words)) if n.words else 0
        if marks is not None:
            marks[id(n)] = name
        found.append([n.key, name, [], _size(n)])
    return found


def layout_of(tree: list) -> int:
    """A name of the page's layout: which sections it has, and of which classes, digits apart; how many of each doesn't count."""
    found, todo = set(), [tree]
    while todo:
        node = todo.pop()
        if node[0].partition(".")[0] in LAYOUT:
            found.add(DIGITS.sub("", node[0]))
        todo += node[2]
    return mark("layout", " ".join(sorted(found)))


def article_texts(tree: list) -> dict[int, int]:
    """Characters by mark of the texts inside articles."""
    found, todo = {}, [tree]
    while todo:
        node = todo.pop()
        if node[3]:
            found[node[1]] = node[3]
        todo += node[2]
    return found


def voted(references: list[list], tree: list) -> dict[int, bool]:
    """By mark of the references' aligned nodes, one vote of the page: is its text the same here. A copied article has no vote on what is inside."""
    votes: dict[int, bool] = {}
    ours = article_texts(tree)
    for reference in references:
        theirs = article_texts(reference)
        copied = sum(n for m, n in ours.items() if m in theirs) >= COPY * sum(ours.values())
        for a, b in aligned(reference, tree)[1]:
            if not (copied and a in theirs):
                votes[a] = votes.get(a, False) or a == b
    return votes


def aligned(a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: how many nodes align top-down in order, and the text marks of those with text in both.

    The most nodes are aligned; among such alignments one with the most equal
    texts. That holds for lists of any length; time grows with the product of
    the pages' nodes at each depth, memory doesn't.
    """
    if a[0] != b[0]:
        return 0, []
    size, found = _aligned_kids(a[2], b[2]) if a[2] and b[2] else (0, [])
    return size + 1, [(a[1], b[1]), *found] if a[1] and b[1] else found


def _aligned_kids(rows: list, columns: list) -> tuple[int, list[tuple[int, int]]]:
    """The alignment of two lists of siblings: equal ends first, which loses nothing, the rest by dynamic programming."""
    head, most = 0, min(len(rows), len(columns))
    while head < most and rows[head] == columns[head]:
        head += 1
    tail = 0
    while tail < most - head and rows[-1 - tail] == columns[-1 - tail]:
        tail += 1
    x, y = rows[head : len(rows) - tail], columns[head : len(columns) - tail]
    keys, others = [i[0] for i in x], [j[0] for j in y]
    deep = {i[0] for i in x if i[2]}.intersection(j[0] for j in y if j[2])
    if keys == others and all(keys.count(key) == 1 for key in deep):
        pairs = zip(x, y)  # all align in one way only, and no pair of more than one node has another place
    elif not deep and (keys == others[: len(x)] or keys[: len(y)] == others) and {i[1] for i in x if i[1]}.isdisjoint(j[1] for j in y):
        pairs = zip(x, y)  # what the table gives where the shorter list is all aligned and no text is equal
    else:
        pairs = ((x[i], y[j]) for i, j in (_best(x, y) if deep or len(x) * len(y) > FEW else _quick(x, y)))
    parts = [aligned(i, i) for i in rows[:head]] + [aligned(i, j) for i, j in pairs] + [aligned(i, i) for i in rows[len(rows) - tail :]]
    return sum(n for n, _ in parts), [p for _, some in parts for p in some]


def _nodes(some: list) -> int:
    return sum(1 + _nodes(n[2]) for n in some)


class _Level:
    """The nodes of one depth below a list of siblings, children of one parent side by side, and what a row of the alignment needs of them."""

    def __init__(self, parents: list | None, nodes: list, shift: int) -> None:
        self.nodes, self.shift = nodes, shift
        self.none = np.zeros(len(nodes), np.int64)
        self.shapes: dict[tuple, int] = {}
        self.known: dict[int, np.ndarray] = {}  # weights by shape, HELD cells of them at most
        places: dict[str, list[int]] = {}
        self.marks: dict[int, list[int]] = {}
        for j, n in enumerate(nodes):
            places.setdefault(n[0], []).append(j)
            if n[1]:
                self.marks.setdefault(n[1], []).append(j)
        self.keys = {}
        for key, some in places.items():
            self.keys[key] = self.none.copy()
            self.keys[key][some] = 1 << shift
        counts = np.array([len(n[2]) for n in parents] if parents is not None else [len(nodes)], np.int64)
        self.some = np.flatnonzero(counts)
        self.ends = np.cumsum(counts)[self.some] - 1
        self.starts = self.ends - counts[self.some] + 1
        self.room = 2 * shift + 1  # bits of a weight
        self.narrow = self.room + len(self.some).bit_length() < 63
        self.offset = np.repeat(np.arange(len(self.some), dtype=np.int64) << self.room, counts[self.some]) if self.narrow else None

    def after(self, best: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The next row of the table of each parent: the best of the row above, of the cell to the left, and of the two nodes together."""
        row = np.empty_like(best)
        row[1:] = best[:-1]
        row[self.starts] = 0
        row += weights
        np.maximum(row, best, out=row)
        if len(self.starts) == 1:
            return np.maximum.accumulate(row, out=row)
        if self.narrow:
            row += self.offset
            np.maximum.accumulate(row, out=row)
            row -= self.offset
        else:
            for i, j in zip(self.starts.tolist(), self.ends.tolist()):
                np.maximum.accumulate(row[i : j + 1], out=row[i : j + 1])
        return row


def _shape(node: list, levels: list[_Level], depth: int) -> int | None:
    """A number of all that weighs of a node at that depth: its key, its text if any node there has it, and its children; None if nothing."""
    level = levels[depth]
    if node[0] not in level.keys:
        return None
    kids = tuple([s for k in node[2] if (s := _shape(k, levels, depth + 1)) is not None]) if depth + 1 < len(levels) else ()
    return level.shapes.setdefault((node[0], node[1] if node[1] in level.marks else 0, kids), len(level.shapes))


def _weights(node: list, levels: list[_Level], depth: int) -> np.ndarray | None:
    """What ``node`` aligned with each node of that depth is worth: nodes first, then equal texts; None if nothing. Not to be written to."""
    level = levels[depth]
    out = level.keys.get(node[0])
    if out is None:
        return None
    same = level.marks.get(node[1]) if node[1] else None
    kids = shape = None
    if node[2] and depth + 1 < len(levels):
        shape = _shape(node, levels, depth)
        if shape in level.known:
            return level.known[shape]
        below = levels[depth + 1]
        for kid in node[2]:
            weights = _weights(kid, levels, depth + 1)
            if weights is not None:
                kids = below.after(below.none if kids is None else kids, weights)
    if same is not None or kids is not None:
        one = out > 0
        out = out.copy()
        if same is not None:
            out[same] += 1
        if kids is not None:
            out[below.some] += kids[below.ends]
            out *= one
    if shape is not None and len(level.known) * len(out) < HELD:
        level.known[shape] = out
    return out


def _best(rows: list, columns: list) -> list[tuple[int, int]]:
    """Which rows align with which columns: the table's rows are made one after the other, and those on the way back made again from the last one that was kept."""
    if not rows or not columns:
        return []
    shift = min(_nodes(rows), _nodes(columns)).bit_length()
    levels = [_Level(None, columns, shift)]
    while below := [k for n in levels[-1].nodes for k in n[2]]:
        levels.append(_Level(levels[-1].nodes, below, shift))
    top = levels[0]

    def row(best: np.ndarray, i: int) -> np.ndarray:
        weights = _weights(rows[i], levels, 0)
        return best if weights is None else top.after(best, weights)

    step = len(rows) if len(rows) * len(columns) <= HELD else max(1, math.isqrt(len(rows)))
    best, kept = top.none, []
    for i in range((len(rows) - 1) // step * step):
        if i % step == 0:
            kept.append(best)
        best = row(best, i)
    kept.append(best)
    at, found = len(columns), []
    for block in range(len(kept) - 1, -1, -1):
        first = block * step
        table = [kept[block]]
        for i in range(first, min(first + step, len(rows))):
            table.append(row(table[-1], i))
        some = _back(table, at)
        at = some[-1][1] if some else at
        found += [(first + i, j) for i, j in some]
    return found[::-1]


def _back(table: list, j: int) -> list[tuple[int, int]]:
    """The pairs on the way back from the table's last row and column ``j``, last first; columns count from 1."""
    i, found = len(table) - 1, []
    while i and j:
        here = table[i][j - 1]
        if here == table[i - 1][j - 1]:
            i -= 1
        elif here == (table[i][j - 2] if j > 1 else 0):
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found


def _quick(rows: list, columns: list) -> list[tuple[int, int]]:
    """The same as ``_best`` where no pair has children on both sides, cell by cell; quicker for few cells."""
    names, table = [(n[0], n[1]) for n in columns], [[0] * len(columns)]
    for key, mark, *_ in rows:
        above, row, corner, left = table[-1], [], 0, 0
        for (other, text), up in zip(names, above):
            if up > left:
                left = up
            if key == other:
                both = corner + UNIT + (mark != 0 and mark == text)
                if both > left:
                    left = both
            corner = up
            row.append(left)
        table.append(row)
    return _back(table, len(columns))[::-1]


def main_text(html: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's main text; ``template`` has the marks of its host's constant nodes."""
    if not html:
        return ""
    top, blocks = parse(html)
    blocks = [b for b in blocks if not b.node.out]
    tags = {b.node.root.tag for b in blocks if b.node.root is not None}
    root = "article" if "article" in tags else "main" if tags else None
    marks: dict[int, int] = {}
    if template:
        skeleton(top, "", marks)
    own = [b for b in blocks if marks.get(id(b.node), 0) not in template]
    if root:
        inside = lambda some: [b for b in some if b.node.root is not None and b.node.root.tag == root]
        blocks = inside(own) or inside(blocks)
    else:
        blocks = [b for b in own if b.linked < LINKS * len(b.text)]
    return "\n\n".join(b.text for b in blocks)


def wrappers(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(host, marks): the template nodes of each host of ``pages`` (page_id, url, html), by all its pages.

    Layouts of fewer than ``least`` pages are one layout together. Pages
    without text have no vote; null urls are the host ''; repeated rows vote
    again; pages are read whole, however long, deep or wide. A host without
    template nodes isn't listed; an empty table gives an empty table.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 3):
            parsed = [parse(v.as_py() or "") for v in batch.column(3)]
            found = [skeleton(top) if blocks else None for top, blocks in parsed]
            made = [t and json.dumps(t, separators=(",", ":")) for t in found]
            layouts = [t and layout_of(t) for t in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string()), pa.array(layouts, pa.int64())], names=["page_id", "url", "host", "tree", "layout"])

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, layouts, marks, same = [], [], [], []
            held: dict[tuple, list] = {}
            for host, layout, tree, references in zip(*(c.to_pylist() for c in batch.columns)):
                if (host, layout) not in held:
                    held[host, layout] = [json.loads(r) for r in references]
                for name, equal in voted(held[host, layout], json.loads(tree)).items():
                    hosts.append(host)
                    layouts.append(layout)
                    marks.append(name)
                    same.append(equal)
            columns = [pa.array(hosts, pa.string()), pa.array(layouts, pa.int64()), pa.array(marks, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "layout", "mark", "same"])

    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    made = stored(rows.mapInArrow(trees, "page_id long, url string, host string, tree string, layout long").where("tree is not null and host is not null"))
    common = made.groupBy("host", "layout").agg(F.count("*").alias("m")).where(F.col("m") >= least).select("host", "layout", F.lit(True).alias("common"))
    known = beside(made, stored(common), F.octet_length("host") + 9, ["host", "layout"]).withColumn("layout", F.when(F.col("common"), F.col("layout")).otherwise(0)).drop("common")
    turn = F.xxhash64("page_id", "url", "tree")
    drawn = known.withColumn("turn", turn).groupBy("host", "layout", F.pmod("turn", F.lit(DRAWN)).alias("slot")).agg(F.min(F.struct("turn", "tree")).alias("r"), F.count("*").alias("m"))
    some = drawn.groupBy("host", "layout").agg(F.collect_list("r.tree").alias("references"), F.sum("m").alias("m")).where(F.col("m") >= least).drop("m")
    references = stored(some)
    size = F.aggregate("references", F.lit(0).cast("long"), lambda n, r: n + F.octet_length(r))
    both = beside(known, references, size + F.octet_length("host"), ["host", "layout"], "inner").select("host", "layout", "tree", "references")
    counted = both.mapInArrow(votes, "host string, layout long, mark long, same boolean").groupBy("host", "layout", "mark").agg(F.count("*").alias("n"), F.count_if("same").alias("k"))
    fixed = counted.where((F.col("n") >= least) & (F.col("k") >= share * F.col("n")))
    return fixed.groupBy("host").agg(F.collect_set("mark").alias("marks"))


def extracted(pages: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html, ...).

    Blocks follow in page order, joined by two line breaks; inside a block
    character references are decoded and white space is one space. Null and
    empty pages have the text ''; pages are read whole, however long. Null ids
    and urls and repeated rows are rows like any other; an empty table gives an
    empty table.
    """
    known = stored(wrappers(pages, least, share))
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    both = beside(rows, known, F.size("marks") * 8 + F.octet_length("host"), ["host"]).select("page_id", "url", "html", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2):
            texts = [main_text(html.as_py(), set(marks.as_py() or ())) for html, marks in zip(batch.column(2), batch.column(3))]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return both.mapInArrow(run, "page_id long, url string, text string, n_chars long")
