"""URL filters: fixed rules first, then a path-template tree per host.

Only DataFrame functions run here. Variable path segments (numbers, hashes,
dates, long mixes of letters and digits) become wildcards; per host the
templates form a tree, as deep as its paths. At each node that has good and
bad labels the branches are ordered by their share of bad ones, and neighbours
in that order whose shares don't differ significantly are merged, pair by
pair; what stays apart is a branch of its own. A branch's purity is its share
of bad labels, smoothed by that of the node above; URLs whose last branch is
surely bad are blocked.

Labels come from the rules' own verdicts, from words in host names, and from
the pages themselves: a page that is mostly symbols or has hardly any words is
bad, one of ordinary prose is good, others have no label. A caller may bring
other labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontam import fold
from .joins import beside
from .scratch import stored

# Fixed values: (host, path, verdict). A rule fits its host and all subdomains.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# Words in host names that label a page as bad.
BAD_WORDS = ("adult", "bets", "casino", "pills", "porn", "spam", "track", "warez")

#: Labels that a branch needs to be compared, and a template to be rejected.
LEAST = 3
#: Branches are merged if their shares differ by no more than so many standard deviations of a common share.
DEVIATIONS = 1.96
#: Weight of the purity above, and the purity from which a template is rejected.
WEIGHT, PURITY = 2.0, 0.75
#: Steps of the share of bad labels in which branches are compared; those of one step are alike.
STEPS = 20
#: Words below which a page is bad, and from which it may be good; one in so many characters being a symbol makes it bad, or keeps it from being good.
FEW_WORDS, MANY_WORDS, BAD_SYMBOLS, GOOD_SYMBOLS = 20, 50, 10, 50
END = "$"
MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style|noscript|template|svg|head)\b.*?(?:</(?:script|style|noscript|template|svg|head)\s*>|\z)|<[a-z/!?][^>]*+(?:>|\z)"
SYMBOL = r"[#*$%|<>]"


def host_of(url: Column) -> Column:
    return F.coalesce(fold(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ruled(rules: tuple, take) -> Column:
    """The longest fitting rule's ``take``, or null."""
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for h, p, _ in rules]
    order = sorted(range(len(rules)), key=lambda k: -len(rules[k][0] + rules[k][1]))
    return F.coalesce(*[F.when(fits[k], F.lit(take(rules[k]))) for k in order], F.lit(None).cast("string"))


def templates(path: Column) -> Column:
    """All of the path's segments with variable ones as wildcards, and an end mark."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def general(s: Column) -> Column:
        name, ending = F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(s, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
        wild = name.rlike(r"^[0-9._-]*[0-9][0-9._-]*$") | name.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$") | name.rlike(r"^(?=.*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]{8,}$")
        return F.when(wild, F.concat(F.lit("*"), ending)).otherwise(s)

    return F.concat(F.transform(parts, general), F.array(F.lit(END)))


def page_label(html: Column) -> Column:
    """Whether a page's text is bad; null if that isn't clear or there is no page."""
    text = F.regexp_replace(html, MARKUP, " ")
    one = F.struct(F.regexp_count(text, F.lit(r"\S+")).alias("words"), F.regexp_count(text, F.lit(SYMBOL)).alias("symbols"), F.length(text).alias("chars"))
    # as an element, so that the text is made once
    judged = F.transform(F.array(one), lambda x: F.when((x["words"] < FEW_WORDS) | (BAD_SYMBOLS * x["symbols"] > x["chars"]), True).when((x["words"] >= MANY_WORDS) & (GOOD_SYMBOLS * x["symbols"] <= x["chars"]), False))
    return F.when(html.isNotNull(), F.get(judged, 0))


def _purity(bad: Column, n: Column, above: Column, weight: float) -> Column:
    return (bad + weight * above) / (n + weight)


def _merged(bins: Column, deviations: float) -> Column:
    """Clusters of an array of ``BRANCHES`` in ascending order, with the bins of each: neighbours that don't differ are one."""
    kind = f"array<struct<bins:array<int>,{CLUSTER}>>"

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        n, b = last["n"] + x["n"], last["b"] + x["b"]
        p = F.try_divide(b, n)
        spread = F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), last["n"]) + F.try_divide(F.lit(1.0), x["n"])))
        far = F.abs(F.try_divide(last["b"], last["n"]) - F.try_divide(x["b"], x["n"])) > deviations * spread
        apart = (F.size(done) == 0) | F.coalesce(far, F.lit(False))
        new = F.struct(F.array(x["bin"]).alias("bins"), *[x[c].alias(c) for c in ("n", "b", "segs", "seg", "low", "high")])
        low, high = F.least(last["low"], x["low"]).alias("low"), F.greatest(last["high"], x["high"]).alias("high")
        both = F.struct(F.concat(last["bins"], F.array(x["bin"])).alias("bins"), n.alias("n"), b.alias("b"), (last["segs"] + x["segs"]).alias("segs"), F.least(last["seg"], x["seg"]).alias("seg"), low, high)
        return F.when(apart, F.concat(done, F.array(new))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both)))

    return F.aggregate(bins, F.array().cast(kind), step)


def _common(a: Column, b: Column) -> Column:
    """How many elements two arrays begin with alike."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(first == 0, F.size(a)).otherwise(first - 1).cast("int")


#: What is known of a set of branches: labels, bad ones, how many, the least, and the least and greatest of the paths below.
CLUSTER = "n:bigint,b:bigint,segs:bigint,seg:string,low:array<string>,high:array<string>"


def _below(rest: Column, k: Column | int) -> Column:
    """An array without its first ``k`` elements."""
    return F.slice(rest, F.lit(1) + k, F.greatest(F.size(rest) - k, F.lit(0)))


def _open(m: str, w: str, least: int) -> Column:
    """Whether a node may be split: enough labels for two branches, of both kinds, and paths that differ."""
    return (F.col(m) >= 2 * least) & (F.col(w) > 0) & (F.col(w) < F.col(m)) & (F.col("low") != F.col("high"))


def template_tree(rows: DataFrame, weight: float = WEIGHT, least: int = LEAST, deviations: float = DEVIATIONS) -> DataFrame:
    """(host, segs, template, purity, n_labels) of every template, from rows (host, segs, bad: boolean or null if unlabelled).

    A node is split while its labels are of both kinds and enough for two
    branches and its paths differ. What all paths of a node begin with is
    passed at once, so there are no more rounds than splits on a path. The
    branches of a node reach one task as at most ``STEPS`` + 2 sums, however
    many they are. Branches with fewer than ``least`` labels are taken together.
    """
    held = stored(rows.groupBy("host", "segs").agg(F.count("bad").alias("n"), F.count_if("bad").alias("b")))
    total, wrong = held.agg(F.sum("n"), F.sum("b")).first()
    prior = (wrong / total) if total else 0.0
    tops = held.groupBy("host").agg(F.sum("n").alias("m"), F.sum("b").alias("w"), F.min("segs").alias("low"), F.max("segs").alias("high"))
    tops = stored(tops.withColumn("q", _purity(F.col("w"), F.col("m"), F.lit(prior), weight)).withColumn("open", _open("m", "w", least)).withColumn("skip", _common(F.col("low"), F.col("high"))))
    path = F.octet_length("host") + F.octet_length("node")
    now = beside(held, tops.drop("low", "high"), F.octet_length("host") + 32, ["host"])
    name = F.when(F.col("open"), F.concat(F.lit("/"), F.array_join(F.slice("segs", 1, F.col("skip")), "/"))).otherwise(F.lit("/"))
    now = now.select("host", "segs", _below(F.col("segs"), F.col("skip")).alias("rest"), name.alias("node"), "n", "b", "m", "q", "open")
    done = None
    while True:
        now = stored(now)
        ended = now.where(~F.col("open")).select("host", "segs", F.col("node").alias("template"), F.col("q").alias("purity"), F.col("m").alias("n_labels"))
        done = ended if done is None else done.unionByName(ended)
        at = now.where("open").withColumn("seg", F.coalesce(F.get("rest", 0), F.lit(END))).withColumn("rest", _below(F.col("rest"), 1))
        below = at.groupBy("host", "node", "seg").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.min("rest").alias("low"), F.max("rest").alias("high"))
        below = stored(below.withColumn("bin", F.when(F.col("n") < least, -1).otherwise(F.floor(STEPS * F.col("b") / F.greatest("n", F.lit(1)))).cast("int")))
        if below.isEmpty():
            return done
        sums = below.groupBy("host", "node", "bin").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("segs"), F.min("seg").alias("seg"), F.min("low").alias("low"), F.max("high").alias("high"))
        one = F.struct(F.coalesce(F.try_divide("b", "n"), F.lit(0.0)).alias("share"), "bin", "n", "b", "segs", "seg", "low", "high").alias("x")
        each = sums.select("host", "node", one).groupBy("host", "node").agg(F.array_sort(F.collect_list("x")).alias("xs")).withColumn("cs", _merged(F.col("xs"), deviations))
        each = each.select("host", "node", (F.size("cs") > 1).alias("split"), F.posexplode("cs").alias("k", "c")).select("host", "node", "split", "k", "c.*")
        own = F.when(F.col("segs") == 1, F.col("seg")).otherwise(F.concat(F.lit("{"), F.col("k").cast("string"), F.lit("}")))
        to = F.concat(F.when(F.col("node") == "/", "").otherwise(F.col("node")), F.lit("/"), own)
        each = each.withColumn("to", to).withColumn("goes", _open("n", "b", least)).withColumn("skip", _common(F.col("low"), F.col("high")))
        passed = F.when(F.col("goes") & (F.col("skip") > 0), F.concat("to", F.lit("/"), F.array_join(F.slice("low", 1, F.col("skip")), "/"))).otherwise(F.col("to"))
        clusters = stored(each.select("host", "node", F.explode("bins").alias("bin"), passed.alias("to"), F.col("n").alias("tn"), F.col("b").alias("tb"), "split", "goes", "skip"))
        at = beside(at, below.select("host", "node", "seg", "bin"), path + F.octet_length("seg") + 4, ["host", "node", "seg"])
        moved = beside(at, clusters, path + F.octet_length("to") + 32, ["host", "node", "bin"])
        purity = F.when(F.col("split"), _purity(F.col("tb"), F.col("tn"), F.col("q"), weight)).otherwise(F.col("q"))
        now = moved.select("host", "segs", _below(F.col("rest"), F.col("skip")).alias("rest"), F.col("to").alias("node"), "n", "b", F.col("tn").alias("m"), purity.alias("q"), F.col("goes").alias("open"))


def filtered(pages: DataFrame, rules: tuple = RULES, bad_words: tuple = BAD_WORDS, label: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity, n_labels) for every row of ``pages`` (page_id, url, html, ...).

    The longest rule that fits decides; without one the tree does, by the
    purity of the row's template and the labels below it. ``label`` is a
    boolean column over ``pages``, by default ``page_label`` of the html; rules
    and words in hosts come before it. A url that is null or has no ``://``
    has neither host nor path and is judged as the host ''. Templates under
    LEAST labels are allowed. Paths count to their last segment, pages whole,
    however long. Repeated rows count again; null ids are rows like any other;
    an empty table gives an empty table.
    """
    own = (page_label(F.col("html")) if "html" in pages.columns else F.lit(None).cast("boolean")) if label is None else label
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), own.alias("own"))
    rows = rows.select("*", _ruled(rules, lambda r: r[0] + r[1]).alias("rule"), _ruled(rules, lambda r: r[2]).alias("ruled"), templates(F.col("path")).alias("segs"))
    worded = F.col("host").rlike(r"(^|[.-])(" + "|".join(bad_words) + r")([.-]|$)")
    bad = F.when(F.col("ruled") == "block", True).when(worded, True).when(F.col("ruled") == "allow", False).otherwise(F.col("own"))
    rows = stored(rows.select("page_id", "host", "path", "rule", "ruled", "segs", bad.alias("bad")))
    tree = stored(template_tree(rows))
    out = beside(rows, tree, F.octet_length("host") + F.octet_length(F.array_join("segs", "/")) + F.octet_length("template") + 24, ["host", "segs"])
    gone = (F.col("purity") >= PURITY) & (F.col("n_labels") >= LEAST)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(gone, "block").otherwise("allow")).alias("verdict"), "template", "purity", "n_labels")
