"""Chat formatting by perspective rotation, with DataFrame functions only.

A dialogue is rendered once for each of its participants: that speaker is the
assistant, the others are named users, and the masks cover what the speaker
says, so a model learns every voice. Control marks that a text brings with it
are escaped, so no turn can pose as another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import beside
from .scratch import stored

SYSTEM, NOBODY = "system", "unknown"
END = "<|end|>\n"
#: Bytes of turns from which a dialogue is rendered in parts, each of about so many; a turn counts its text, its role and TURN_BYTES.
PART_BYTES, TURN_BYTES = 8 << 20, 64


def _escaped(text: Column) -> Column:
    """The text with one more backslash between each ``<`` and the ``|`` of a control mark; taking it away gives the text back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _name(role: Column) -> Column:
    """The role as a name in a mark; one that has to change keeps a digest, so names stay distinct."""
    plain = F.regexp_replace(role, r"[|<>\s\\~]+", "_")
    return F.when(plain == role, role).otherwise(F.concat(plain, F.lit("~"), F.substring(F.md5(role.cast("binary")), 1, 8)))


def _size(role: Column, text: Column) -> Column:
    return F.octet_length(role) + F.octet_length(text) + TURN_BYTES


def _head(role: Column, speaker: Column) -> Column:
    name = _name(role)
    return F.when(role == SYSTEM, F.lit("<|system|>\n")).when(role == speaker, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))


def _rendered(parts: DataFrame) -> DataFrame:
    """From (conv_id, speaker, part, turns): the text, and the masks as code-point spans start:end."""
    segments = F.transform(
        "turns", lambda t: F.struct(F.length(_head(t["role"], F.col("speaker"))).alias("a"), (t["role"] == F.col("speaker")).alias("own"), F.concat(_head(t["role"], F.col("speaker")), _escaped(t["text"]), F.lit(END)).alias("s"))
    )
    cut = parts.select("conv_id", "speaker", "part", segments.alias("g"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("m"))

    def step(acc: Column, g: Column) -> Column:
        end = acc["at"] + F.length(g["s"])
        span = F.concat_ws(":", (acc["at"] + g["a"]).cast("string"), (end - 1).cast("string"))  # the line break isn't learnt
        return F.struct(end.alias("at"), F.when(g["own"], F.concat(acc["m"], F.array(span))).otherwise(acc["m"]).alias("m"))

    masks = F.array_join(F.aggregate("g", zero, step, lambda acc: acc["m"]), ",")
    return cut.select("conv_id", "speaker", "part", F.size("g").cast("long").alias("n_turns"), F.array_join(F.transform("g", lambda g: g["s"]), "").alias("text"), masks.alias("masks"))


def _turns() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def rotated(rows: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(conv_id, speaker, part, n_turns, text, masks) for every participant of every dialogue of ``rows``.

    ``rows`` has conv_id, turn, role, text. Participants are all roles but
    ``system``, whose turns are rendered as such; a dialogue of nothing else
    has none and gives no row. Turns follow by turn (null first), then role
    and text; repeated turns stay. A null role is the participant ``unknown``,
    a null text is empty. A row without conv_id is a dialogue of its own. An
    empty table gives an empty table. A turn belongs to the part that the
    bytes of the turns before it, in units of ``part_bytes``, count; so a long
    dialogue is rendered in parts, whose texts joined in order are the whole,
    and a very long turn is never cut. Masks count from the part's begin.
    """
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit(NOBODY)).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = clean.where("conv_id is null").select("conv_id", F.array("role").alias("speakers"), F.lit(0).alias("part"), F.array(F.struct("role", "text")).alias("turns"))
    named = clean.where("conv_id is not null")
    total = named.groupBy("conv_id").agg(F.sum(_size(F.col("role"), F.col("text"))).alias("size"))
    long = stored(total.where(F.col("size") > part_bytes).select("conv_id", F.lit(True).alias("long")))
    short, parts = named, alone
    if not long.isEmpty():
        both = beside(named, long, F.lit(16), ["conv_id"])
        short = both.where("long is null").drop("long")
    whole = short.groupBy("conv_id").agg(F.collect_set("role").alias("speakers"), _turns().alias("turns"))
    parts = parts.union(whole.select("conv_id", "speakers", F.lit(0).alias("part"), "turns")).select("conv_id", F.explode("speakers").alias("speaker"), "part", "turns")
    if not long.isEmpty():
        parts = parts.union(_long_parts(both.where("long").drop("long"), part_bytes))
    return _rendered(parts.where(F.col("speaker") != SYSTEM))


def _long_parts(rows: DataFrame, part_bytes: int) -> DataFrame:
    """(conv_id, speaker, part, turns) of long dialogues, cut by the bytes before; sums run over a range-partitioned sort."""
    order = ["conv_id", "turn", "role", "text"]
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("range", F.shiftright("at", 33)).withColumn("size", _size(F.col("role"), F.col("text")))
    sums = placed.groupBy("conv_id", "range").agg(F.sum("size").alias("all"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.select("conv_id", "range", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before")))
    inside = Window.partitionBy("conv_id", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranked = beside(placed.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))), sums, F.lit(32), ["conv_id", "range"])
    cut = ranked.withColumn("part", F.floor((F.col("before") + F.col("own")) / part_bytes).cast("int"))
    turns = cut.groupBy("conv_id", "part").agg(_turns().alias("turns"))
    speakers = stored(rows.select("conv_id", F.col("role").alias("speaker")).distinct())
    return turns.join(speakers, "conv_id").select("conv_id", "speaker", "part", "turns")


ORACLE_SQL = f"""
WITH c AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT conv_id, role, regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') AS text, k,
    (coalesce(sum(octet_length(encode(role)) + octet_length(encode(text)) + {TURN_BYTES}) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {PART_BYTES})::INTEGER AS part
  FROM c),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
n AS (SELECT DISTINCT role, regexp_replace(role, '[|<>\\s\\\\~]+', '_', 'g') AS plain FROM t),
h AS (
  SELECT t.*, speaker, CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = speaker THEN '<|assistant|>' || chr(10)
    ELSE '<|user name=' || CASE WHEN plain = role THEN role ELSE plain || '~' || substr(md5(role), 1, 8) END || '|>' || chr(10) END AS head
  FROM t JOIN s USING (conv_id) JOIN n USING (role)),
g AS (SELECT *, head || text || '<|end|>' || chr(10) AS seg FROM h),
o AS (SELECT *, sum(length(seg)) OVER (PARTITION BY conv_id, speaker, part ORDER BY k) AS e FROM g)
SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(seg, '' ORDER BY k) AS text,
  coalesce(string_agg(CASE WHEN role = speaker THEN (e - length(seg) + length(head))::BIGINT || ':' || (e - 1)::BIGINT END, ',' ORDER BY k), '') AS masks
FROM o GROUP BY conv_id, speaker, part
"""
