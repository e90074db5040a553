"""Personal data in texts: patterns propose, checksums confirm, context adjusts.

Base spans follow fixed rules and always stay. Beyond them the method proposes
spans that those rules miss - a card or phone number that runs into another
number, account numbers, national phone and identity numbers, access secrets -
and keeps those whose score reaches the threshold. A passed checksum and
context words nearby raise a score; words that speak of something else, such
as an order number, lower it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import parts

#: In the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
THRESHOLD = 0.7
#: What context words for a kind add to a score, and words against it take away.
RAISE, LOWER = 0.35, 0.3
#: Characters before and after a span in which context words count.
REACH = 48

# Words that speak for a kind of span nearby.
CONTEXT = {
    "card": "card credit debit visa mastercard amex carte karte kreditkarte tarjeta crédito",
    "phone": "phone tel telephone mobile cell call fax whatsapp téléphone appelez telefon handy anruf teléfono móvil llame",
    "iban": "iban account bank transfer compte virement konto überweisung cuenta transferencia bic swift",
    "ssn": "ssn social security",
}
# Words that speak against a kind of span nearby.
AGAINST = {
    "ip": "version release build section chapter",
    "card": "isbn order invoice tracking serial sku ticket bestellnummer commande pedido",
    "phone": "isbn order invoice tracking serial sku ticket version bestellnummer commande pedido",
    "iban": "serial sku part",
    "ssn": "isbn order invoice serial sku part ticket",
}


def _words(words: str) -> re.Pattern:
    return re.compile(r"(?<!\w)(?:" + "|".join(words.split()) + r")(?!\w)", re.IGNORECASE)


FOR_KIND, AGAINST_KIND = {k: _words(w) for k, w in CONTEXT.items()}, {k: _words(w) for k, w in AGAINST.items()}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can begin only where its first run of digits does.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
# Digits in one run or in fours (or 4-6-5), as cards are printed.
CARD_RUN = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])")
PHONE_RUN = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
PHONE_HOME = re.compile(r"(?<![0-9+)(-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?i:\b(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|client[_-]?secret|auth[_-]?key))[\"']?\s{0,4}[=:]\s{0,4}[\"']([A-Za-z0-9+/_.=-]{12,512})[\"']")


class Span(NamedTuple):
    start: int
    rank: int
    end: int
    base: bool
    score: float

    @property
    def kind(self) -> str:
        return KINDS[self.rank]

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of an account number whose letters count 10 to 35."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def issued(digits: str) -> bool:
    """Whether some card network issues numbers of this length with this beginning."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    if n == 16:
        return digits[0] == "4" or 51 <= two <= 55 or 2221 <= four <= 2720 or four == 6011 or two == 65 or 3528 <= four <= 3589
    return n == 15 and two in (34, 37) or n == 14 and two in (36, 38) or n in (13, 19) and digits[0] == "4"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in LOCAL:
            first -= 1
        m = DOMAIN.match(text, at + 1) if first < at else None
        if m:
            yield first, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed rules: leftmost, not overlapping within a kind, failing matches dropped."""
    found = [Span(a, 0, b, True, 1.0) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [Span(m.start(), 1, m.end(), True, 0.8) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
                found.append(Span(m.start(), 2, m.end(), True, 0.8))
        if "+" in text:
            found += [Span(m.start(), 3, m.end(), True, 0.8) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


def scored(text: str, kind: str, start: int, end: int, score: float) -> float:
    """The score of a span after a look at the words around it; 0 to 1."""
    before, after = text[max(0, start - REACH) : start], text[end : end + REACH]
    for words, change in ((FOR_KIND.get(kind), RAISE), (AGAINST_KIND.get(kind), -LOWER)):
        if words and (words.search(before) or words.search(after)):
            score += change
    return round(min(1.0, max(0.0, score)), 6)


def _proposed(text: str) -> Iterator[tuple[int, int, int, float]]:
    """(start, kind's rank, end, score before context) of what the base rules may miss."""
    if '"' in text or "'" in text:
        for m in SECRET.finditer(text):
            yield m.start(1), 6, m.end(1), 0.8
    if not DIGIT.search(text):
        return
    for m in CARD_RUN.finditer(text):
        if luhn(d := re.sub("[ -]", "", m[0])):
            yield m.start(), 2, m.end(), 0.8 if issued(d) else 0.5
    if "+" in text:
        for m in PHONE_RUN.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                yield m.start(), 3, m.end(), 0.75
    for m in PHONE_HOME.finditer(text):
        yield m.start(), 3, m.end(), 0.45
    for m in IBAN.finditer(text):
        whole = m[0]
        for n in range(len(whole), 14, -1):  # words in capitals may follow
            code = whole[:n].replace(" ", "")
            if whole[n - 1] != " " and (n == len(whole) or whole[n] == " ") and 15 <= len(code) <= 34 and mod97(code):
                yield m.start(), 4, m.start() + n, 0.9
                break
    for m in SSN.finditer(text):
        yield m.start(), 5, m.end(), 0.4


def find(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a text, base spans and added ones, by start and kind.

    Added are the proposals that reach the threshold, best first, but for those
    that overlap an accepted span of their kind or lie inside any accepted span.
    Spans of different kinds may overlap: an account number stays beside a card
    number that its digits happen to form. Offsets count code points, ends are
    exclusive. Null and empty texts have none; texts are read whole.
    """
    if not text:
        return []
    found = [s._replace(score=scored(text, s.kind, s.start, s.end, s.score)) for s in base_spans(text)]
    added = []
    for start, rank, end, score in _proposed(text):
        score = scored(text, KINDS[rank], start, end, score)
        if score >= threshold:
            added.append(Span(start, rank, end, False, score))
    held = {rank: _Ranges(s for s in found if s.rank == rank) for rank in range(len(KINDS))}
    for s in sorted(added, key=lambda s: (-s.score, s)):
        if not held[s.rank].overlaps(s) and not any(r.covers(s) for r in held.values()):
            held[s.rank].add(s)
            found.append(s)
    return sorted(found)


class _Ranges:
    """Disjoint spans in order."""

    def __init__(self, spans: Iterable[Span]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s in spans:
            self.add(s)

    def add(self, s: Span) -> None:
        k = bisect_right(self.starts, s.start)
        self.starts.insert(k, s.start)
        self.ends.insert(k, s.end)

    def overlaps(self, s: Span) -> bool:
        k = bisect_left(self.starts, s.end)
        return k > 0 and self.ends[k - 1] > s.start

    def covers(self, s: Span) -> bool:
        k = bisect_right(self.starts, s.start)
        return k > 0 and self.ends[k - 1] >= s.end


def detect(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) for every row of ``docs``.

    Counts and the digest are of base spans, ``spans`` lists all, ties of start
    by kind. A null or empty text has none; texts are read whole, however long.
    Null ids and repeated rows are rows like any other; an empty table gives an
    empty table.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            out: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                spans = find(value.as_py(), threshold)
                base = [s for s in spans if s.base]
                for k in range(4):
                    out[k].append(sum(s.rank == k for s in base))
                out[4].append(hashlib.sha256(",".join(map(str, base)).encode()).hexdigest())
                out[5].append(",".join(map(str, spans)))
                out[6].append([s.score for s in spans])
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.float32())]
            columns = [batch.column(0), *map(pa.array, out, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or chain of overlapping ones, replaced by the first one's kind."""
    parts, at, open_end = [], 0, -1
    for s in spans:
        if s.start < open_end:
            open_end = at = max(open_end, s.end)
            continue
        parts += [text[at : s.start], f"<{s.kind.upper()}>"]
        open_end = at = s.end
    return "".join(parts) + text[at:]


def redacted(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span of ``text`` masked; ``n_chars``, if there, follows the texts that change.

    Overlapping spans are masked as one, by the kind of the first. Null and
    empty texts and texts without spans stay as they are, as do all other
    columns; texts are read whole, however long. Repeated rows and null ids are
    rows like any other; an empty table gives an empty table.
    """
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text_at):
            columns = list(batch.columns)
            changed: dict[int, str] = {}
            for k, value in enumerate(columns[text_at]):
                text = value.as_py()
                if spans := find(text, threshold):
                    changed[k] = masked(text, spans)
            if changed:
                columns[text_at] = pa.array([changed.get(k, v) for k, v in enumerate(columns[text_at].to_pylist())], columns[text_at].type)
                if chars_at >= 0:
                    columns[chars_at] = pa.array([len(changed[k]) if k in changed else v for k, v in enumerate(columns[chars_at].to_pylist())], columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
