import hashlib
import random
import re
from collections import Counter

from arrowfen.llm.pii import base_spans, detect, find, luhn, masked, mod97, redacted

from .conftest import messy_rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_match_plain_patterns():
    pick = random.Random(4)
    pieces = ["a@b.c", "@", ".", "x_y@", "d-e.fg", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 555-1234", "+", "-", " ", "(", ")", "9", "é", "\U0001f600", "\n", "%", "a", "AT.", "12", "0" * 30]
    for _ in range(4000):
        text = "".join(pick.choice(pieces) for _ in range(pick.randrange(1, 14)))
        assert [(s.start, s.rank, s.end) for s in base_spans(text)] == brute(text), text


def test_checksums():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765433")


def test_the_method_adds_what_base_rules_miss():
    text = "Call +1 (269) 555-3296 4524132264652876 now"
    assert [str(s) for s in find(text)] == ["phone:5:22", "card:23:39"] and base_spans(text) == []
    kinds = lambda t: [s.kind for s in find(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 AND MORE") == ["iban"]
    assert kinds("my ssn is 078-05-1120.") == ["ssn"] and kinds("part 078-05-1120.") == []
    assert kinds("phone: (212) 555-0199") == ["phone"] and kinds("score (212) 555-0199") == []
    assert kinds("plain words 12 and 3.4 and 2024-01-02 10:00") == []
    assert kinds("1234 5678 9012 3456") == []


def words_near(words, text, a, b):
    near = re.findall(r"\w+", text[max(0, a - 48) : a].lower()) + re.findall(r"\w+", text[b : b + 48].lower())
    return any(w in near for w in words)


# The method once more, by trying every start and end instead of by search.
BEFORE, AFTER = r"(?<![0-9])", r"(?![0-9])"
SHAPES = [
    (2, BEFORE + r"([0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4})" + AFTER),
    (3, r"(?<![0-9+)(-])(\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])"),
    (5, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
]
SPEAKS = {2: ("card", "visa"), 3: ("phone", "call"), 5: ("ssn",)}
DENIES = {2: ("order", "isbn"), 3: ("order", "isbn"), 5: ("order", "isbn", "part")}
ISSUED = re.compile(r"4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|6011|65|352[89]|35[3-8]")


def brute_added(text):
    found = []
    for rank, shape in SHAPES:
        at = 0
        while at < len(text):  # leftmost, longest alternative as written, not overlapping
            m = next((m for a in range(at, len(text)) if (m := re.compile(shape).match(text, a))), None)
            if m is None:
                break
            a, b, digits = m.start(), m.end(), re.sub("[^0-9]", "", m[0])
            at = b
            if rank == 2 and not luhn(digits) or rank == 5 and (digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000"):
                continue
            real = {13: "4", 14: "3[68]", 15: "3[47]", 16: ISSUED, 19: "4"}.get(len(digits), "x")
            score = {2: 0.8 if re.match(real, digits) else 0.5, 3: 0.45, 5: 0.4}[rank]
            score += 0.35 * words_near(SPEAKS[rank], text, a, b) - 0.3 * words_near(DENIES[rank], text, a, b)
            if round(min(1, score), 6) >= 0.7:
                found.append((-min(1, score), a, rank, b))
    base, kept = brute(text), []
    for _, a, rank, b in sorted(found):
        every = base + kept
        if not any(r == rank and a < y and x < b or x <= a and b <= y for x, r, y in every):
            kept.append((a, rank, b))
    return sorted(base + kept)


def test_added_spans_match_brute_force():
    pick = random.Random(11)
    pieces = ["4111111111111111", "5500 0000 0000 0004", "4111-1111-1111-1111", "1234567890128", "(212) 555-0199", "212-555-0199", "078-05-1120", "666-05-1120", " card ", " visa ", " phone ", " call ", " ssn ", " order ", " ISBN ", " part ", " ", "7", "é", "-", ".", " words that fill the space between two spans so far that none is near "]
    n = 0
    for _ in range(5000):
        text = "".join(pick.choice(pieces) for _ in range(pick.randrange(1, 9)))
        want = brute_added(text)
        assert [(s.start, s.rank, s.end) for s in find(text)] == want, text
        n += len(want) - len(brute(text))
    assert n > 300


def test_account_numbers_stay_beside_card_numbers_in_them():
    code = next(c for k in range(10**6) if mod97(c := f"GB{k % 97 + 2:02d}NWBK{k:06d}31926819") and [s.kind for s in base_spans(c)] == ["card"])
    text = f"IBAN {code} ok"
    assert [s.kind for s in find(text)] == ["iban", "card"] and masked(text, find(text)) == "IBAN <IBAN> ok"


def test_context_lowers_and_raises():
    score = lambda t: {s.kind: s.score for s in find(t)}
    assert score("4111111111111111")["card"] == 0.8 and score("visa 4111111111111111")["card"] == 1.0 and score("order 4111111111111111")["card"] == 0.5
    assert "phone" in score("call (212) 555-0199") and "phone" not in score("call about order (212) 555-0199")


def test_secrets():
    assert [str(s) for s in find('x token = "2abc3ff2ca8fb1e4" y')] == ["secret:11:27"] and find('a token = "short"') == [] and find("token economy") == []


def test_masking():
    text = "é a@b.co, x 10.0.0.1!"
    assert masked(text, find(text)) == "é <EMAIL>, x <IP>!"


def test_long_texts_take_linear_time():
    for unit in ("a", "1", "1.", "a.", "+1", "1 ", "A1", "a@", "(1", 'token="', "212-555-0199 ", "4111111111111111 card "):
        find(unit * 100000)


def test_table(spark, messy, no_docs):
    extra = [(900, "mail a@b.co and b@c.de"), (901, None), (None, "10.0.0.1"), (902, ""), (900, "mail a@b.co and b@c.de")]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in extra], "doc_id long, text string, spans string, n_chars long")
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in detect(df).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    both = "email:5:11,email:16:22"
    assert got == Counter({(900, 2, 0, 0, 0, sha(both), both): 2, (901, 0, 0, 0, 0, sha(""), ""): 1, (902, 0, 0, 0, 0, sha(""), ""): 1, (None, 0, 1, 0, 0, sha("ip:0:8"), "ip:0:8"): 1})
    assert Counter(r.doc_id for r in detect(messy).collect()) == Counter(x[0] for x in messy_rows())
    assert detect(no_docs).collect() == redacted(no_docs).collect() == []
    out = {r.doc_id: r for r in redacted(df).collect()}
    assert out[900].text == "mail <EMAIL> and <EMAIL>" and out[900].n_chars == 24 and out[901].text is None and out[901].n_chars == 3
    assert Counter(map(tuple, redacted(messy).collect())) == Counter(messy_rows())
