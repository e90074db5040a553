import base64
import gzip
import hashlib
import io
from collections import Counter, defaultdict

import pytest

from arrowfen.llm import archive
from arrowfen.llm.archive import Capture, Target, arc_captures, arc_file, archived, converted, converted_files, member, opened, read_warc, record_id, resolved, warc_record, warc_records, write_warc

PAGES = "page_id long, url string, html string, record string, top long"


def rows():
    out = [(i, f"http://h{i}.example.org/a b\n{i}", f"<p>page {i % 7}</p>\r\n\r\nWARC/1.1 é \U0001f600") for i in range(30)]
    out += [(100 + i, None, "same") for i in range(40)] + [(200, "u", None), (201, "u", ""), (202, "", "x" * 300000), (None, "u", "same"), (None, None, None), (None, "v", "lonely"), (139, "again", "same"), (50, "u", "solo"), (50, "u", "solo")]
    return [(*r, "clash", 1) for r in out]


def brute(pages):
    group = defaultdict(list)
    for i, _, html, *_ in pages:
        group[html or ""].append(i)
    out = []
    for i, _, html, *_ in pages:
        data = (html or "").encode()
        ids = [x for x in group[html or ""] if x is not None]
        top = max(ids) if ids else None
        first = i == top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else top))
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip_matches_brute_force(spark, version):
    df = spark.createDataFrame(rows(), PAGES).repartition(3)
    assert Counter(map(tuple, archived(df, version).collect())) == Counter(brute(rows()))
    assert archived(df.where("false"), version).collect() == []


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame(rows(), PAGES)
    kinds = {r.page_id: r.record_type for r in archived(df, least_bytes=5).collect()}
    assert kinds[100] == "response" and kinds[0] == "revisit"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_is_read_by_its_declared_lengths(version):
    made = [Capture("http://a/%20", "1.2.3.4", "20200102030405", "text/html", b"one\n\nhttp://b 1 2 3 4\n"), Capture("http://b/", "-", "20200102030406", "text/plain", b""), Capture("c", "-", "20200102030406", "x/y", bytes(range(256)))]
    data = arc_file(made, version)
    assert list(arc_captures(data)) == made
    with pytest.raises(ValueError):
        list(arc_captures(data[:-20]))
    with pytest.raises(ValueError):
        list(arc_captures(data[data.index(b"http://a") :]))


def test_synthesised_headers():
    c = Capture("http://a/", "1.2.3.4", "20200102030405", "text/html", b"hi")
    (head, block), = warc_records(io.BytesIO(warc_record(c, record_id(7), 7)))
    assert head["WARC-Date"] == "2020-01-02T03:04:05Z" and head["WARC-Record-ID"] == record_id(7) and block.endswith(b"\r\n\r\nhi")
    assert head["WARC-Block-Digest"].removeprefix("sha1:") == base64.b32encode(hashlib.sha1(block).digest()).decode()
    (head, block), = warc_records(io.BytesIO(warc_record(c, record_id(8), 7, Target(record_id(7), "http://b/", "20190102030405"))))
    assert head["WARC-Type"] == "revisit" and head["WARC-Refers-To"] == record_id(7) and head["WARC-Refers-To-Target-URI"] == "http://b/"
    assert head["WARC-Refers-To-Date"] == "2019-01-02T03:04:05Z" and not block.endswith(b"hi")
    with pytest.raises(ValueError):
        list(warc_records(io.BytesIO(warc_record(c, "x")[:-3])))


def test_every_record_is_a_member_with_an_id_of_its_own(spark, tmp_path):
    df = spark.createDataFrame(rows(), PAGES).repartition(2)
    write_warc(converted(df), f"{tmp_path}/w")
    files = [p.read_bytes() for p in (tmp_path / "w").glob("part-*")]
    heads = [h for f in files for h, _ in warc_records(opened(f))]
    assert len(heads) == len(rows()) == len({h["WARC-Record-ID"] for h in heads})
    responses = {h["WARC-Record-ID"]: h for h in heads if h["WARC-Type"] == "response"}
    for h in heads:
        if h["WARC-Type"] == "revisit":
            to = responses[h["WARC-Refers-To"]]
            assert (to["WARC-Target-URI"], to["WARC-Date"], to["WARC-Payload-Digest"]) == (h["WARC-Refers-To-Target-URI"], h["WARC-Refers-To-Date"], h["WARC-Payload-Digest"])
    starts = 0
    for f in files:  # each member unpacked alone is one record
        while f:
            d = __import__("zlib").decompressobj(31)
            assert d.decompress(f).startswith(b"WARC/1.1") and d.eof
            f, starts = d.unused_data, starts + 1
    assert starts == len(heads)


def test_blocks_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(archive, "BLOCK_BYTES", 400)
    records = [bytes(pick % 251 for pick in range(k, k + 200)) for k in range(20)]
    blocks = list(archive._blocks(records))
    assert b"".join(gzip.decompress(b + b"\0") for b in blocks) == b"".join(records) and 4 < len(blocks) < 20


def test_members_end_with_a_zero():
    for n in (0, 5, (1 << 24) - 1, 1 << 24, 20 << 20):
        made = member(b"x" * n)
        assert made[-1] == 0 and gzip.decompress(made) == b"x" * n


def test_binary_arc_files_are_converted(spark, tmp_path):
    payloads = [bytes(range(256)) * 3, b"\x1f\x8b\xff", b"", "é".encode("latin-1")]
    made = [Capture(f"http://a/{k}", "1.2.3.4", "20200102030405", "image/png", p) for k, p in enumerate(payloads)]
    (tmp_path / "arcs").mkdir()
    (tmp_path / "arcs" / "one.arc").write_bytes(arc_file(made, 1))
    (tmp_path / "arcs" / "two.arc.gz").write_bytes(gzip.compress(arc_file(made[:2], 2)))
    write_warc(converted_files(spark, f"{tmp_path}/arcs"), f"{tmp_path}/warcs")
    got = resolved(read_warc(spark, f"{tmp_path}/warcs").cache()).collect()
    digests = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads]
    assert Counter((r.payload_bytes, r.payload_digest) for r in got) == Counter([*zip(map(len, payloads), digests), *zip(map(len, payloads[:2]), digests)])
    binary = spark.createDataFrame([(1, "u", payloads[0]), (2, "u", payloads[0])], "page_id long, url string, html binary")
    assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archived(binary).collect()} == {(1, 768, "revisit", 2), (2, 768, "response", None)}


def test_lost_responses_raise(spark):
    rows = [("a", 1, 5, "D", "response", None), ("b", 2, None, "D", "revisit", "a"), ("c", 3, None, "E", "revisit", "a")]
    df = spark.createDataFrame(rows, archive.READ)
    assert {tuple(r) for r in resolved(df.where("page_id < 3")).collect()} == {(1, 5, "D", "response", None), (2, 5, "D", "revisit", 1)}
    with pytest.raises(Exception, match="missing or differs"):
        resolved(df).collect()
