"""Web archives: a converter from legacy ARC to WARC, and a writer and reader of WARC files.

An ARC file begins with a version block, whose second line names the version
and third line the fields of each record's header line. The converter reads
each header line by that version and as many bytes as it declares, and
synthesises the WARC record's identifier, timestamp, type and digests.

WARC files have one gzip member for each record. Spark's own text writer writes
them, to any file system that it knows: its lines are blocks of members without
their last byte, which is the zero of the last member's size, and its line
separator is that byte.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import parts
from .joins import beside
from .scratch import new_path, stored

# The header fields of the two ARC versions and the revisit profile.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
END = b"\r\n\r\n"
#: Bytes of compressed records that one block holds, about, and blocks of a file: a file has 64 MB, or a single larger record more.
BLOCK_BYTES, FILE_BLOCKS = 8 << 20, 8
#: The first size whose fourth byte isn't zero; a member of that size is followed by an empty one.
WIDE = 1 << 24


class Capture(NamedTuple):
    """One captured resource, whatever the format."""

    url: str
    ip: str
    date: str  # 14 digits
    mime: str
    payload: bytes


def _word(value: str | None, none: str = "-") -> str:
    """A header field: white space and control characters would end it."""
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value or "") or none


def arc_file(captures: list[Capture], version: int = 1, name: str = "captures.arc") -> bytes:
    """An ARC file of the given version."""
    block = f"{version} 0 arrowfen\n{FIELDS[version]}\n\n".encode()
    date = captures[0].date if captures else "19700101000000"
    head = [f"filedesc://{_word(name)}", "0.0.0.0", date, "text/plain"]
    parts = [" ".join([*head, *(["200", "-", "-", "0", _word(name)] if version == 2 else []), str(len(block))]).encode() + b"\n" + block]
    offset = len(parts[0])
    for c in captures:
        head = [_word(c.url), _word(c.ip), c.date, _word(c.mime)]
        if version == 2:
            head += ["200", "-", "-", str(offset), _word(name)]
        parts.append(" ".join([*head, str(len(c.payload))]).encode() + b"\n" + c.payload + b"\n")
        offset += len(parts[-1])
    return b"".join(parts)


def arc_captures(data: bytes) -> Iterator[Capture]:
    """The captures of an ARC file, read by its version and the declared lengths."""
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line at byte {at} doesn't end")
        values = data[at:end].decode().split(" ")
        if fields is None and not values[0].startswith("filedesc://"):
            raise ValueError("an ARC file begins with its version block")
        length = int(values[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"ARC record at byte {at} is cut off")
        at = end + 1 + length
        if fields is None:
            version, names = body.decode().split("\n")[:2]
            fields = names.split(" ")
            if names != FIELDS.get(int(version.split(" ")[0])):
                raise ValueError(f"unknown ARC version {version!r}")
            continue
        if len(values) != len(fields):
            raise ValueError(f"ARC header has {len(values)} fields, not {len(fields)}")
        named = dict(zip(fields, values))
        yield Capture(named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"], body)
        if data[at : at + 1] == b"\n":
            at += 1


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*what: object) -> str:
    """An identifier that the same ``what`` always gets."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(10).join(map(str, what)))}>"


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


class Target(NamedTuple):
    """The response that a revisit stands for."""

    id: str
    url: str
    date: str  # 14 digits


def warc_record(c: Capture, id: str, page: int | None = None, target: Target | None = None) -> bytes:
    """A capture as a WARC record, its end mark included. ``target`` makes it a revisit, which has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: %s\r\nContent-Length: %d" % (c.mime.encode(), len(c.payload)) + END
    body = http if target else http + c.payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if target else 'response'}", f"WARC-Record-ID: {id}", f"WARC-Date: {warc_date(c.date)}",
        f"WARC-Target-URI: {c.url}", f"WARC-IP-Address: {c.ip}", f"WARC-Payload-Digest: sha1:{digest(c.payload)}",
        f"WARC-Block-Digest: sha1:{digest(body)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    if target:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {target.id}", f"WARC-Refers-To-Target-URI: {target.url}", f"WARC-Refers-To-Date: {warc_date(target.date)}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")  # the table's own key, for which WARC has no field
    return "\r\n".join(head).encode() + END + body + END


def member(record: bytes) -> bytes:
    """A record as gzip whose last byte is zero."""
    made = gzip.compress(record, 6, mtime=0)
    return made + gzip.compress(b"", mtime=0) if len(record) % (1 << 32) >= WIDE else made


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream, read by the declared lengths, one at a time."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(": ")
            head[name] = value.rstrip("\r\n")
        block = stream.read(int(head["Content-Length"]))
        if len(block) < int(head["Content-Length"]) or stream.read(4) != END:
            raise ValueError(f"WARC record {head.get('WARC-Record-ID')} is cut off")
        yield head, block


def opened(data: bytes) -> BinaryIO:
    """A WARC file's bytes as a stream, gzipped or not."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def _blocks(records: Iterable[bytes]) -> Iterator[bytes]:
    """Gzipped records put together to blocks, each without its last byte."""
    held, size = [], 0
    for record in records:
        held.append(member(record))
        size += len(held[-1])
        if size >= BLOCK_BYTES:
            yield b"".join(held)[:-1]
            held, size = [], 0
    if held:
        yield b"".join(held)[:-1]


def _block_batches(records: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(records):
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])


def converted(pages: DataFrame, date: str = "20240101000000", version: int = 1, least_bytes: int = 0) -> DataFrame:
    """(block) of ``pages`` (page_id, url, html string or binary): the pages as ARC captures, converted to WARC.

    Pages are put into ARC files of many records, read back from these by
    version and declared lengths, and become one WARC record each. Of equal
    payloads of ``least_bytes`` or more the one with the largest page_id is a
    response, the others revisit it; where rows repeat that id, each is a
    response and the first one stored is referred to. Without any page_id all
    are responses. Null html is an empty payload, a null url ``-``; payloads
    are kept whole, however long; an empty table gives no blocks.
    """
    html = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha"), F.monotonically_increasing_id().alias("serial"))
    held = stored(rows)  # serials must stay as they are
    big = F.octet_length("html") >= least_bytes
    first = F.max_by(F.struct("serial", "url"), F.struct("page_id", -F.col("serial")))
    copies = held.where(big & F.col("page_id").isNotNull()).groupBy("sha").agg(F.max("page_id").alias("top"), first.alias("t"))
    shared = held.where(big).groupBy("sha").agg(F.count("*").alias("n")).where("n > 1").select("sha")
    copies = stored(copies.join(shared, "sha").select("sha", "top", F.col("t.serial").alias("t_serial"), F.col("t.url").alias("t_url")))
    keyed = beside(held, copies, F.coalesce(F.octet_length("t_url"), F.lit(0)) + 60, ["sha"])
    refers = F.col("top").isNotNull() & big & ~F.col("page_id").eqNullSafe(F.col("top"))

    def records(batch: pa.RecordBatch) -> Iterator[bytes]:
        rows = batch.to_pylist()
        archive = arc_file([Capture(r["url"] or "", "0.0.0.0", date, "text/html", r["html"]) for r in rows], version)
        for r, c in zip(rows, arc_captures(archive), strict=True):
            target = Target(record_id(r["t_serial"], _word(r["t_url"])), _word(r["t_url"]), date) if r["refers"] else None
            yield warc_record(c, record_id(r["serial"], c.url), r["page_id"], target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _block_batches(record for batch in parts(batches, 2) for record in records(batch))

    return keyed.select("page_id", "url", "html", "serial", "t_serial", "t_url", refers.alias("refers")).mapInArrow(run, "block binary")


def converted_files(spark: SparkSession, path: str) -> DataFrame:
    """(block) of all captures of the ARC files at ``path``, gzipped or not, as WARC responses; payloads of any bytes stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns):
                data = content.as_py()
                captures = arc_captures(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
                yield from _block_batches(warc_record(c, record_id(name, k, c.url)) for k, c in enumerate(captures))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "block binary")


def write_warc(blocks: DataFrame, path: str) -> None:
    """WARC files of a table (block) of gzipped records, as ``converted`` makes them.

    Blocks are bounded by bytes, files by their number of blocks. Null blocks
    are left out; equal ones are written again; an empty table gives a folder
    without records.
    """
    lines = blocks.where("block is not null").select(F.col("block").cast("string").alias("value"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_BLOCKS).text(path)


READ = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to_id string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, payload_bytes, payload_digest, record_type, refers_to_id) of the records of WARC files.

    Files are unpacked record by record. A response's payload is checked
    against the digest that it declares; a revisit has none, so its
    payload_bytes are null. Records without a page's key have a null page_id;
    empty files have no records; one that is cut off raises.
    """
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [c.split()[0] for c in READ.split(", ")]

    def rows(data: bytes) -> Iterator[tuple]:
        for head, block in warc_records(opened(data)):
            kind, said, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), None
            if kind == "response":
                payload = block[block.index(END) + 4 :]
                size = len(payload)
                if digest(payload) != said:
                    raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
            page = head.get("X-Page-ID")
            yield head["WARC-Record-ID"], None if page is None else int(page), size, said, kind, head.get("WARC-Refers-To")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                if found := list(rows(value.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``read_warc``'s table, stored.

    A revisit takes its payload's bytes from the response that it refers to by
    record id; one whose response is missing or has another digest raises.
    """
    asked = records.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("record_id")).distinct()
    found = records.where("record_type = 'response'").join(asked, "record_id")
    known = stored(found.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d")))
    both = beside(records, known, F.lit(110), ["refers_to_id"])
    lost = (F.col("record_type") == "revisit") & ~F.col("payload_digest").eqNullSafe(F.col("d"))
    size = F.when(lost, F.raise_error(F.lit("a revisit's response is missing or differs")).cast("long")).otherwise(F.coalesce("payload_bytes", "n"))
    return both.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", F.col("to").alias("refers_to"))


def archived(pages: DataFrame, version: int = 1, least_bytes: int = 0) -> DataFrame:
    """Every row of ``pages`` converted, written as WARC files to the shared folder, read back and resolved.

    A null html is an empty payload; a null url is written as ``-``. Repeated
    rows and null ids are archived like any other, each with a record id of its
    own; payloads are kept whole; an empty table gives an empty table.
    """
    path = new_path(pages.sparkSession)
    write_warc(converted(pages, version=version, least_bytes=least_bytes), path)
    return resolved(stored(read_warc(pages.sparkSession, path)))
