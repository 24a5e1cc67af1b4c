"""Legacy archives to WARC: writes ARC records, converts them, and reads the WARC archives back.

An ARC record is one header line of a version-specific set of fields, then as many bytes as the line declares, then a
line end.  The converter reads a segment of an ARC file (its version block first), checks the declared lengths, and
synthesises for each record the WARC equivalent: a record id derived from the record's place and bytes, a date from
the 14-digit one, a type, and SHA-1 digests of the block and of the payload behind the HTTP header.  A record whose
payload another record stands for becomes a revisit that refers to it.

Segments are bounded rows of archive bytes in the shared folder, so that any store Spark reaches can hold them.
"""

from __future__ import annotations

import base64
import hashlib
import string
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

#: Fixed values of the ARC format: the fields of a header line by version.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Fixed value of the WARC format: the profile of revisits by equal payload.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CRLF = b"\r\n"
#: Our extension fields: a row's id (HTTP), and the id of the row that holds a revisit's payload (WARC).
ROW, ORIGIN = "X-Archive-Row", "X-Archive-Origin"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _plain(value: str | None) -> str:
    """A header field is ASCII without white space: what isn't is percent-escaped, and nothing is a hyphen."""
    return quote(value or "-", safe=string.punctuation, errors="replace")


# ---------------------------------------------------------------- ARC

def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that begins an ARC file."""
    body = f"{version} 0 tidemark\n{' '.join(FIELDS[version])}\n".encode()
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", body)


def arc_record(version: int, url: str | None, ip: str, date: str, kind: str, body: bytes, code: int = 200, offset: int = 0, name: str = "-") -> bytes:
    fields = [_plain(url), ip, date, kind]
    if version == 2:
        fields += [str(code), "-", "-", str(offset), name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, body) of each record behind the version block; raises ValueError on what breaks the format."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # writers differ in the line ends between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at {at}")
        parts = data[at:end].decode("latin-1").rstrip("\r").split(" ")
        head = version is None
        if head:  # the block itself has the short line in version 1 and may have the long one in version 2
            if not parts[0].startswith("filedesc:"):
                raise ValueError("no version block")
            names = FIELDS[1] if len(parts) == len(FIELDS[1]) else FIELDS[2]
        else:
            names = FIELDS[version]
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"header line at {at} has {len(parts)} fields")
        n = int(parts[-1])
        body = data[end + 1 : end + 1 + n]
        if len(body) != n:
            raise ValueError(f"record at {at} declares {n} bytes and has {len(body)}")
        if head:
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown version {version}")
        else:
            yield dict(zip(names, parts)), body
        at = end + 1 + n


# ---------------------------------------------------------------- WARC

def http_payload(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP header, payload) of a block; all of it is payload if there is no header."""
    if block.startswith(b"HTTP/"):
        cut = block.find(CRLF + CRLF)
        if cut >= 0:
            return block[: cut + 4], block[cut + 4 :]
    return b"", block


def http_fields(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)


def record_id(row: str | None, fields: dict[str, str], body: bytes) -> str:
    """Derived from the row's id, or else from the record's bytes: the same, run after run."""
    name = f"row:{row}" if row is not None else " ".join(fields.values()) + digest(body)
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>"


def to_warc(fields: dict[str, str], body: bytes, origin: int | None = None) -> bytes:
    """The WARC equivalent of an ARC record; a record whose payload row ``origin`` holds becomes a revisit of that."""
    d = fields["Archive-date"].ljust(14, "0")
    head, payload = http_payload(body)
    block = body if origin is None else head
    row = http_fields(head).get(ROW)
    lines = [
        ("WARC-Type", "revisit" if origin is not None else "response" if head else "resource"),
        ("WARC-Record-ID", record_id(row, fields, body)), ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
        ("WARC-Target-URI", fields["URL"]), ("WARC-IP-Address", fields["IP-address"]),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("WARC-Block-Digest", "sha1:" + digest(block)),
    ]
    if origin is not None:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(str(origin), {}, b"")), (ORIGIN, str(origin))]
    lines += [("Content-Type", "application/http;msgtype=response" if head else fields["Content-type"]), ("Content-Length", str(len(block)))]
    return b"WARC/1.1" + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in lines) + CRLF + block + CRLF + CRLF


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record; raises ValueError on what breaks the format."""
    at = 0
    while at < len(data):
        end = data.find(CRLF + CRLF, at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != CRLF + CRLF:
            raise ValueError(f"record at {at} is cut short")
        if fields.get("WARC-Block-Digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
            raise ValueError(f"record at {at} fails its digest")
        yield fields, block
        at = end + 8 + n


# ---------------------------------------------------------------- tables

def _convert(version: int, date: str, segment: int):
    """Pages to ARC segments to WARC segments of about ``segment`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(arc: list[bytes], origins: list[int | None]) -> pa.RecordBatch:
            warc = b"".join(to_warc(f, b, o) for (f, b), o in zip(read_arc(b"".join(arc)), origins, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([warc], pa.binary()), pa.array([len(origins)], pa.int64())], names=["archive", "records"])

        arc, origins, size = [arc_head(version, "pages.arc", date)], [], 0
        for batch in batches:
            for page, url, body, origin in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "body", "origin"))):
                body = body or b""
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(body)}\r\n{ROW}: {'-' if page is None else page}\r\n\r\n".encode()
                arc.append(arc_record(version, url, "0.0.0.0", date, "text/html", head + body, offset=size))
                origins.append(origin)
                size += len(arc[-1])
                if size >= segment:
                    yield flush(arc, origins)
                    arc, origins, size = arc[:1], [], 0
        if origins:
            yield flush(arc, origins)

    return run


def write_archives(pages: DataFrame, version: int = 2, date: str = "20200101000000", segment: int = 8 << 20, least: int = 0) -> DataFrame:
    """WARC segments (archive, records) of ``pages`` (page_id, url, html), by way of ARC, in the shared folder.

    Of rows with equal payloads of at least ``least`` bytes that with the largest page_id is written whole, the others
    as revisits of it.  A null page is empty and a null url a hyphen; a null page_id comes before all others, and rows
    of a payload that have no page_id at all stay whole.  Rows that repeat the largest id and its payload are all
    whole.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("string").cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    key = rows.select("page_id", F.sha1("body").alias("key"), F.octet_length("body").alias("size"))
    owner = key.where(F.col("size") >= least).groupBy("key").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    # owners of payloads that occur once are not kept; a hot payload is combined before, its rows split by the skew join
    found = rows.withColumn("key", F.when(F.octet_length("body") >= least, F.sha1("body"))).join(owner, "key", "left")
    found = found.withColumn("origin", F.when(F.col("owner") != F.col("page_id"), F.col("owner")).when(F.col("page_id").isNull(), F.col("owner")))
    return materialise(found.select("page_id", "url", "body", "origin").mapInArrow(_convert(version, date, segment), "archive binary, records long"), "warc")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("archive").to_pylist():
            out = []
            for f, block in read_warc(data):
                head, _ = http_payload(block)
                http, to = http_fields(head), f.get(ORIGIN)
                out.append((None if http[ROW] == "-" else int(http[ROW]), int(http["Content-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], int(to) if to else None, f["WARC-Record-ID"], f["WARC-Target-URI"], f["WARC-Date"]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "warc_date"])


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of WARC segments."""
    return archives.select("archive").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, warc_date string")


def archive_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) written to archives and read back: a row per page.

    A null html is an empty payload and a null url is ``-``; a page with a null page_id is a response if no page of
    the payload has an identifier, and else revisits the one with the largest; rows repeated with that largest
    identifier are responses each; an empty table gives no rows; other columns are not read.
    """
    return read_archives(write_archives(pages))
