"""WARC: a converter of legacy ARC archives, and readers and writers of both.

An ARC archive begins with a filedesc record whose version block names the fields of all
header lines: five for version 1, ten for version 2, the last always the declared length.
Each record's content is exactly that long. The converter reads the fields by version, tells
the HTTP header from the payload, and synthesises what a WARC record of the
capture has: a name-based record id, an ISO timestamp, a type and base32 SHA-1 digests. The
content itself, HTTP header included, is carried over byte for byte; what is no HTTP message
becomes a resource. Of HTTP records with equal payloads one becomes a response, the others
revisits of it, which keep their header. Damaged archives are errors unless asked otherwise.

Plan. Archives are files of bounded size in the shared folder, compressed as a whole (ARC)
or record by record (WARC), one archive per row of Spark's text sink, so any store that Spark can write will do
(its line end, a NUL, is padding that gzip readers skip); they are read with the binaryFile
source and parsed by declared lengths, never by looking for separators. Which record of a
payload is the response comes from ids and digests alone: a max by digest, combined before
the shuffle, then a join of the small rows, whose hot digests adaptive execution splits.
The verdicts are gathered by archive, which bounds them, and meet the compressed archives,
not the single payloads.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from hashlib import sha1
from typing import NamedTuple
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import shared_path

#: Bytes of an archive before compression; those of an Arrow batch of records.
ARCHIVE_BYTES, BATCH_BYTES, MIN_REVISIT_BYTES = 8 << 20, 4 << 20, 0
#: Speed of compression (zlib's 1 to 9), and bytes that are fed to a member at a time.
LEVEL, FEED = 4, 1 << 14
#: The fields of ARC header lines by version.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD = "page_id long, url string, warc_date string, mime string, status int, record_id string, payload_bytes long, payload_digest string, payload binary, path string, ip string, head binary"
_RECORD_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.binary()]


class Capture(NamedTuple):
    """A record of an ARC archive; head is its HTTP header with the empty line, None without HTTP."""

    page_id: int | None
    url: str
    warc_date: str
    mime: str
    status: int | None
    record_id: str
    payload_bytes: int
    payload_digest: str
    payload: bytes | None
    path: str
    ip: str
    head: bytes | None


def digest(data: bytes) -> str:
    return base64.b32encode(sha1(data).digest()).decode()


def _url(url: str | None) -> str:
    """A URL as a header field: never empty, blanks and control characters escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "unknown:"


def _http(page_id: int | None, payload: bytes) -> bytes:
    known = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}Content-Length: {len(payload)}\r\n\r\n".encode()


def arc_version_block(version: str, name: str) -> bytes:
    block = f"{version} 0 topograin\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    start = f"filedesc://{name} 0.0.0.0 20240101000000 text/plain"
    return f"{start}{'' if version == '1' else ' 200 - - 0 ' + name} {len(block)}\n".encode() + block + b"\n"


def arc_record(version: str, name: str, offset: int, page_id: int | None, url: str | None, date: str, payload: bytes) -> bytes:
    body = _http(page_id, payload) + payload
    middle = "" if version == "1" else f" 200 {digest(payload)} - {offset} {name}"
    return f"{_url(url)} 0.0.0.0 {date} text/html{middle} {len(body)}\n".encode() + body + b"\n"


def parse_arc(data: bytes, damaged: str = "stop") -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(fields, offset, content) of each record; the filedesc record, anywhere, sets the version.

    An unknown version and a malformed header line are errors. A last record that is cut off
    ends the archive, or is an error where damaged is "raise".
    """
    at, fields = 0, ARC_FIELDS["1"]
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        stop = data.find(b"\n", at)
        if stop < 0:
            if data[at:].strip(b"\0\r\n ") and damaged == "raise":
                raise ValueError(f"ARC record at {at} is cut off in its header line")
            return
        line = data[at:stop].decode("utf-8", "replace").rstrip("\r")
        # only a URL may hold blanks: fields count from the right
        parts = line.rsplit(" ", len(fields) - 1)
        length = parts[-1]
        known = line.startswith("filedesc://") or len(parts) == len(fields)
        if not known or not (length.isascii() and length.isdigit()):
            raise ValueError(f"ARC header line at {at} is malformed: {line[:200]!r}")
        if stop + 1 + int(length) > len(data):
            if damaged == "raise":
                raise ValueError(f"ARC record at {at} is cut off: {length} bytes are declared, {len(data) - stop - 1} there")
            return
        content = data[stop + 1 : stop + 1 + int(length)]
        if line.startswith("filedesc://"):
            version = content.split(b" ", 1)[0].decode("utf-8", "replace")
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version!r} is unknown")
            fields = ARC_FIELDS[version]
        else:
            yield dict(zip(fields, parts)), at, content
        at = stop + 1 + int(length)


def _http_parts(content: bytes) -> tuple[int | None, dict[str, str], bytes | None, bytes]:
    """Status, headers by lower-case name, header bytes with the empty line (None without HTTP), payload."""
    if not content.startswith(b"HTTP/"):
        return None, {}, None, content
    ends = [(at, len(gap)) for gap in (b"\r\n\r\n", b"\n\n") if (at := content.find(gap)) >= 0]
    cut = sum(min(ends)) if ends else len(content)
    lines = content[:cut].decode("utf-8", "replace").splitlines()
    status = (lines[0].split(" ") + [""])[1]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()}
    return int(status) if status.isascii() and status.isdigit() and len(status) < 6 else None, headers, content[:cut], content[cut:]


def arc_date(seconds: int) -> str:
    """Seconds since 1970 as 14 digits, UTC; the start of 1970 for what no such date tells."""
    try:
        d = datetime.fromtimestamp(seconds, UTC)
    except (ValueError, OverflowError, OSError):
        d = datetime.fromtimestamp(0, UTC)
    return f"{d.year:04d}{d:%m%d%H%M%S}"


def iso_date(arc_date: str) -> str:
    """A 14 digit ARC date, or the start of one, as a WARC date."""
    digits = re.sub(r"\D", "", arc_date)[:14]
    digits += "19700101000000"[len(digits) :]
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _gunzip(data: bytes) -> bytes:
    """All members of a gzip file, padding left out, or the bytes themselves."""
    out, at = [], 0
    while data[at : at + 2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        while not d.eof and at < len(data):
            piece = data[at : at + FEED]
            out.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
    return b"".join(out) if at else data


def _archives(rows: DataFrame, name: str, kind: Callable[[int], tuple], archive_bytes: int, records: Callable = lambda *row: (row,), members: bool = True) -> str:
    """Writes archives of about archive_bytes; records(*row) makes what records tell of,
    kind(n) the nth archive's opening bytes and a function from that and an offset to a
    record's bytes. With members each record is compressed on its own, else the archive as
    a whole."""
    packed = _member if members else bytes
    width = len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, size = 0, [], 0
        open_, record = kind(0)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held) if members else _member(b"".join(held))], pa.binary())], ["value"])

        for batch in batches:
            for row in (x for k in range(batch.num_rows) for x in records(*(batch.column(i)[k].as_py() for i in range(width)))):
                if not held:
                    held, size = [packed(open_)], len(open_)
                data = record(row, size)
                held.append(packed(data))
                size += len(data)
                if size >= archive_bytes:
                    yield out()
                    n, held = n + 1, []
                    open_, record = kind(n)
        if held:
            yield out()

    path = shared_path(rows.sparkSession, name)
    archives = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", "\0").text(path)
    return path


def write_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: Column | None = None, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Legacy archives of pages, versions 1 and 2 in turn; the folder's path."""

    def kind(n: int) -> tuple:
        version, name = str(n % 2 + 1), f"archive-{n}.arc"
        return arc_version_block(version, name), lambda row, at: arc_record(version, name, at, row[0], row[1], arc_date(row[2]), row[3])

    # seconds, which no session time zone moves
    stamp = F.lit(1_704_067_200).cast("long") if date is None else F.coalesce(F.unix_seconds(date.cast("timestamp")), F.lit(0))
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    return _archives(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), stamp, payload), "arc", kind, archive_bytes, members=False)


def _files(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.format("binaryFile").load(path).select("path", "content")


def arc_rows(data: bytes, path: str, payloads: bool = True, damaged: str = "raise") -> Iterator[Capture]:
    """The records of an archive, as read_arc has them."""
    try:
        for fields, offset, content in parse_arc(_gunzip(data), damaged):
            status, headers, head, payload = _http_parts(content)
            code, page, of = fields.get("Result-code", ""), headers.get("x-page-id", ""), digest(payload)
            name = f"{fields['URL']} {fields['Archive-date']} {of} {path.rpartition('/')[2]} {offset}"
            yield Capture(
                int(page) if re.fullmatch(r"-?[0-9]{1,18}", page) else None, fields["URL"], iso_date(fields["Archive-date"]), fields["Content-type"], int(code) if re.fullmatch("[0-9]{1,5}", code) else status,
                f"<urn:uuid:{uuid5(NAMESPACE_URL, name)}>", len(payload), of, payload if payloads else None, path, fields["IP-address"], head,
            )
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e


def read_arc(files: DataFrame, payloads: bool = True, damaged: str = "raise") -> DataFrame:
    """Records of ARC files (path, content): page_id (from an X-Page-Id header, else null), url,
    warc_date, mime, status, record_id, payload_bytes, payload_digest, payload (null without
    payloads), path, ip and head (the HTTP header; null without HTTP).

    damaged: "raise", or "stop" to read an archive that is cut off as far as it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for row in arc_rows(batch.column(1)[i].as_py(), batch.column(0)[i].as_py(), payloads, damaged):
                    rows.append(row)
                    size += row.payload_bytes + 100 if payloads else 100
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _RECORD_TYPES)], [x.split()[0] for x in RECORD.split(", ")])


def typed(index: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(path, record_id, to_page, to_record, to_url, to_date) of the records that are revisits.

    Of HTTP records with equal payloads of at least min_revisit_bytes that with the greatest
    page_id, then record id, is the response.
    """
    long_enough = index.where(F.col("head").isNotNull() & (F.col("payload_bytes") >= min_revisit_bytes)).drop("head")
    best = long_enough.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("page_id", "record_id", "url", "warc_date")).alias("r"), F.count("*").alias("n")).where("n > 1")
    found = long_enough.select("path", "record_id", "payload_digest", "payload_bytes").join(best, ["payload_digest", "payload_bytes"])
    return found.where("record_id <> r.record_id").select("path", "record_id", F.col("r.page_id").alias("to_page"), F.col("r.record_id").alias("to_record"), F.col("r.url").alias("to_url"), F.col("r.warc_date").alias("to_date"))


def _warc(kind: str, record_id: str, date: str, more: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *more, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_record(row: Capture, to: dict | None) -> bytes:
    """The WARC record of a capture; to: what it revisits."""
    more: list[tuple[str, object]] = [("WARC-Target-URI", row.url), ("WARC-Payload-Digest", f"sha1:{row.payload_digest}")]
    if row.mime and " " not in row.mime:
        more.append(("WARC-Identified-Payload-Type", row.mime))
    if row.ip not in ("", "-", "0.0.0.0"):
        more.append(("WARC-IP-Address", row.ip))
    # fields of our own: what a revisit, which has no payload, could not tell else
    more += [("X-Payload-Length", row.payload_bytes), *([] if row.page_id is None else [("X-Page-Id", row.page_id)])]
    if to:
        more += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", to["to_record"]), ("WARC-Refers-To-Target-URI", to["to_url"]), ("WARC-Refers-To-Date", to["to_date"])]
        more += [] if to["to_page"] is None else [("X-Refers-To-Page-Id", to["to_page"])]
    block = (row.head or b"") + (b"" if to else row.payload or b"")
    http = row.head is not None
    more += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response" if http else row.mime or "application/octet-stream")]
    return _warc("revisit" if to else "response" if http else "resource", row.record_id, row.warc_date, more, block)


def convert(arc_path: str, spark_df: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, damaged: str = "raise") -> str:
    """Converts all ARC archives under a path to WARC archives; the new folder's path.

    spark_df is any DataFrame of the session. damaged as in read_arc.
    """
    files = _files(spark_df, arc_path)
    revisits = typed(read_arc(files, payloads=False, damaged=damaged), min_revisit_bytes)
    verdicts = revisits.groupBy("path").agg(F.collect_list(F.struct("record_id", "to_page", "to_record", "to_url", "to_date")).alias("revisits"))

    def records(path: str, content: bytes, revisits: list[dict] | None) -> Iterator[tuple]:
        to = {r["record_id"]: r for r in revisits or ()}
        for row in arc_rows(content, path, damaged=damaged):
            yield row, to.get(row.record_id)

    def kind(n: int) -> tuple:
        info = b"software: topograin\r\nformat: WARC file version 1.1\r\n"
        return _warc("warcinfo", f"<urn:uuid:{uuid5(NAMESPACE_URL, f'warcinfo {n}')}>", "2024-01-01T00:00:00Z", [("Content-Type", "application/warc-fields")], info), lambda row, at: warc_record(*row)

    return _archives(files.join(verdicts, "path", "left").select("path", "content", "revisits"), "warc", kind, archive_bytes, records)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, lower-case names; block) of each record, by Content-Length. What is no record is an error."""
    at = 0
    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 and not data[at:].strip(b"\0\r\n"):
            return
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"WARC record at {at} is damaged")
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = stop + 4 + int(headers["content-length"])
        if at > len(data):
            raise ValueError(f"WARC record {headers.get('warc-record-id')} is cut off")
        yield headers, data[stop + 4 : at]


def read_warc(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Captures of WARC files (path, content): page_id, payload_bytes, payload_digest, record_type
    (response, revisit or resource), refers_to, record_id, url, warc_date, payload (null for
    revisits, or without payloads).

    A payload's digest is computed anew and must be the one that its header has. A revisit's
    payload length is that of its X-Payload-Length or else its Content-Length header, or null.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "warc_date", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for headers, block in parse_warc(_gunzip(batch.column(1)[i].as_py())):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    _, http, _, payload = _http_parts(block) if kind != "resource" else (None, {}, None, block)
                    of = headers["warc-payload-digest"].removeprefix("sha1:")
                    if digest(block) != headers["warc-block-digest"].removeprefix("sha1:") or kind != "revisit" and digest(payload) != of:
                        raise ValueError(f"record {headers['warc-record-id']} is damaged")
                    page, to = headers.get("x-page-id") or http.get("x-page-id"), headers.get("x-refers-to-page-id")
                    length = headers.get("x-payload-length") or http.get("content-length")
                    rows.append((int(page) if page else None, len(payload) if kind != "revisit" else int(length) if length else None, of, kind, int(to) if to else None, headers["warc-record-id"], headers["warc-target-uri"], headers["warc-date"], payload if kind != "revisit" and payloads else None))
                    size += len(payload) if payloads else 100
                    if size >= BATCH_BYTES:
                        yield out()
                        rows, size = [], 0
                if rows:
                    yield out()

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, warc_date string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: Column | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, payloads: bool = True) -> DataFrame:
    """Pages written as ARC, converted to WARC, and read back: the rows of read_warc.

    A null page is an empty one, null ids stay null, and repeated rows are records of their own.
    An empty table gives none.
    """
    arc = write_arc(pages, id_col, url_col, html_col, date, archive_bytes)
    return read_warc(_files(pages, convert(arc, pages, min_revisit_bytes, archive_bytes)), payloads)
