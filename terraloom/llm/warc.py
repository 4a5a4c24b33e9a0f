"""Converter of legacy ARC archives into WARC.

ARC files open with a version block ("filedesc://"): version 1 header lines have five fields, version 2 has ten. A
record's extent is its declared length. The converter synthesises what WARC asks for and ARC lacks: record identifiers
(from url, date and payload digest, so reruns agree), ISO dates, record types and digests. Payloads that occurred before
become revisit records.

All files are read and written by Spark's own readers and writers, on whatever store the shared folder is.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import shared_path, table

#: Fields of the header line by version.
ARC_FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"],
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REVISIT_LEAST = 100
CAPTURED = "20200101000000"
SEGMENT_BYTES = 4 << 20
#: Segments of at most SEGMENT_BYTES (or one record) in a file.
SEGMENTS_PER_FILE = 4


def arc_url(url: str | None) -> str:
    """A url fit for a header line: white space and control characters percent-encoded; null gives a placeholder."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def arc_record(version: int, url: str | None, page_id: int | None, payload: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"url": arc_url(url), "ip": "0.0.0.0", "date": CAPTURED, "type": "text/html", "code": "200", "checksum": "-", "location": "-", "offset": "0", "filename": "pages.arc", "length": str(len(head) + len(payload))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode("utf-8", "surrogatepass") + b"\n" + head + payload + b"\n"


def arc_opening(version: int) -> bytes:
    block = f"{version} 0 terraloom\n{ARC_TITLES[version]}\n\n".encode()
    fields = {"url": "filedesc://pages.arc", "ip": "0.0.0.0", "date": CAPTURED, "type": "text/plain", "code": "200", "checksum": "-", "location": "-", "offset": "0", "filename": "pages.arc", "length": str(len(block))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block + b"\n"


class Pieces:
    """Reads lines and stretches of an archive, plain or gzip of any number of members, a piece at a time."""

    def __init__(self, data: bytes, size: int = 1 << 16) -> None:
        self.parts, self.held, self.at = self._inflate(data, size), b"", 0

    @staticmethod
    def _inflate(data: bytes, size: int) -> Iterator[bytes]:
        view = memoryview(data)
        if data[:2] != b"\x1f\x8b":
            yield from (bytes(view[at : at + size]) for at in range(0, len(data), size))
            return
        at = 0
        while at < len(data):
            member = zlib.decompressobj(31)
            while not member.eof:
                rest = bytes(view[at : at + size])
                if not rest:
                    raise ValueError("a gzip member is cut short")
                yield member.decompress(rest)
                at += len(rest) - len(member.unused_data)
            while at < len(data) and data[at] == 0:  # padding between members
                at += 1

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.held, self.at = self.held[self.at :] + part, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes up to and with the mark; None at the end of the archive."""
        seen = 0
        while True:
            found = self.held.find(mark, self.at + seen)
            if found >= 0:
                out = self.held[self.at : found + len(mark)]
                self.at = found + len(mark)
                return out
            seen = max(len(self.held) - self.at - len(mark) + 1, 0)
            if not self._more():
                if self.at < len(self.held):
                    raise ValueError(f"not followed by {mark!r}: {self.held[self.at : self.at + 60]!r}")
                return None

    def take(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            if self.at == len(self.held) and not self._more():
                raise ValueError("a record is cut short")
            part = self.held[self.at : self.at + n - have]
            self.at += len(part)
            have += len(part)
            parts.append(part)
        return b"".join(parts)

    def skip(self, symbols: bytes) -> None:
        """Moves past any of these bytes."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in symbols:
                self.at += 1
            if self.at < len(self.held) or not self._more():
                return


def arc_fields(line: str, version: int) -> dict:
    """The fields of a header line. The content type may hold blanks: it is what the fields to both sides leave."""
    names, words = ARC_FIELDS[version], line.split(" ")
    after = len(names) - names.index("type") - 1
    if len(words) < len(names) or not words[-1].isdigit():
        raise ValueError(f"not a header line of ARC version {version}: {words[:3]}")
    left = len(names) - after - 1
    return dict(zip(names, [*words[:left], " ".join(words[left : len(words) - after]), *words[len(words) - after :]], strict=True))


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload). A body that isn't HTTP has no head, a head without an end no payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = re.search(rb"\r?\n\r?\n", body)
    return (body[: end.end()], body[end.end() :]) if end else (body, b"")


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file, or of several one after the other, gzip or not. Raises ValueError on a line that no version explains."""
    pieces, version = Pieces(data), 1
    while True:
        pieces.skip(b"\r\n")  # between records
        line = pieces.until(b"\n")
        if line is None:
            return
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if text.startswith("filedesc://"):
            # the block names the version of its own header line too
            body = pieces.take(int(text.rsplit(" ", 1)[-1]))
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            continue
        fields = arc_fields(text, version)
        head, payload = http_parts(pieces.take(int(fields["length"])))
        yield fields | {"head": head, "payload": payload}


def header_value(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() or None if found else None


def page_number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,19}", text) else None


def warc_date(arc_date: str) -> str:
    d = (re.sub(r"\D", "", arc_date) + "00000101000000"[len(re.sub(r"\D", "", arc_date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(page_id: int | None, url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {date} {digest}')}>"


def warc_lines(kind: str, own_id: str, date: str, block: bytes, content_type: str, more: list[str]) -> bytes:
    """A WARC/1.1 record of a block with its closing blank lines."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {date}", *more, f"Content-Type: {content_type}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def warc_opening(first: bytes) -> bytes:
    """A warcinfo record, its identifier from that of the record after it."""
    block = b"software: terraloom\r\nformat: WARC File Format 1.1\r\n"
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {header_value(first, b'WARC-Record-ID')}")
    return warc_lines("warcinfo", f"<urn:uuid:{own}>", header_value(first, b"WARC-Date"), block, "application/warc-fields", [])


def warc_record(record: dict, digest: str, page_id: int | None, first: dict | None = None) -> bytes:
    """The WARC record of an ARC record. first: page_id, url and date of the record that it repeats, if it does.

    HTTP becomes response, anything else resource with the type that its header line declares.
    """
    is_http = bool(record["head"])
    block = record["head"] + (b"" if first else record["payload"])
    date = warc_date(record["date"])
    more = [f"WARC-Target-URI: {record['url']}", f"WARC-IP-Address: {record['ip']}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}"]
    if first:
        then = warc_date(first["date"])
        more += [
            f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(first['page_id'], first['url'], then, digest)}",
            f"WARC-Refers-To-Target-URI: {first['url']}", f"WARC-Refers-To-Date: {then}", f"X-Refers-To-Page-Id: {first['page_id']}",
        ]
    kind = "revisit" if first else "response" if is_http else "resource"
    return warc_lines(kind, record_id(page_id, record["url"], date, digest), date, block, "application/http; msgtype=response" if is_http else record["type"], more)


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record, by declared lengths; gzip or not."""
    pieces = Pieces(data)
    while (head := pieces.until(b"\r\n\r\n")) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC header")
        block = pieces.take(int(header_value(head, b"Content-Length") or 0))
        if pieces.take(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield head, block


def write_lines(df: DataFrame, column: str, path: str, rows_per_file: int) -> None:
    """Writes a binary column's values, which end in a line feed, one after the other into gzip files."""
    value = F.substring(F.col(column), F.lit(1), F.octet_length(column) - 1)  # the writer adds the last line feed
    df.select(value.cast("string").alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", rows_per_file).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole archive files, each as (content), the compressed bytes."""
    return spark.read.format("binaryFile").load(path).filter("length > 0").select("content")


def write_arc(pages: DataFrame, path: str) -> None:
    """pages(page_id, url, html) as ARC files, versions 1 and 2 by turns. Null html: an empty payload; null url: about:blank."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, held, size = 0, [], 0
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                version = 1 + turn % 2
                held.append(arc_record(version, url, page_id, html or b""))
                size += len(held[-1])
                if size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([arc_opening(version) + b"".join(held)], pa.binary())], names=["segment"])
                    turn, held, size = turn + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([arc_opening(1 + turn % 2) + b"".join(held)], pa.binary())], names=["segment"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    write_lines(rows.mapInArrow(segments, "segment binary"), "segment", path, SEGMENTS_PER_FILE)


def _emit(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of ARC files: page_id, url, ip, date, type, digest, payload_bytes, and head and payload (zlib) if asked for.

    page_id is that of the X-Page-Id line of the HTTP head, null where there is none.
    """
    names = ["page_id", "url", "ip", "date", "type", "digest", "payload_bytes", *(["head", "payload"] if with_payload else [])]
    types = [pa.int64(), *[pa.string()] * 5, pa.int64(), *([pa.binary(), pa.binary()] if with_payload else [])]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in parse_arc(content.as_py()):
                    page = header_value(r["head"], b"X-Page-Id")
                    shown = (r[c].encode("utf-8", "surrogateescape").decode("utf-8", "replace") for c in ("url", "ip", "date", "type"))
                    rows.append((page_number(page), *shown, hashlib.sha256(r["payload"]).hexdigest(), len(r["payload"]), *([r["head"], zlib.compress(r["payload"], 1)] if with_payload else [])))
                    size += len(r["payload"])
                    if size >= SEGMENT_BYTES:
                        yield _emit(rows, types, names)
                        rows, size = [], 0
                if rows:
                    yield _emit(rows, types, names)

    schema = "page_id long, url string, ip string, date string, type string, digest string, payload_bytes long" + (", head binary, payload binary" if with_payload else "")
    return read_files(spark, path).mapInArrow(parse, schema)


def convert_arc(spark: SparkSession, arc_path: str, warc_path: str, least: int = REVISIT_LEAST) -> None:
    """WARC files for all records of ARC files.

    Of records with equal payloads of at least `least` bytes, that of the smallest page id is a response and the others
    revisit it. Repeats of that very page are responses too. A null page id counts as larger than any.
    """
    seen = read_arc(spark, arc_path, with_payload=False).filter(F.col("payload_bytes") >= least)
    groups = seen.groupBy("digest", "payload_bytes").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "date"))).alias("first"), F.count("*").alias("n"))
    groups = groups.filter((F.col("n") > 1) & F.col("first").isNotNull())
    decided = seen.join(groups, ["digest", "payload_bytes"]).filter(~F.col("page_id").eqNullSafe(F.col("first.page_id"))).groupBy("page_id", "digest").agg(F.min("first").alias("first"))
    decided = decided.select(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest"), "first")
    records = read_arc(spark, arc_path)
    joined = records.join(decided, records["page_id"].eqNullSafe(decided["own_id"]) & (records["digest"] == decided["own_digest"]), "left")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([warc_opening(held[0]) + b"".join(held)], pa.binary())], names=["segment"])

        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                held.append(warc_record(r | {"payload": zlib.decompress(r["payload"])}, r["digest"], r["page_id"], r["first"]))
                size += len(held[-1])
                if size >= SEGMENT_BYTES:
                    yield segment()
                    held, size = [], 0
        if held:
            yield segment()

    columns = joined.select("page_id", "url", "ip", "date", "type", "digest", "head", "payload", "first")
    write_lines(columns.mapInArrow(convert, "segment binary"), "segment", warc_path, SEGMENTS_PER_FILE)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest, and payload (null for revisits) if asked for.

    Of responses, resources and revisits; other records are passed over. Stored payloads are held against their digest; one that differs raises ValueError.
    """
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if with_payload else [])]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_payload else [])]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block in parse_warc(content.as_py()):
                    if header_value(head, b"WARC-Type") not in ("response", "resource", "revisit"):
                        continue  # what describes the file, a request or other records
                    kind, digest = header_value(head, b"WARC-Type"), (header_value(head, b"WARC-Payload-Digest") or "").removeprefix("sha256:")
                    http, body = http_parts(block)
                    page, refers = header_value(http, b"X-Page-Id"), header_value(head, b"X-Refers-To-Page-Id")
                    payload = None if kind == "revisit" else body
                    if payload is not None and digest and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of page {page} doesn't match its digest")
                    length = len(payload) if payload is not None else int(header_value(http, b"Content-Length") or 0)
                    rows.append((page_number(page), kind, int(refers) if refers else None, length, digest, *([payload] if with_payload else [])))
                    size += len(block)
                    if size >= SEGMENT_BYTES:
                        yield _emit(rows, types, names)
                        rows, size = [], 0
                if rows:
                    yield _emit(rows, types, names)

    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if with_payload else "")
    return read_files(spark, path).mapInArrow(parse, schema)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """All pages as ARC, converted into WARC, read back."""
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert_arc(spark, arc, warc)
    return read_warc(spark, warc, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
