"""WARC archives: one gzip member per record, written and read sequentially."""

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wordloom.llm.words import slices
from wordloom.plans.storage import written

VERSION = b"WARC/1.1"
READABLE = (b"WARC/1.0", VERSION)
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PART = 1 << 20  # bytes of an archive part
_READ = 1 << 16
_MASK = (1 << 64) - 1


class WarcError(ValueError):
    """An archive that is cut off, badly framed, or does not match its digests."""


def record_id(page_id: int | None) -> str:
    """A record's URN; it holds the page's number, and a null one has the largest value."""
    return f"<urn:uuid:{uuid.UUID(int=_MASK + 1 if page_id is None else page_id & _MASK)}>"


def page_number(urn: str | None) -> int | None:
    """The number in a URN made by `record_id`, null for those of other writers."""
    try:
        value = uuid.UUID((urn or "").strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    return None if value > _MASK else value - (1 << 64) if value >> 63 else value


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _agrees(named: str | None, data: bytes) -> bool:
    """Whether a labelled digest, in base32 or hex, is that of the data; unknown algorithms are not judged."""
    algorithm, _, value = (named or "").partition(":")
    algorithm = algorithm.lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha256", "sha512"):
        return True
    digest = hashlib.new(algorithm, data).digest()
    return value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")


def _sha1_hex(named: str | None) -> str | None:
    algorithm, _, value = (named or "").partition(":")
    if algorithm.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _header_value(text: str) -> str:
    """No line breaks inside a header."""
    return "".join(c if c not in "\r\n%" else f"%{ord(c):02X}" for c in text)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One gzip member with a response, or with a revisit of the record `refers_to`."""
    revisit = refers_to is not None
    block = (HTTP_HEAD % len(payload)).encode() + (b"" if revisit else payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", date), ("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)),
            ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        head.append(("WARC-Target-URI", _header_value(url)))
    if revisit:
        head += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    head.append(("Content-Length", str(len(block))))
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


class _Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, file, rest: bytes):
        self.file, self.rest, self.ready = file, rest, bytearray()
        self.packer = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.packer.eof:
            return False
        data = self.rest or self.file.read(_READ)
        made = self.packer.decompress(data, _READ)  # without data it can still hold some output back
        if not (data or made or self.packer.eof):
            raise WarcError("the archive ends inside a record")
        self.ready += made
        self.rest = self.packer.unused_data if self.packer.eof else self.packer.unconsumed_tail
        return True

    def line(self) -> bytes:
        at, seen = self.ready.find(b"\r\n"), 0
        while at < 0:
            seen = max(0, len(self.ready) - 1)
            if not self._more():
                raise WarcError("a header line has no end")
            at = self.ready.find(b"\r\n", seen)
        return self.take(at + 2)[:-2]

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self._more():
                raise WarcError("a record is shorter than its Content-Length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def finish(self) -> bytes:
        """What follows this member in the file."""
        while not self.packer.eof:
            self._more()
        if self.ready:
            raise WarcError("a record is longer than its Content-Length")
        return self.rest


def read_records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open archive; framing and digests are verified."""
    rest = b""
    while rest := rest or file.read(_READ):
        member = _Member(file, rest)
        if member.line() not in READABLE:
            raise WarcError("not a WARC record")
        headers = {}
        while text := member.line():
            name, _, value = text.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = member.take(int(headers["content-length"]))
        if member.take(4) != b"\r\n\r\n":
            raise WarcError("a record does not end where its Content-Length says")
        rest = member.finish()
        if not _agrees(headers.get("warc-block-digest"), block):
            raise WarcError("a block does not match its digest")
        yield headers, block


def _page(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id)."""
    url = headers.get("warc-target-uri")
    for code, char in (("%0D", "\r"), ("%0A", "\n"), ("%25", "%")):
        url = url and url.replace(code, char)
    record = headers.get("warc-record-id")
    named, kind = headers.get("warc-payload-digest"), headers["warc-type"]
    http = headers.get("content-type", "").lower().startswith("application/http")
    head, _, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    sent = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    if kind == "revisit":
        size, target = sent.get("content-length", ""), headers.get("warc-refers-to")
        return (page_number(record), url, None, int(size) if size.isdecimal() else None, _sha1_hex(named), kind,
                page_number(target), record, target)
    whole = "warc-truncated" not in headers and "transfer-encoding" not in sent
    if whole and not _agrees(named, body):
        raise WarcError("a payload does not match its digest")
    return page_number(record), url, body, len(body), hashlib.sha1(body).hexdigest(), kind, None, record, None


def with_revisits(pages: DataFrame, id: str = "page_id", html: str = "html", least: int = 1000) -> DataFrame:
    """(id, url, payload, refers_to): of equal payloads of `least` bytes or more the largest id stays.

    Payloads are compared by SHA-1 and length. Sizes of groups come from partial aggregates, and only
    groups of two or more are joined back.
    """
    payload = F.coalesce(F.encode(html, "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id).alias(id), F.col("url"), payload.alias("payload"))
    marked = rows.withColumns({"_digest": F.sha1("payload"), "_size": F.octet_length("payload")})
    groups, _ = written(marked.filter(F.col("_size") >= least).groupBy("_digest", "_size").agg(
        F.max(id).alias("_response"), F.count("*").alias("_n")).filter("_n > 1 AND _response IS NOT NULL").drop("_n"), "payloads")
    refers = F.when(F.col(id).eqNullSafe(F.col("_response")), None).otherwise(F.col("_response"))
    return marked.join(groups, ["_digest", "_size"], "left").select(id, "url", "payload", refers.alias("refers_to"))


def archive(pages: DataFrame, id: str = "page_id", html: str = "html", least: int = 1000,
            date: str = "2026-01-01T00:00:00Z", part: int = PART) -> DataFrame:
    """(part): archives as binary rows of about `part` bytes, each a sequence of gzip members.

    Written to a table they are reachable wherever Spark writes; one row's bytes are a .warc.gz file.
    A null html is an empty payload. A null id is kept; it never becomes the record others refer to.
    Rows of one id and one payload are one response each. Other columns are not read.
    """
    chosen = with_revisits(pages, id, html, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, 64):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(make_record(*row, date))
                size += len(held[-1])
                if size >= part:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["part"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["part"])

    return chosen.mapInArrow(run, "part binary")


def read_archive(parts: DataFrame, part: str = "part") -> DataFrame:
    """One row per record of archives held as binary rows (such as `part`, or `content` of binaryFile).

    page_id, url, payload (null for revisits), payload_bytes, payload_digest (hex SHA-1 of the whole
    payload), record_type, refers_to, record_id, refers_to_id. A record that is cut off or does not match
    its digest is an error.

    Archives of other writers, of version 1.0 or 1.1: response and revisit records are returned, others
    (warcinfo, request, metadata, ...) are skipped. Their page_id and refers_to are null, record_id and
    refers_to_id are the URNs. A revisit's payload_bytes is the Content-Length in its HTTP head, its
    payload_digest the header's, each null if it has none (or a digest other than SHA-1). A payload is the body as sent;
    its digest is not judged where the record is truncated or has a Transfer-Encoding.

    No rows, null and empty parts give no records. A record's payload has to fit into memory.
    """
    schema = ("page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, "
              "record_type string, refers_to bigint, record_id string, refers_to_id string")
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [f.split()[0] for f in schema.split(", ")]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows, size = [], 0
            for record in read_records(io.BytesIO(batch.column(0)[0].as_py() or b"")):
                if record[0].get("warc-type") not in ("response", "revisit"):
                    continue
                rows.append(_page(*record))
                size += len(rows[-1][2] or b"")
                if size >= PART:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)

    return parts.select(part).mapInArrow(run, schema)
