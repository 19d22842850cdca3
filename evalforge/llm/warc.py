"""Operator 7: WARC derivatives. Responses become linked metadata and plain-text conversion records.

For each response record two records are derived, both with ``WARC-Refers-To``
(and its target and date) set to the response:

* ``metadata`` (application/warc-fields): the source's HTTP status and headers,
  its payload digest, title, language, charset, every outlink, and the id of
  the conversion;
* ``conversion`` (text/plain): the text of the page, with the payload digest of
  the source kept in ``WARC-Source-Payload-Digest``.

The payload is read as its HTTP headers say: chunks and gzip or deflate undone,
text decoded by the charset of Content-Type, a byte order mark or the page, else
UTF-8.  HTML (or a response without a type) loses its markup, other text types stay
as they are, and a payload that is no text, or that cannot be unpacked, gets its
metadata with a ``no-conversion`` reason and no conversion record.

Ids are name-based UUIDs of (type, source id), so a retried task writes the same
records; digests are base32 SHA-1 of the block as the format has them.  Records
are made row by row inside Arrow batches: nothing is shuffled, and a hot host
costs no more than any other.

Files are unpacked piece by piece.  A record that cannot be read (a length that is no
number or beyond the file, headers without end, a broken gzip member, a response
without HTTP headers) becomes a row of ``read_warc`` with its ``fault``, which
``derivatives`` leaves out; reading goes on at the next record.

Defined cases: null html is an empty payload (an empty conversion); null url
leaves WARC-Target-URI out; a page cut off in a tag, comment or script ends
there; repeated rows give equal records; an empty table gives no record.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query

CAPTURED = "1970-01-01T00:00:00Z"  # date of pages that carry none
HTTP_HEADERS = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

# Each alternative is bounded by its own end or the end of the text; none rescans what another has read.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<[^<>]*>|<[^<>]*\Z",
                     re.S | re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header "
                   "hr li main nav ol p pre section table tbody td th thead title tr ul".split())
_TITLE = re.compile(r"<title\b[^<>]*>([^<]*)", re.I)
_LANG = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]{2,12})", re.I)
_CHARSET = re.compile(r"<meta\b[^<>]*?charset\s*=\s*[\"']?([\w-]{1,40})", re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)
GZIP, PIECE = b"\x1f\x8b", 1 << 20
_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,8})[\t ]*(?:;[^\r\n]*)?\r\n")
_META = re.compile(rb"<meta\b[^<>]*?charset\s*=\s*[\"']?([\w:.-]{1,40})", re.I)
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
#: Codecs of Python that no page means.
_NO_CHARSETS = frozenset("utf-7 idna punycode undefined unicode_escape raw_unicode_escape unicode-escape raw-unicode-escape "
                         "base64 bz2 hex quopri rot13 uu zlib mbcs oem".split())
_RECORD = re.compile(rb"WARC/[0-9]\.[0-9]+\r?\n")
_SPACES = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


def _replaced(m: re.Match) -> str:
    name = _NAME.match(m.group())
    return "\n" if name and name.group(1).lower() in _BLOCK else (" " if m.group(1) else "")


def page_text(page: str) -> str:
    """Visible text: markup, comments, scripts and styles removed, one line a block, entities resolved."""
    text = html.unescape(_MARKUP.sub(_replaced, page))
    return _LINES.sub("\n", _SPACES.sub(" ", text)).strip()


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{kind}:{source}'.encode()).digest()[:16], version=5)}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value).strip()


def header_text(kind: str, fields: list[tuple[str, str | None]], block: bytes) -> str:
    own = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {_clean(v)}\r\n" for k, v in own if v is not None) + "\r\n"


def _dechunked(body: bytes) -> bytes:
    """Chunked framing undone; a body that has none (archives often store it so) stays as it is."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        size = int(m.group(1), 16)
        if size == 0:
            return b"".join(out)
        if m.end() + size > len(body):
            break
        out.append(body[m.end():m.end() + size])
        at = m.end() + size
        at += 2 if body[at:at + 2] == b"\r\n" else 0
    return body


def _inflated(body: bytes, coding: str) -> bytes:
    """gzip or deflate undone; a body that is not packed stays as it is.  Raises ValueError."""
    if coding in ("", "identity"):
        return body
    if coding not in ("gzip", "x-gzip", "deflate"):
        raise ValueError(f"content-encoding {coding}")
    if not body or coding != "deflate" and body[:2] != GZIP:
        return body
    for wbits in ((47,) if coding != "deflate" else (15, -15)):
        try:
            return b"".join(piece for piece in _members(body, wbits))
        except zlib.error as e:
            fault = e
    raise ValueError(f"content-encoding {coding}: {fault}")


def _members(data: bytes, wbits: int) -> Iterator[bytes]:
    """Unpacked pieces of all members, one after the other; a last one that is cut off gives what it holds."""
    at = 0
    while at < len(data) and (at == 0 or data[at:at + 2] == GZIP):
        z = zlib.decompressobj(wbits)
        while at < len(data) and not z.eof:
            yield z.decompress(data[at:at + PIECE])
            at = min(len(data), at + PIECE) - len(z.unused_data)
        yield z.flush()


def _decoded(body: bytes, said: str | None, is_html: bool) -> tuple[str, str]:
    """(text, charset): by mark, header, the page's own word, else UTF-8; bytes that do not fit become U+FFFD."""
    names = [name for mark, name in _MARKS if body.startswith(mark)] + [said]
    if is_html and (m := _META.search(body[:4096])):
        names.append(m.group(1).decode("ascii", "replace"))
    for name in names:
        try:
            known = codecs.lookup((name or "").strip(" \"'").lower()).name
            known = "cp1252" if known in ("iso8859-1", "ascii") else known  # as browsers read them
            if known not in _NO_CHARSETS:
                return body.decode(known, "replace").removeprefix("\ufeff"), known
        except (LookupError, ValueError):
            continue
    return body.decode("utf-8", "replace").removeprefix("\ufeff"), "utf-8"


def entity(headers: dict[str, str], payload: bytes) -> tuple[str, str, str]:
    """(kind, text, charset) of a response's payload; kind: html, text, or the reason why there is no text."""
    body = _dechunked(payload) if "chunked" in headers.get("transfer-encoding", "").lower() else payload
    try:
        for coding in reversed(headers.get("content-encoding", "").lower().split(",")):
            body = _inflated(body, coding.strip())
    except ValueError as e:
        return str(e), "", ""
    media, _, more = headers.get("content-type", "").partition(";")
    media = media.strip().lower()
    is_html = media in ("", "text/html", "application/xhtml+xml")
    if not is_html and not media.startswith("text/"):
        return f"content-type {media}", "", ""
    m = re.search(r"charset\s*=\s*\"?([\w:.-]{1,40})", more, re.I)
    text, charset = _decoded(body, m and m.group(1), is_html)
    return "html" if is_html else "text", text, charset


def derive(source_id: str, uri: str | None, date: str | None, http: str | None, payload: bytes) -> list[tuple]:
    """(type, id, headers, block) of the metadata and, where the payload is text, the conversion of one response."""
    status, *lines = (http or "").replace("\r\n", "\n").strip("\n").split("\n")
    said = [(k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in lines) if k.strip()]
    kind, text, used = entity(dict(reversed(said)), payload)
    page = text if kind == "html" else ""
    meta, conv = record_id("metadata", source_id), record_id("conversion", source_id)
    fields = [("http-status", status)] if status else []
    fields += [(f"http-{k}", v) for k, v in said]
    fields += [("payload-digest", digest(payload)), ("payload-length", str(len(payload)))]
    fields += [("conversion", conv), ("decoded-as", used)] if used else [("no-conversion", kind)]
    for name, regex in (("title", _TITLE), ("language", _LANG), ("charset", _CHARSET)):
        if m := regex.search(page):
            fields.append((name, html.unescape(m.group(1))))
    fields += [("outlink", html.unescape(next(g for g in m.groups() if g is not None))) for m in _LINK.finditer(page)]
    block = "".join(f"{k}: {_clean(v)}\r\n" for k, v in fields).encode("utf-8", "replace")
    links = [("WARC-Target-URI", uri), ("WARC-Date", date or CAPTURED), ("WARC-Refers-To", source_id),
             ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date or CAPTURED)]
    made = [("metadata", meta, block, "application/warc-fields", [])]
    if used:
        plain = (page_text(page) if kind == "html" else text).encode("utf-8", "replace")
        made.append(("conversion", conv, plain, "text/plain; charset=utf-8", [("WARC-Source-Payload-Digest", digest(payload))]))
    return [(name, own, header_text(name, [("WARC-Record-ID", own), *links, *more, ("Content-Type", form)], block), block)
            for name, own, block, form, more in made]


def responses(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """Pages (page_id, url, html) as response records: page_id, record_id, target_uri, date, http_headers, payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    h = F.sha1(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                           F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))))
    name = F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"),
                    F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), name.alias("record_id"),
                        F.col("url").alias("target_uri"), (date if date is not None else F.lit(CAPTURED)).alias("date"),
                        F.lit(HTTP_HEADERS).alias("http_headers"), payload.alias("payload"))


SCHEMA = ("page_id long, record_type string, record_id string, refers_to string, target_uri string, headers string, "
          "block_digest string, source_payload_digest string, content_length long, content string")


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows a response (one where it holds no text); ``headers`` and ``content`` together are the record (``record_bytes``)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for page, own, uri, date, http, payload in zip(*(batch[c].array for c in (
                    "page_id", "record_id", "target_uri", "date", "http_headers", "payload"))):
                own, uri, date, http = (None if pd.isna(x) else x for x in (own, uri, date, http))
                payload = b"" if payload is None else bytes(payload)
                own = own or record_id("response", hashlib.sha1(payload).hexdigest())
                source = digest(payload)
                for kind, rid, head, block in derive(own, uri, date, http, payload):
                    rows.append((None if pd.isna(page) else int(page), kind, rid, own, uri, head, digest(block), source,
                                 len(block), block.decode()))
                    size += len(block)
                if size > 8_000_000:
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})
    if "fault" in records.columns:
        records = records.where(F.col("fault").isNull())
    cols = records.select(F.col("page_id").cast("string").alias("page_id"), "record_id", "target_uri", "date",
                          "http_headers", "payload")
    return cols.mapInPandas(run, SCHEMA)


def write_warc(records: DataFrame, path: str) -> None:
    """Records (headers, content) as plain WARC files, written by Spark to any store it reaches."""
    (records.select(F.concat("headers", "content", F.lit("\r\n")).alias("value"))
     .write.option("lineSep", "\r\n").text(path))


def _pieces(data: bytes) -> Iterator[bytes | str]:
    """The unpacked file in pieces; a string tells of a broken gzip member, after which the next one is sought."""
    if data[:2] != GZIP:
        yield from (data[at:at + PIECE] for at in range(0, len(data), PIECE))
        return
    at = 0
    while 0 <= at < len(data):
        z, start = zlib.decompressobj(31), at
        try:
            while at < len(data) and not z.eof:
                yield z.decompress(data[at:at + PIECE])
                at = min(len(data), at + PIECE) - len(z.unused_data)
            if not z.eof:
                yield f"gzip member at byte {start} is cut off"
        except zlib.error as e:
            yield f"gzip member at byte {start}: {e}"
            at = start + 2
        if data[at:at + 3] != GZIP + b"\x08":
            at = data.find(GZIP + b"\x08", at)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers by lower-case name, block, fault) of each record of a plain or gzipped WARC file."""
    pieces, buf, broken, over = _pieces(data), bytearray(), None, False

    def more() -> bool:
        nonlocal broken, over
        if broken is None and not over:
            piece = next(pieces, None)
            if isinstance(piece, bytes):
                buf.extend(piece)
                return True
            broken, over = piece, piece is None
        return False
    while True:
        while not (m := _RECORD.search(buf)):
            del buf[:-16]  # a version line may be cut between two pieces
            if not more():
                break
        if not m:
            if over:
                return
            yield {}, b"", broken
            buf.clear()
            broken = None
            continue
        del buf[:m.start()]
        seen, end = 0, -1
        while (end := buf.find(b"\r\n\r\n", seen)) < 0 and len(buf) < PIECE and more():
            seen = max(0, seen - 3)
        if end < 0:
            yield {}, b"", broken or "headers without end"
            del buf[:5]
            if broken:
                buf.clear()
                broken = None
            continue
        lines = buf[:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        said = head.get("content-length", "")
        size = int(said) if re.fullmatch("[0-9]{1,18}", said) else -1
        while 0 <= size and len(buf) < end + 4 + size and more():
            pass
        if size < 0 or len(buf) < end + 4 + size:
            yield head, b"", broken or (f"content-length {said!r}" if size < 0 else f"{size} bytes said, {len(buf) - end - 4} left")
            del buf[:end + 4]
            if broken:
                buf.clear()
                broken = None
            continue
        yield head, bytes(buf[end + 4:end + 4 + size]), None
        del buf[:end + 4 + size]


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each sound record."""
    return ((head, block) for head, block, fault in warc_records(data) if fault is None)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses of WARC files (one file a task's row, up to 2 GB as stored) in the form that ``derivatives`` takes, and a
    row with ``fault`` for each record that cannot be read."""
    schema = ("page_id long, record_id string, target_uri string, date string, http_headers string, payload binary, "
              "fault string, file string")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"page_id": "Int64"})
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                rows, size = [], 0
                for head, block, fault in warc_records(bytes(data)):
                    if fault is None and head.get("warc-type") != "response":
                        continue
                    http, found, payload = block.partition(b"\r\n\r\n")
                    if fault is None and not (found and http.startswith(b"HTTP/")):
                        fault = "no HTTP headers"
                    rows.append((None, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"),
                                 None if fault else http.decode("latin-1") + "\r\n", None if fault else payload, fault, file))
                    size += len(payload)
                    if size > 8_000_000 or len(rows) >= 1000:
                        yield frame(rows)
                        rows, size = [], 0
                if rows:
                    yield frame(rows)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def response_bytes(uri: str, date: str, http: str, payload: bytes, own: str, compressed: bool = False) -> bytes:
    """One response record, for files made by hand."""
    block = http.encode() + b"\r\n" + payload
    fields = [("WARC-Record-ID", own), ("WARC-Target-URI", uri), ("WARC-Date", date),
              ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")]
    out = header_text("response", fields, block).encode() + block + b"\r\n\r\n"
    return gzip.compress(out) if compressed else out


@query("op7_warc_derivatives")
def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")))
