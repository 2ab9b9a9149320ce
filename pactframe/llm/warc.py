"""Operator 8, WARC derivatives: from response records, linked metadata and plain-text conversion records.

A record is a row: record_id, warc_type, target_uri, date, content_type, headers (further WARC header fields)
and block. Each response gives two derivatives, both with WARC-Refers-To and its URI and date:

* conversion: the page's text as text/plain, WARC-Source-Payload-Digest repeating the response's payload
  digest and WARC-Source-Content-Type its HTTP content type;
* metadata: application/warc-fields with the title, the language, the source's HTTP headers (prefixed
  "http-"), its digests and its outlinks, and WARC-Concurrent-To the conversion.

Only HTML and text have a conversion; of other types, of encodings that cannot be undone and of bodies that are cut
off there is the metadata record alone, which says why. Chunks, gzip and deflate are undone first, and the text is read
in the charset that the HTTP header or the page itself declares, UTF-8 otherwise.

Identifiers are derived from the response's identifier and the kind of record, so a job that runs again makes
the same ones. Digests are "sha1:" and base32. One row in gives one or two rows out without a shuffle.

Defined cases: a null or empty html is an empty payload with an empty text; null urls, dates and header values are
written as empty ones; repeated rows give repeated records; markup that is never closed runs to the end of the page; every
pattern takes time in proportion to the page; an empty table gives an empty result; in `derive`, rows of other types
give nothing. Files are read as streams; a record that cannot be read comes out with the type "broken" and a reason.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RECORD = "record_id string, warc_type string, target_uri string, date string, content_type string, headers map<string,string>, block binary"
VERSION = "WARC/1.1"
# Elements whose content is no text, and elements that end a line.
NO_TEXT = "script|style|noscript|template|title"
BREAKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul"
# Types that have a text.
HTML_TYPES = {"text/html", "application/xhtml+xml"}
#: A comment, a tag with its attributes, or other markup. What is not closed runs to the end, so each place is passed once.
_MARKUP = re.compile(r"<(?:!--(?:.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[/!?][^>]*(?:>|\Z))", re.S)
_SILENT = {name: re.compile(rf"</{name}\s*>", re.I) for name in NO_TEXT.split("|")}
_BREAKING = frozenset(BREAKS.split("|"))
_ATTRIBUTE = {name: re.compile(rf"""\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I) for name in ("href", "lang", "charset")}
_SPACES = re.compile(r"[^\S\n]+")


def _attribute(name: str, attributes: str) -> str | None:
    m = _ATTRIBUTE[name].search(attributes)
    return next(x for x in m.groups() if x is not None) if m else None


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


class Page:
    """What one pass over a page's markup finds: text, title, language, links."""

    def __init__(self, page: str):
        self.title: str | None = None
        self.language: str | None = None
        self.links: list[str] = []
        pieces, at = [], 0
        while m := _MARKUP.search(page, at):
            pieces.append(page[at : m.start()].replace("\n", " "))
            at, name = m.end(), (m[2] or "").lower()
            if not name:
                pieces.append(" " if page.startswith("<!--", m.start()) else "")
            elif name in _BREAKING:
                pieces.append("\n")
            elif name in _SILENT and not m[1]:
                end = _SILENT[name].search(page, at)
                inside, at = page[at : end.start() if end else len(page)], end.end() if end else len(page)
                self.title = inside if name == "title" and self.title is None else self.title
                pieces.append(" ")
            elif name == "a" and not m[1]:
                self.links += [x for x in [_attribute("href", m[3])] if x is not None]
            elif name == "html" and not m[1]:
                self.language = self.language or _attribute("lang", m[3])
        pieces.append(page[at:].replace("\n", " "))
        lines = (_SPACES.sub(" ", line.replace("\n", " ")).strip() for line in map(html.unescape, "".join(pieces).split("\n")))
        self.text = "\n".join(line for line in lines if line)


def text_of(page: str) -> str:
    """A page's text: one line for each block element with text, white space reduced to single spaces."""
    return Page(page).text


def _urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields and payload of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *fields = head.decode("utf-8", "replace").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (f.partition(":") for f in fields)], payload


def _one_line(value: str) -> str:
    return " ".join(value.split())


class NoText(ValueError):
    """Why a payload has no conversion."""


def _unchunked(payload: bytes) -> bytes:
    out, at = [], 0
    while True:
        size, _, _ = payload[at : at + 64].partition(b"\r\n")
        try:
            n = int(size.split(b";")[0], 16)
        except ValueError:
            raise NoText("chunks are broken") from None
        at += len(size) + 2
        if not n:
            return b"".join(out)
        if at + n > len(payload):
            raise NoText("chunks are cut off")
        out.append(payload[at : at + n])
        at += n + 2


def _unpacked(payload: bytes, bits: int, coding: str) -> bytes:
    """A packed payload, members one after the other, of UNPACKED_BYTES at most: a page that unpacks to more has no text."""
    out, left = [], UNPACKED_BYTES
    while payload:
        one = zlib.decompressobj(bits)
        out.append(one.decompress(payload, left + 1))
        left -= len(out[-1])
        if left < 0:
            raise NoText(f"{coding} gives more than {UNPACKED_BYTES} bytes")
        if not one.eof:
            raise EOFError
        payload = one.unused_data if bits == 31 else b""
        payload = payload.lstrip(b"\0")
    return b"".join(out)


def _decoded(payload: bytes, header: Callable[[str], str]) -> bytes:
    if "chunked" in header("transfer-encoding").lower():
        payload = _unchunked(payload)
    for coding in reversed([c.strip().lower() for c in header("content-encoding").split(",")]):
        try:
            if coding in ("gzip", "x-gzip"):
                payload = _unpacked(payload, 31, coding)
            elif coding == "deflate":
                payload = _unpacked(payload, 15 if payload[:1] == b"\x78" else -15, coding)
            elif coding not in ("", "identity"):
                raise NoText(f"content encoding {coding}")
        except (OSError, EOFError, zlib.error):
            raise NoText(f"{coding} is broken") from None
    return payload


def _read(payload: bytes, content_type: str) -> tuple[str, bool]:
    """A payload as text, and whether it is HTML."""
    kind, _, parameters = content_type.partition(";")
    kind = kind.strip().lower()
    if kind and kind not in HTML_TYPES and not kind.startswith("text/"):
        raise NoText(f"type {kind}")
    is_html = not kind or kind in HTML_TYPES
    charset = _attribute("charset", parameters) or (_attribute("charset", payload[:2048].decode("latin-1")) if is_html else None) or "utf-8"
    try:
        return payload.decode(charset.strip("\"' ;/"), "replace"), is_html
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace"), is_html


def derivatives(response: dict) -> list[dict]:
    """The metadata record of one response and, if it is text, the conversion record."""
    status, fields, payload = split_http(response["block"])
    header = lambda name: next((v for k, v in fields if k.lower() == name), "")
    source_digest = (response["headers"] or {}).get("WARC-Payload-Digest") or digest(payload)
    linked = {"WARC-Refers-To": response["record_id"], "WARC-Refers-To-Target-URI": response["target_uri"], "WARC-Refers-To-Date": response["date"] or ""}
    conversion_id, metadata_id = (_urn(kind, response["record_id"]) for kind in ("conversion", "metadata"))
    page, plain, lines = None, None, []
    try:
        text, is_html = _read(_decoded(payload, header), header("content-type"))
        page = Page(text) if is_html else None
        plain = (page.text if page else text).encode()
    except NoText as e:
        lines.append(("no-conversion", str(e)))
    if page and page.title is not None:
        lines.append(("title", _one_line(html.unescape(page.title))))
    lines += [("language", page.language)] if page and page.language else []
    lines += [("http-status", status)] + [(f"http-{k}", v) for k, v in fields] + [("source-payload-digest", source_digest), ("source-block-digest", digest(response["block"]))]
    lines += [("outlink", _one_line(html.unescape(x))) for x in page.links] if page else []
    meta = "".join(f"{k}: {v}\r\n" for k, v in lines).encode()
    base = {"target_uri": response["target_uri"], "date": response["date"]}
    concurrent = {} if plain is None else {"WARC-Concurrent-To": conversion_id}
    made = [base | {"record_id": metadata_id, "warc_type": "metadata", "content_type": "application/warc-fields", "block": meta, "headers": linked | concurrent | {"WARC-Block-Digest": digest(meta)}}]
    if plain is not None:
        told = {"WARC-Block-Digest": digest(plain), "WARC-Source-Payload-Digest": source_digest, "WARC-Source-Content-Type": header("content-type")}
        made.append(base | {"record_id": conversion_id, "warc_type": "conversion", "content_type": "text/plain; charset=utf-8", "block": plain, "headers": linked | told})
    return made


def to_bytes(record: dict) -> bytes:
    """A record as it stands in a WARC file."""
    fields = [("WARC-Type", record["warc_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["date"]), ("WARC-Target-URI", record["target_uri"])]
    fields += [*sorted((record["headers"] or {}).items()), ("Content-Type", record["content_type"]), ("Content-Length", str(len(record["block"])))]
    return (VERSION + "\r\n" + "".join(f"{k}: {v or ''}\r\n" for k, v in fields) + "\r\n").encode() + record["block"] + b"\r\n\r\n"


_COLUMNS = {"warc-type": "warc_type", "warc-record-id": "record_id", "warc-date": "date", "warc-target-uri": "target_uri", "content-type": "content_type"}
#: The longest block of one record: what is longer comes in segments, as the format has it. The longest header line. The most that a payload unpacks to.
BLOCK_BYTES, LINE_BYTES, UNPACKED_BYTES = 1 << 28, 1 << 24, 1 << 28


def _broken(reason: str, block: bytes = b"") -> dict:
    return dict.fromkeys(_COLUMNS.values(), "") | {"warc_type": "broken", "headers": {"reason": reason}, "block": block}


def _segments(record: dict, stream: BinaryIO, n: int) -> Iterator[dict]:
    """A record whose block of n bytes is above BLOCK_BYTES as its first segment and continuations; what is missing at the end is told."""
    number, done = 1, 0
    while done < n:
        block = stream.read(min(BLOCK_BYTES, n - done))
        done += len(block)
        short = len(block) == 0
        if short:
            yield _broken(f"{n - done} of {n} bytes are missing")
            return
        told = {"WARC-Segment-Number": str(number)} | ({"WARC-Segment-Total-Length": str(n)} if done == n else {})
        if number == 1:
            yield record | {"headers": record["headers"] | told, "block": block}
        else:
            name = f"{record['record_id'][:-1]}:{number}>" if record["record_id"].endswith(">") else f"{record['record_id']}:{number}"
            told["WARC-Segment-Origin-ID"] = record["record_id"]
            yield record | {"warc_type": "continuation", "record_id": name, "headers": told, "block": block}
        number += 1


def read_records(source: BinaryIO) -> Iterator[dict]:
    """The records of a WARC file, gzip members or plain, one at a time; what cannot be read comes as a "broken" record."""
    stream = source if isinstance(source, io.BufferedReader) else io.BufferedReader(source)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    lost, begins = 0, True  # bytes before the next record that belong to none; whether what is read next begins a line
    try:
        while line := stream.readline(LINE_BYTES):
            inside, begins = not begins, line.endswith(b"\n")
            if inside or not line.startswith(b"WARC/"):
                lost += len(line.strip())
                continue
            if lost:
                yield _broken(f"{lost} bytes between records")
                lost = 0
            fields: dict[str, str] = {}
            begins, long = True, False
            while (line := stream.readline(LINE_BYTES)).strip():
                long = long or not line.endswith(b"\n")
                name, _, value = line.decode("utf-8", "replace").partition(":")
                fields[name.strip()] = value.strip()
            if long:
                yield _broken(f"a header line that does not end within {LINE_BYTES} bytes")
                continue
            told = {k.lower(): k for k in fields}
            size = fields.pop(told["content-length"], "") if "content-length" in told else ""
            if not re.fullmatch("[0-9]{1,18}", size):
                yield _broken(f"Content-Length is {size!r}")
                continue
            n = int(size)
            record = {to: fields.pop(told[name], "") if name in told else "" for name, to in _COLUMNS.items()} | {"headers": fields}
            if n > BLOCK_BYTES:
                yield from _segments(record, stream, n)
                continue
            block = stream.read(n)
            if len(block) < n:
                yield _broken(f"{n - len(block)} of {n} bytes are missing", block)
                return
            yield record | {"block": block}
    except (OSError, EOFError, zlib.error) as e:
        yield _broken(f"{type(e).__name__}: {e}")
    if lost:
        yield _broken(f"{lost} bytes after the last record")


def from_bytes(data: bytes) -> Iterator[dict]:
    """The records of a WARC file's content."""
    return read_records(io.BytesIO(data))


def _record_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([list(r[f.name].items()) if f.name == "headers" else r[f.name] for r in rows], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _schema(spark: SparkSession) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], RECORD).schema)


def _mapped(df: DataFrame, one) -> DataFrame:
    """Rows of RECORD that `one` makes of each row (a dict), some at a time."""
    schema = _schema(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for record in (r for x in batch.slice(at, 200).to_pylist() for r in one(x)):
                    held.append(record)
                    size += len(record["block"])
                    if len(held) >= 400 or size > 32 << 20:
                        yield _record_batch(held, schema)
                        held, size = [], 0
        if held:
            yield _record_batch(held, schema)

    return df.mapInArrow(run, RECORD)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of fetched pages."""
    def one(x: dict) -> Iterator[dict]:
        payload, uri = (x["page"] or "").encode(), x["url"] or ""
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        headers = {"WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block)}
        yield {"record_id": _urn("response", str(x["key"]), uri), "warc_type": "response", "target_uri": uri, "date": date,
               "content_type": "application/http; msgtype=response", "headers": headers, "block": block}

    return _mapped(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page")), one)


def derive(records: DataFrame) -> DataFrame:
    """The derivative records of the responses among records."""
    def one(x: dict) -> list[dict]:
        return derivatives(x | {"headers": dict(x["headers"] or ()), "block": x["block"] or b"", "target_uri": x["target_uri"] or "", "record_id": x["record_id"] or ""})

    return _mapped(records.filter("warc_type = 'response'").select(*[f.name for f in records.sparkSession.createDataFrame([], RECORD).schema]), one)


def _records_at(uri: str) -> Iterator[dict]:
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_file(path) as source:
        yield from read_records(source)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files. Tasks get the files' addresses and read them as streams, so a file may be larger than memory."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return _mapped(files.repartition("path"), lambda x: _records_at(x["path"]))


def serialized(records: DataFrame) -> DataFrame:
    """records with a column `bytes`: each as it stands in a WARC file."""
    told = lambda c: F.coalesce(c, F.lit(""))
    parts = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), told(e["value"]), F.lit("\r\n")))
    named = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri")]
    head = F.concat(F.lit(VERSION + "\r\n"), *[F.concat(F.lit(f"{k}: "), told(F.col(c)), F.lit("\r\n")) for k, c in named], told(F.array_join(parts, "")),
                    F.lit("Content-Type: "), told(F.col("content_type")), F.lit("\r\nContent-Length: "), F.coalesce(F.octet_length("block"), F.lit(0)).cast("string"), F.lit("\r\n\r\n"))
    return records.withColumn("bytes", F.concat(head.cast("binary"), F.coalesce("block", F.lit(b"")), F.lit(b"\r\n\r\n")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per derivative record of every page."""
    found = serialized(derive(responses(table(spark, sf_dir, "pages"))))
    h = lambda name: F.col("headers")[name]
    return found.select(
        "record_id", "warc_type", "target_uri", h("WARC-Refers-To").alias("refers_to"), h("WARC-Concurrent-To").alias("concurrent_to"), h("WARC-Block-Digest").alias("block_digest"),
        h("WARC-Source-Payload-Digest").alias("source_payload_digest"), F.octet_length("block").cast("bigint").alias("n_bytes"), F.sha2("bytes", 256).alias("record_sha256"),
    )


QUERIES = {"op8_warc": op8_warc}
ORACLE_SQL = {}
