import gzip
import hashlib
import time
import zlib
from html.parser import HTMLParser

import pytest

from pactframe.llm import warc


class Plain(HTMLParser):
    """A slow reading of the same rules by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.silent = [], None

    def handle_starttag(self, tag, attrs):
        if tag in warc.NO_TEXT.split("|"):
            self.silent = tag
            self.out.append(" ")
        elif tag in warc.BREAKS.split("|"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag == self.silent:
            self.silent = None
        elif tag in warc.BREAKS.split("|"):
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data.replace("\n", " "))

    def handle_comment(self, data):
        self.out.append(" ")

    def text(self):
        return "\n".join(x for x in (" ".join(line.split()) for line in "".join(self.out).split("\n")) if x)


def test_derivatives_of_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    made = {(r.headers["WARC-Refers-To"], r.warc_type): r for r in warc.derive(warc.responses(pages)).collect()}
    assert len(made) == 2 * pages.count()
    for p, r in zip(pages.orderBy("page_id").collect(), warc.responses(pages.orderBy("page_id")).collect(), strict=True):
        conversion, metadata = made[r.record_id, "conversion"], made[r.record_id, "metadata"]
        parser = Plain()
        parser.feed(p.html)
        parser.close()
        assert bytes(conversion.block).decode() == parser.text(), p.page_id
        assert conversion.headers["WARC-Source-Payload-Digest"] == r.headers["WARC-Payload-Digest"] == warc.digest(p.html.encode())
        assert conversion.headers["WARC-Refers-To-Target-URI"] == p.url == metadata.target_uri
        assert metadata.headers["WARC-Concurrent-To"] == conversion.record_id
        fields = bytes(metadata.block).decode()
        assert "http-Content-Type: text/html; charset=utf-8\r\n" in fields and f"source-payload-digest: {r.headers['WARC-Payload-Digest']}\r\n" in fields
        assert fields.count("outlink: ") == p.html.count("<a href=")


def test_files_round_trip(spark, sf, tmp_path):
    records = warc.derive(warc.responses(spark.read.parquet(f"{sf}/pages.parquet").limit(20)))
    rows = warc.serialized(records).collect()
    assert [warc.to_bytes(r.asDict() | {"block": bytes(r.block)}) for r in rows] == [bytes(r.bytes) for r in rows]
    (tmp_path / "plain.warc").write_bytes(b"".join(bytes(r.bytes) for r in rows[:10]))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(bytes(r.bytes)) for r in rows[10:]))
    back = {r.record_id: r for r in warc.read_files(spark, str(tmp_path)).collect()}
    assert len(back) == len(rows)
    for r in rows:
        assert (back[r.record_id].warc_type, bytes(back[r.record_id].block), back[r.record_id].headers) == (r.warc_type, bytes(r.block), r.headers)


def test_defined_cases(spark):
    rows = [(1, None, None, 0), (2, "http://a", "", 0), (3, "http://b", "<p>a<script>x", 0), (3, "http://b", "<p>a<script>x", 0), (None, "http://c", "<p>1 &lt; 2 <b>b</b>old<!-- no -->", 0), (5, "u", "x " * 100_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block int")
    made = warc.derive(warc.responses(pages))
    assert sorted(bytes(r.block).decode() for r in made.filter("warc_type = 'conversion'").collect()) == sorted(["", "", "a", "a", "1 < 2 bold", ("x " * 100_000).strip()])
    assert made.count() == 12 and warc.derive(made).count() == 0 and warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_query(spark, sf):
    rows = warc.op8_warc(spark, sf).collect()
    by_id = {r.record_id: r for r in rows}
    want = warc.derive(warc.responses(spark.read.parquet(f"{sf}/pages.parquet"))).collect()
    assert len(by_id) == len(rows) == len(want)
    for r in want:
        assert by_id[r.record_id].record_sha256 == hashlib.sha256(warc.to_bytes(r.asDict() | {"block": bytes(r.block)})).hexdigest()


def http(payload, *fields):
    return ("HTTP/1.1 200 OK\r\n" + "".join(f"{f}\r\n" for f in fields) + "\r\n").encode() + payload


def converted(payload, *fields):
    made = warc.derivatives({"record_id": "r", "target_uri": "u", "date": None, "headers": {}, "block": http(payload, *fields)})
    return next((r["block"].decode() for r in made if r["warc_type"] == "conversion"), None), made[0]["block"].decode()


def test_types_encodings_and_charsets():
    assert converted(b"%PDF-1", "Content-Type: application/pdf")[0] is None and "no-conversion: type application/pdf" in converted(b"%PDF", "Content-Type: application/pdf")[1]
    assert converted("<p>café".encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1")[0] == "café"
    assert converted('<meta charset="windows-1252"><p>café'.encode("cp1252"), "content-type: TEXT/HTML")[0] == "café"
    assert converted("<p>café".encode(), "Content-Type: text/html; charset=nonsense")[0] == "café"
    assert converted(b"a < b\n<c>", "Content-Type: text/plain")[0] == "a < b\n<c>"
    packed = gzip.compress(b"<p>one<p>two")
    assert converted(packed, "Content-Type: text/html", "Content-Encoding: gzip")[0] == "one\ntwo"
    assert converted(zlib.compress(b"<p>one"), "Content-Encoding: deflate")[0] == converted(zlib.compress(b"<p>one", wbits=-15), "Content-Encoding: deflate")[0] == "one"
    chunked = b"".join(b"%x;x=1\r\n%s\r\n" % (len(packed[i : i + 7]), packed[i : i + 7]) for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    assert converted(chunked, "Content-Type: text/html", "Content-Encoding: gzip", "Transfer-Encoding: chunked")[0] == "one\ntwo"
    for bad in ((chunked[:20], "Transfer-Encoding: chunked"), (b"zz", "Transfer-Encoding: chunked"), (packed[:-9], "Content-Encoding: gzip"), (b"x", "Content-Encoding: br")):
        text, meta = converted(*bad)
        assert text is None and "no-conversion: " in meta


@pytest.mark.parametrize("unit", ["<a ", "<html ", "<br ", "<script ", "<title ", "<a href=", "<!--", "</script ", "<a href='", "< ", "&", "<script>", "</title", "\n \t"])
def test_hostile_pages_take_linear_time(unit):
    began = time.process_time()
    warc.Page(unit * ((1 << 20) // len(unit)))
    assert time.process_time() - began < 2


def test_broken_files_are_set_aside(spark, tmp_path):
    record = {"warc_type": "response", "record_id": "<urn:x>", "date": "d", "target_uri": "u", "content_type": "t", "headers": {"A": "b"}, "block": b"WARC/1.1\r\n inside \r\n\r\n"}
    good = warc.to_bytes(record)
    lower = good.replace(b"Content-Length", b"content-length").replace(b"WARC-Type", b"warc-type")
    none, bad = (good.replace(b"Content-Length: %d" % len(record["block"]), x) for x in (b"X: y", b"Content-Length: many"))
    cases = {"lower": (lower, []), "junk": (b"junk\r\n" + good + good, ["4 bytes"]), "cut": (good + good[:-20], ["missing"]), "none": (none + good, ["Content-Length"]), "bad": (bad + good, ["Content-Length"])}
    for name, (data, reasons) in cases.items():
        found = list(warc.from_bytes(data))
        broken = [r["headers"]["reason"] for r in found if r["warc_type"] == "broken"]
        assert record in [r for r in found if r["warc_type"] != "broken"], name
        assert all(any(x in b for b in broken) for x in reasons) and bool(broken) == bool(reasons), (name, broken)
    packed = gzip.compress(good) + gzip.compress(good)
    assert [r["warc_type"] for r in warc.from_bytes(packed[:-12])][-1] == "broken"
    (tmp_path / "many.warc.gz").write_bytes(gzip.compress(good) * 3000)
    (tmp_path / "empty.warc").write_bytes(b"")
    read = warc.read_files(spark, str(tmp_path))
    assert read.count() == 3000 and {(r.record_id, bytes(r.block)) for r in read.collect()} == {("<urn:x>", record["block"])}


def test_null_dates_are_written_empty(spark):
    rows = [("r", "response", None, None, None, None, bytearray(http(b"<p>x")))]
    made = warc.serialized(warc.derive(spark.createDataFrame(rows, warc.RECORD))).collect()
    assert len(made) == 2 and all(b"WARC-Date: \r\n" in bytes(r.bytes) and b"WARC-Refers-To-Date: \r\n" in bytes(r.bytes) for r in made)
    assert [bytes(r.bytes) for r in made] == [warc.to_bytes(r.asDict() | {"block": bytes(r.block)}) for r in made]


def test_long_blocks_come_in_segments(monkeypatch):
    """No byte of a block above the bound is lost: segments with their numbers, the last with the whole length."""
    monkeypatch.setattr(warc, "BLOCK_BYTES", 100)
    block = bytes(range(256)) * 2
    record = {"warc_type": "response", "record_id": "<urn:x:1>", "date": "d", "target_uri": "u", "content_type": "t", "headers": {"A": "b"}, "block": block}
    small = record | {"record_id": "<urn:x:2>", "block": b"ok"}
    data = warc.to_bytes(record) + warc.to_bytes(small)
    got = list(warc.from_bytes(data))
    assert [r["warc_type"] for r in got] == ["response", *["continuation"] * 5, "response"] and b"".join(r["block"] for r in got[:-1]) == block
    assert [r["headers"].get("WARC-Segment-Number") for r in got[:-1]] == list("123456") and got[5]["headers"]["WARC-Segment-Total-Length"] == "512"
    assert got[0]["headers"]["A"] == "b" and len({r["record_id"] for r in got}) == 7 and all(r["headers"]["WARC-Segment-Origin-ID"] == "<urn:x:1>" for r in got[1:6])
    assert list(warc.from_bytes(b"".join(map(warc.to_bytes, got)))) == got
    cut_off = list(warc.from_bytes(data[:400]))
    assert cut_off[-1]["warc_type"] == "broken" and "are missing" in cut_off[-1]["headers"]["reason"]


def test_header_lines_of_any_length(monkeypatch):
    record = {"warc_type": "response", "record_id": "<urn:x:1>", "date": "d", "target_uri": "u" * 200_000, "content_type": "t", "headers": {}, "block": b"x"}
    assert list(warc.from_bytes(warc.to_bytes(record))) == [record]
    monkeypatch.setattr(warc, "LINE_BYTES", 1000)
    got = list(warc.from_bytes(warc.to_bytes(record) + warc.to_bytes(record | {"target_uri": "u"})))
    assert got[0]["warc_type"] == "broken" and "header line" in got[0]["headers"]["reason"] and got[-1]["target_uri"] == "u"


def test_unpacking_is_bounded(monkeypatch):
    monkeypatch.setattr(warc, "UNPACKED_BYTES", 1000)
    told = lambda payload, coding: warc._decoded(payload, {"transfer-encoding": "", "content-encoding": coding}.__getitem__)
    page = b"a" * 1000
    assert told(gzip.compress(page), "gzip") == told(gzip.compress(page[:400]) + gzip.compress(page[400:]), "gzip") == told(zlib.compress(page), "deflate") == told(zlib.compress(page)[2:-4], "deflate") == page
    for payload, coding in ((gzip.compress(page * 1000), "gzip"), (gzip.compress(page) * 2, "gzip"), (zlib.compress(page + b"a"), "deflate"), (gzip.compress(page)[:-9], "gzip"), (b"junk", "gzip")):
        with pytest.raises(warc.NoText):
            told(payload, coding)
