import gzip
import hashlib
import json
import zlib
from html.parser import HTMLParser

import pytest
import zstandard

from crosscut.llm.html_tokens import INLINE
from crosscut.llm.queries import op4_warc_derivatives
from crosscut.llm.warc import derivatives, derive, digest, field, parse, read_warc, records, response, responses, serialize, unchunked, write_warc

HTML = "<html><head><title>A &amp; B</title><meta name=x content='y'><script>var a='<p>no';</script></head><body><p>One<br>two <b>three</b></p><a href='/z'>link</a><img src=i.png></body>"


def test_round_trip():
    for block in (b"", b"abc", b"\r\n\r\nx", bytes(range(256)) * 9):
        headers = [("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:x>"), ("X-Odd", "a: b")]
        version, back, body = parse(serialize(headers, block))
        assert (version, body) == ("WARC/1.1", block)
        assert back == [*headers, ("Content-Length", str(len(block)))]


def test_derivatives_refer_to_the_response():
    rec = response("<urn:uuid:1>", "http://a/b", "2024-05-06T07:08:09Z", HTML.encode())
    d = derive(rec)
    _, headers, block = parse(d["metadata"])
    _, theirs, _ = parse(rec)
    assert field(headers, "WARC-Refers-To") == "<urn:uuid:1>" and field(headers, "WARC-Target-URI") == "http://a/b" and field(headers, "WARC-Date") == "2024-05-06T07:08:09Z"
    assert field(headers, "WARC-Block-Digest") == digest(block)
    about = json.loads(block)["Envelope"]
    assert about["WARC-Header-Metadata"] == [list(h) for h in theirs]
    payload = about["Payload-Metadata"]
    assert payload["Digest"] == field(theirs, "WARC-Payload-Digest") == digest(HTML.encode()) and payload["Digest-Matches"]
    assert payload["HTML-Metadata"] == {"Title": "A & B", "Metas": [{"name": "x", "content": "y"}], "Links": [{"path": "A@/href", "url": "/z"}, {"path": "IMG@/src", "url": "i.png"}]}
    _, headers, block = parse(d["conversion"])
    assert field(headers, "WARC-Type") == "conversion" and field(headers, "WARC-Refers-To") == "<urn:uuid:1>"
    assert block.decode() == d["text"] == "One\ntwo three\nlink"
    assert derive(rec) == d


def test_other_types_have_no_text():
    rec = response("<urn:uuid:2>", None, "2024-05-06T07:08:09Z", b"\x00\x01", "image/png")
    d = derive(rec)
    assert d["conversion"] is None and d["metadata"] is not None and field(parse(d["metadata"])[1], "WARC-Target-URI") is None
    rec = response("<urn:uuid:3>", "u", "d", "é".encode("latin-1"), "text/plain; charset=latin-1")
    assert derive(rec)["text"] == "é"


def test_rows(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>x"), (2, None, None), (3, "http://c", ""), (1, "http://a", "<p>x"), (4, "u", "y" * 3_000_000)], "page_id long, url string, html string")
    out = derivatives(responses(pages)).collect()
    assert sorted((r["page_id"], len(r["text"]), r["error"]) for r in out) == [(1, 1, None), (1, 1, None), (2, 0, None), (3, 0, None), (4, 3_000_000, None)]
    odd = spark.createDataFrame([(None, "k"), (bytearray(b"junk"), "k"), (bytearray(serialize([("WARC-Type", "request"), ("WARC-Record-ID", "<x>")], b"")), "k"), (bytearray(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx"), "k")], "record binary, text string")
    rows = derivatives(odd).collect()
    assert len(rows) == 4 and all(r["error"] and r["metadata"] is None for r in rows)
    assert derivatives(odd.limit(0)).count() == 0


def http_record(head, body):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + head + b"\r\n\r\n" + body
    return serialize([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Date", "d")], block)


@pytest.mark.parametrize(
    ("head", "body"),
    [
        (b"Content-Encoding: gzip", gzip.compress(b"<p>text")),
        (b"Content-Encoding: deflate", zlib.compress(b"<p>text")),
        (b"Content-Encoding: deflate", zlib.compress(b"<p>text")[2:-4]),
        (b"Content-Encoding: zstd", zstandard.ZstdCompressor().compress(b"<p>text")),
        (b"Transfer-Encoding: chunked", b"3;x=y\r\n<p>\r\n4\r\ntext\r\n0\r\n\r\n"),
        (b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip", b"%x\r\n%s\r\n0\r\n\r\n" % (len(gzip.compress(b"<p>text", mtime=0)), gzip.compress(b"<p>text", mtime=0))),
        (b"Content-Encoding: identity", b"<p>text"),
    ],
)
def test_encodings_are_undone(head, body):
    d = derive(http_record(head, body))
    assert d["text"] == "text" and d["error"] is None and d["payload_digest"] == digest(body)


def test_encodings_that_cannot_be_undone():
    for head, body in ((b"Content-Encoding: br", b"xyz"), (b"Content-Encoding: gzip", b"no gzip")):
        d = derive(http_record(head, body))
        assert d["conversion"] is None and json.loads(parse(d["metadata"])[2])["Envelope"]["Payload-Metadata"]["Unread-Encoding"] in ("br", "gzip")
    assert unchunked(b"no chunks") == b"no chunks" and unchunked(b"4\r\nab") == b"ab"


def test_line_breaks_in_a_url(spark):
    urls = ["http://a/\r\nX: 1", "http://a/\r\n\r\nbody", "http://a/b c\td"]
    pages = spark.createDataFrame([(i, u, "<p>x") for i, u in enumerate(urls)], "page_id long, url string, html string")
    rows = sorted((r["page_id"], r["target_uri"], r["text"], r["error"]) for r in derivatives(responses(pages)).collect())
    assert rows == [(0, "http://a/%0D%0AX:%201", "x", None), (1, "http://a/%0D%0A%0D%0Abody", "x", None), (2, "http://a/b%20c%09d", "x", None)]


@pytest.mark.parametrize("compress", [True, False])
def test_written_files_are_read_again(spark, tmp_path, compress):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>page {i}\r\n\r\nWARC/1.0") for i in range(20)], "page_id long, url string, html string").repartition(3)
    made = derivatives(responses(pages)).cache()
    files = write_warc(made, f"file://{tmp_path}/out", compress)
    assert sum(n for _, n in files) == 40 and len({f for f, _ in files}) == 3
    want = sorted(bytes(r[c]) for r in made.collect() for c in ("metadata", "conversion"))
    for most in (1 << 30, 0):  # by Spark, or streamed
        got = sorted(bytes(r["record"]) + b"\r\n\r\n" for r in read_warc(spark, f"file://{tmp_path}/out", most).collect())
        assert got == want
    assert derivatives(read_warc(spark, f"file://{tmp_path}/out")).where("error is null").count() == 0


def test_broken_files():
    good = serialize([("WARC-Type", "response"), ("WARC-Record-ID", "<x>")], b"abc")
    got = list(records(iter([b"junk before\r\n\r\n", good, b"WARC/1.1\r\nContent-Length: none\r\n\r\n", good[:-6]])))
    assert [parse(g)[2] for g in got if g.startswith(b"WARC/1.1\r\nWARC-Type") and len(g) + 4 == len(good)] == [b"abc"]
    assert len(got) == 4 and list(records(iter([]))) == []


class Plain(HTMLParser):
    """Text of a page by another reader, to compare with."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")
        if tag == "br" or tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")
        if tag not in INLINE:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)

    def flush(self):
        block = " ".join("".join(self.parts).split())
        self.blocks += [block] if block else []
        self.parts = []


def test_query_against_another_reader(spark):
    """Brute force: every page of the smallest table, its records put together by hand."""
    d = "/root/testdata/sf0.001"
    got = {r["page_id"]: r for r in op4_warc_derivatives(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r, reader = got[p["page_id"]], Plain()
        reader.feed(p["html"] or "")
        reader.close()
        reader.flush()
        text = "\n".join(reader.blocks).encode()
        lines = ["WARC/1.1", "WARC-Type: conversion", f"WARC-Record-ID: {r['conversion_id']}", f"WARC-Refers-To: {r['response_id']}", f"WARC-Target-URI: {p['url']}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Block-Digest: {digest(text)}", "Content-Type: text/plain; charset=utf-8", f"Content-Length: {len(text)}"]
        record = "\r\n".join(lines).encode() + b"\r\n\r\n" + text + b"\r\n\r\n"
        assert r["conversion_sha256"] == hashlib.sha256(record).hexdigest() and r["payload_digest"] == digest(p["html"].encode()) and r["target_uri"] == p["url"]


def _record(n: int, body: bytes, length: int | None = None) -> bytes:
    return b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n" % (n, len(body) if length is None else length) + body + b"\r\n\r\n"


@pytest.mark.parametrize("piece", [1, 7, 4096, 1 << 22])
@pytest.mark.parametrize("length", [0, 3, 10, 19, 10**6, 10**12, 10**30])
@pytest.mark.parametrize("place", [0, 1, 3])
def test_a_broken_length_loses_no_other_record(piece, length, place):
    body = b"plain body of 28 characters."
    # a whole record may hold what looks like another one
    rows = [_record(k, b"x" * 9000 if k == 2 else b"a\r\n\r\nWARC/1.1\r\nb" if k == 1 else body) for k in range(3)]
    rows.insert(place, _record(9, body, length))
    data = b"".join(rows)
    if piece == 1 and len(data) > 30_000:
        return
    got = list(records(iter([data[i : i + piece] for i in range(0, len(data), piece)]), most=1 << 16))
    assert [r.rstrip(b"\r\n") for r in got if b"<urn:9>" not in r] == [r.rstrip(b"\r\n") for r in rows if b"<urn:9>" not in r]
    assert b"".join(got).replace(b"\r\n", b"") == data.replace(b"\r\n", b"")


@pytest.mark.parametrize("end", [".warc", ".warc.gz"])
def test_broken_records_in_files(spark, tmp_path, end):
    body = b"plain"
    rows = [_record(0, body, 10**12), _record(1, body), _record(2, body, 99), _record(3, body), _record(4, body, 7)]
    data = b"".join(gzip.compress(r) if end == ".warc.gz" else r for r in rows)
    (tmp_path / f"x{end}").write_bytes(data)
    got = [bytes(r["record"]) for r in read_warc(spark, str(tmp_path)).collect()]
    assert [sum(b"<urn:%d>" % k in r for r in got) for k in range(5)] == [1] * 5 and len(got) == 5
