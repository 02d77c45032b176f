"""WARC derivatives: metadata and plain-text conversion records that refer to the responses they come from."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_tokens import attributes, clean, plain_text, walk

CRLF = b"\r\n"
#: Names the ids of derived records, which are made from the id of the response and the type.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:crosscut:warc-derivatives")
DERIVED = "response_id string, metadata_id string, conversion_id string, target_uri string, date string, payload_digest string, block_digest string, metadata binary, conversion binary, text string, error string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_value(value: str) -> str:
    """A value that keeps to its line: line breaks with the white space around them become one space."""
    return re.sub(r"\s*[\r\n]+\s*", " ", value).strip() if "\r" in value or "\n" in value else value


def header_uri(uri: str) -> str:
    """A URI for a header: white space and control characters are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def serialize(headers: list[tuple[str, str]], block: bytes, version: str = "WARC/1.1") -> bytes:
    """One record; Content-Length is set here."""
    lines = [version, *(f"{k}: {header_value(v)}" for k, v in headers if k.lower() != "content-length"), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF + CRLF + block + CRLF + CRLF


def _header_lines(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    """The first line and the fields of a header; folded lines belong to the field before them."""
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    fields: list[tuple[str, str]] = []
    for line in rest:
        if line[:1] in " \t" and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            fields.append((k.strip(), v.strip()))
    return first, fields


def parse(record: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(version, headers, block) of one record; ValueError if it is none."""
    head, sep, rest = record.partition(CRLF + CRLF)
    if not sep or not head.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    version, headers = _header_lines(head)
    length = next((v for k, v in headers if k.lower() == "content-length"), "")
    if not length.isdigit() or int(length) > len(rest):
        raise ValueError("no valid Content-Length")
    return version, headers, rest[: int(length)]


def field(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def response(record_id: str, uri: str | None, date: str, body: bytes, content_type: str = "text/html; charset=utf-8") -> bytes:
    """A response record around an HTTP answer with that body."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: " + content_type.encode() + b"\r\nContent-Length: " + str(len(body)).encode() + CRLF + CRLF + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", header_uri(uri))] if uri else []
    headers += [("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return serialize(headers, block)


def unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer; what cannot be read as such stays as it is, and a cut one gives what is there."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return body if not out else b"".join(out)
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
        if at > len(body):
            return b"".join(out)


def decoded(body: bytes, http: list[tuple[str, str]]) -> tuple[bytes, str | None]:
    """(payload without its transfer and content encodings, what could not be undone). Encodings are undone from the last to the first."""
    if "chunked" in (field(http, "Transfer-Encoding") or "").lower():
        body = unchunked(body)
    for coding in reversed([c.strip().lower() for c in (field(http, "Content-Encoding") or "").split(",") if c.strip()]):
        try:
            if coding in ("gzip", "x-gzip"):
                body = b"".join(_members(iter([body])))
            elif coding == "deflate":
                try:
                    body = zlib.decompress(body)
                except zlib.error:
                    body = zlib.decompress(body, -15)
            elif coding == "zstd":
                body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
            elif coding != "identity":
                return body, coding
        except (zlib.error, zstandard.ZstdError):
            return body, coding
    return body, None


def _members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The content of gzip members one after another; a last one that is cut short gives what it has."""
    z = None
    for piece in pieces:
        while piece:
            if z is None:
                z = zlib.decompressobj(31)
            out = z.decompress(piece)
            if out:
                yield out
            piece = z.unused_data if z.eof else b""
            z = None if z.eof else z
            if z is None and not piece.strip(b"\0"):
                piece = b""


def page_metadata(source: str) -> dict:
    """Title, meta tags and links of a page."""
    title, metas, links = None, [], []
    for kind, *x in walk(source):
        if kind == "raw" and x[0] == "title" and title is None:
            title = clean([html.unescape(x[1])])
        elif kind == "open" and x[0] in ("meta", "a", "link", "img"):
            a = attributes(x[1])
            if x[0] == "meta":
                metas.append(a)
            elif url := a.get("src" if x[0] == "img" else "href"):
                links.append({"path": f"{x[0].upper()}@/{'src' if x[0] == 'img' else 'href'}", "url": url})
    return {"Title": title, "Metas": metas, "Links": links}


def derive(record: bytes | None) -> dict:
    """Both derivatives of one response record, or an error and no records.

    The metadata record holds, as JSON, the response's own headers in order, its HTTP status and headers, the
    payload's length and digest (recomputed, beside the one the header gives) and, for HTML, its title,
    meta tags and links. The conversion record holds the text: of HTML all text but head, scripts and
    styles; of other text types the text itself; other types have no conversion. A chunked transfer and gzip, deflate
    and zstd encodings are undone first; a payload in another encoding has no conversion, and its metadata names that. The
    digests are of the payload as it is. Both carry
    WARC-Refers-To with the response's id, its target URI and date, and digests of their own blocks. Ids are
    made from the response's id, so a second run gives the same.
    """
    out = dict.fromkeys(c.split()[0] for c in DERIVED.split(", "))
    if record is None:
        return out | {"error": "null record"}
    try:
        _, headers, block = parse(record)
    except ValueError as e:
        return out | {"error": str(e)}
    rid = field(headers, "WARC-Record-ID")
    if field(headers, "WARC-Type") != "response" or not rid:
        return out | {"error": "no response with an id"}
    head, sep, body = block.partition(CRLF + CRLF)
    if not sep:
        head, body = b"", block
    status, http = _header_lines(head)
    payload, left = decoded(body, http)
    kind = (field(http, "Content-Type") or "").lower()
    charset = kind.partition("charset=")[2].split(";")[0].strip("\"' ") or "utf-8"
    try:
        source = payload.decode(charset, "replace")
    except LookupError:
        source = payload.decode("utf-8", "replace")
    uri, date = field(headers, "WARC-Target-URI"), field(headers, "WARC-Date")
    about = {
        "Envelope": {
            "WARC-Header-Metadata": [list(h) for h in headers],
            "Payload-Metadata": {"HTTP-Response-Metadata": {"Status": status, "Headers": [list(h) for h in http]}, "Length": len(body), "Digest": digest(body), "Digest-Matches": field(headers, "WARC-Payload-Digest") in (None, digest(body))},
        }
    }
    is_html = "html" in kind
    if left is not None:
        about["Envelope"]["Payload-Metadata"]["Unread-Encoding"] = left
    elif is_html:
        about["Envelope"]["Payload-Metadata"]["HTML-Metadata"] = page_metadata(source)

    def make(type_: str, content_type: str, data: bytes) -> tuple[str, bytes]:
        own = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{type_} {rid}')}>"
        h = [("WARC-Type", type_), ("WARC-Record-ID", own), ("WARC-Refers-To", rid)]
        h += [("WARC-Target-URI", header_uri(uri))] if uri else []
        h += [("WARC-Date", date)] if date else []
        return own, serialize([*h, ("WARC-Block-Digest", digest(data)), ("Content-Type", content_type)], data)

    out |= {"response_id": rid, "target_uri": uri, "date": date, "payload_digest": digest(body), "block_digest": digest(block)}
    out["metadata_id"], out["metadata"] = make("metadata", "application/json", json.dumps(about, ensure_ascii=False).encode())
    if left is None and (is_html or kind.startswith("text/")):
        out["text"] = plain_text(source) if is_html else source
        out["conversion_id"], out["conversion"] = make("conversion", "text/plain; charset=utf-8", out["text"].encode())
    return out


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col and a response record for every row of pages; a null html is an empty body."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                ids, urls, sources = (batch.column(i).slice(k, 256) for i in range(3))
                made = [response(f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page {i} {u}')}>", u, date, (s or "").encode()) for i, u, s in zip(ids.to_pylist(), urls.to_pylist(), sources.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.binary())], names=[id_col, "record"])

    return pages.select(id_col, F.col(url_col).alias("_u"), F.col(html_col).alias("_h")).mapInArrow(run, f"`{id_col}` {id_type}, record binary")


def derivatives(records: DataFrame, record_col: str = "record", keep: list[str] | None = None) -> DataFrame:
    """keep's columns of every row with the columns of DERIVED: ids, source headers, digests, both records, text, error.

    Null or broken records, and records other than responses, give an error and null records. Repeated rows are
    each converted. keep's columns with names of DERIVED are left out. One pass, no shuffle.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c.split()[0] for c in DERIVED.split(", ")]
    keep = [c for c in (keep if keep is not None else [c for c in records.columns if c != record_col]) if c not in names]
    schema = T.StructType([records.schema[c] for c in keep] + [T.StructField(c.split()[0], T.BinaryType() if c.endswith("binary") else T.StringType()) for c in DERIVED.split(", ")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 128):
                made = [derive(r) for r in batch.column("_r").slice(k, 128).to_pylist()]
                cols = [batch.column(c).slice(k, 128) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array([m[c] for m in made], arrow.field(c).type) for c in names)], schema=arrow)

    return records.select(*keep, F.col(record_col).alias("_r")).mapInArrow(run, schema)


#: Most bytes of one record; one that says it is longer has a broken length.
MAX_RECORD = 1 << 30
_NEXT = CRLF + CRLF + b"WARC/"


def records(pieces: Iterator[bytes], most: int = MAX_RECORD) -> Iterator[bytes]:
    """Whole records of a WARC file given in pieces; what stands between records and is none is given as it is.

    A record's length counts if another record or the file's end follows it. Otherwise the record ends where the next one seems to begin, so that a
    broken length loses no record but its own. No more than about most bytes are held.
    """
    buf = bytearray()
    more = True

    def fill(n: int) -> bool:
        nonlocal more
        while more and len(buf) < n:
            piece = next(pieces, None)
            more = piece is not None
            buf.extend(piece or b"")
        return len(buf) >= n

    def fits(size: int) -> bool:
        """Whether size bytes are a record: a new one begins below, or nothing does."""
        if size > most or not fill(size):
            return False
        fill(size + 9)
        rest = bytes(buf[size : size + 9]).lstrip(CRLF)
        return b"WARC/".startswith(rest[:5])

    def up_to_next() -> int:
        at = 1
        while (k := buf.find(_NEXT, at)) < 0:
            at = max(1, len(buf) - len(_NEXT) + 1)
            if len(buf) > most or not more:
                return len(buf)
            fill(len(buf) + (1 << 20))
        return k + 4

    while fill(1):
        while fill(1) and buf[:1] in (b"\r", b"\n"):
            del buf[:1]
        end, size = -1, 1 << 12
        while end < 0 and size <= 1 << 20:
            whole = fill(size)
            end, size = buf.find(CRLF + CRLF), size * 2
            if not whole:
                break
        if not buf:
            return
        _, headers = _header_lines(bytes(buf[:end])) if end >= 0 and buf.startswith(b"WARC/") else ("", [])
        length = field(headers, "Content-Length") or ""
        size = end + 4 + int(length) if length.isdigit() and len(length) < 19 else most + 1
        if not fits(size):
            size = up_to_next()
        yield bytes(buf[:size])
        del buf[:size]


def read_warc(spark: SparkSession, path: str, max_whole: int = 64 << 20) -> DataFrame:
    """(file, record) of every record of the .warc and .warc.gz files under path.

    Files of up to max_whole bytes are read by Spark; larger ones are streamed by the task that has them, so
    their store must be one that pyarrow opens too. A file is one task's work, as gzip members cannot be found but by reading.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{warc,warc.gz}").load(path)
    small = files.where(F.col("length") <= max_whole).select(F.col("path").alias("file"), "content")
    large = files.where(F.col("length") > max_whole).select(F.col("path").alias("file"), F.lit(None).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def pieces(name: str, content: bytes | None) -> Iterator[bytes]:
            if content is not None:
                yield content
                return
            store, where = fs.FileSystem.from_uri(name)
            with store.open_input_stream(where, compression=None) as f:
                while data := f.read(1 << 20):
                    yield data

        for batch in batches:
            for name, content in zip(batch.column("file"), batch.column("content"), strict=True):
                name = name.as_py()
                raw = pieces(name, content.as_py())
                some, n = [], 0
                for r in records(_members(raw) if name.endswith(".gz") else raw):
                    some.append(r)
                    n += len(r)
                    if n > 1 << 22:
                        yield pa.RecordBatch.from_pydict({"file": [name] * len(some), "record": some})
                        some, n = [], 0
                if some:
                    yield pa.RecordBatch.from_pydict({"file": [name] * len(some), "record": some})

    return small.unionByName(large).mapInArrow(run, "file string, record binary")


def write_warc(derived: DataFrame, path: str, compress: bool = True) -> list[tuple[str, int]]:
    """Writes both records of every row to WARC files under path, one a partition; gives their names and numbers of records.

    With compress, each record is a gzip member. path is a folder of a store that pyarrow opens. A file is
    written under a name of its own and renamed when whole, so a task that runs again leaves one file.
    """
    end = ".warc.gz" if compress else ".warc"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, where = fs.FileSystem.from_uri(path)
        store.create_dir(where, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}{end}"
        own, n = f"{where}/.{uuid.uuid4().hex}", 0
        with store.open_output_stream(own, compression=None) as f:
            for batch in batches:
                for r in batch.column("record"):
                    data = r.as_buffer()
                    f.write(gzip.compress(data, 6, mtime=0) if compress else data)
                    n += 1
        if n:
            store.move(own, f"{where}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([n], pa.int64())})
        else:
            store.delete_file(own)

    records = derived.select(F.explode(F.array_compact(F.array("metadata", "conversion"))).alias("record"))
    return sorted((r["name"], r["n"]) for r in records.mapInArrow(run, "name string, n long").collect())  # one row a partition
