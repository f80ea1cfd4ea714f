"""WARC derivatives: metadata records with outgoing links, and plain-text conversion records.

A response (WARC headers, HTTP headers, payload) gives one ``metadata`` record and one ``conversion`` record.  Both refer to
the response by ``WARC-Refers-To``, repeat its URI and date, and carry digests of their own blocks; the metadata
block repeats the source's HTTP headers and payload digest, and says so if that digest isn't the payload's.
Responses come from WARC files (``responses``), whose headers are kept as they stand, or from a table of
pages (``captures``), which has URI and body only: there the headers that a response needs are made up from
those, and nothing else.  ``write`` makes .warc.gz files of records, one gzip member each.

Defined cases: a null body is empty and a null URI is the empty string; a response that repeats gives
the same records again, and captures that differ in page, URI, date or payload have ids of their own; a page of any length
costs time in proportion to it; links are listed once each in order of first appearance; records of other types than response
and responses that are not HTTP give nothing; only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievector.llm import html
from sievector.llm.batches import arrow_map, pieces
from sievector.sources.files import open_fs, put_in_place

Fields = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A name that depends on its parts alone, so a task that runs again writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def plain_text(body: str) -> str:
    """Visible text: one line a block element, entities decoded, white space collapsed."""
    return html.read(body).text


def links(body: str, uri: str) -> list[tuple[str, str]]:
    return html.resolved(html.read(body).links, uri)


def header_block(fields: Fields) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)


def field(fields: Fields, name: str) -> str | None:
    """The first value under a name, in any case."""
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def serialised(fields: Fields, block: bytes) -> bytes:
    """A record as it stands in a file; its length is that of the block, whatever the headers said."""
    head = [(k, v) for k, v in fields if k.lower() != "content-length"] + [("Content-Length", str(len(block)))]
    return header_block(head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def headers_of(lines: list[bytes]) -> Fields:
    """Fields of header lines; a line that begins with white space goes on with the one before."""
    out: Fields = []
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif text.strip():
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def records(stream: BinaryIO) -> Iterator[tuple[Fields, bytes]]:
    """(headers, block) of each record of an open WARC file, gzipped by record or plain; one record is held at a time."""
    stream = stream if isinstance(stream, io.BufferedReader) else io.BufferedReader(stream)  # type: ignore[arg-type]
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))  # type: ignore[arg-type]
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        lines = []
        while (line := stream.readline()) and line.strip():
            lines.append(line)
        fields = headers_of(lines)
        size = field(fields, "Content-Length")
        if size is None or not size.isdigit():
            raise ValueError("a WARC record has no length")
        block = stream.read(int(size))
        if len(block) < int(size):
            raise ValueError("a WARC record is cut off")
        yield fields, block


def response(page_id: object, uri: str, body: str, date: str) -> tuple[Fields, bytes]:
    """The response record of a stored page: WARC headers, and a block of HTTP headers and payload."""
    payload = body.encode("utf-8", "surrogatepass")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    own = digest(payload)
    return [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", str(page_id), uri, date, own)),
        ("WARC-Target-URI", uri),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", own),
        ("WARC-Block-Digest", digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
    ], block


def http_parts(block: bytes) -> tuple[str, Fields, bytes] | None:
    """(status line, headers, payload as sent) of an HTTP response, or None."""
    if not block.startswith(b"HTTP/"):
        return None
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.split(b"\r\n")
    return status.decode("utf-8", "replace"), headers_of(lines), payload


def decoded(headers: Fields, payload: bytes) -> str:
    """The payload's text: content coding undone, read in the charset that the headers name, else as UTF-8."""
    if "gzip" in (field(headers, "Content-Encoding") or "").lower():
        try:
            payload = zlib.decompressobj(31).decompress(payload)
        except zlib.error:
            payload = b""
    _, _, charset = (field(headers, "Content-Type") or "").lower().partition("charset=")
    try:
        return payload.decode(charset.split(";")[0].strip("\"' ") or "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(fields: Fields, block: bytes) -> list[tuple[str, Fields, str, int]]:
    """(type, WARC headers, block, links) of the records that a response gives."""
    parts = http_parts(block)
    if (field(fields, "WARC-Type") or "").lower() != "response" or parts is None:
        return []
    status, headers, payload = parts
    uri, source, own = field(fields, "WARC-Target-URI") or "", field(fields, "WARC-Record-ID") or "", digest(payload)
    said = field(fields, "WARC-Payload-Digest") or own
    page = html.read(decoded(headers, payload))
    to = html.resolved(page.links, uri)
    meta = [f"source-header: {x}" for x in (status, *(f"{k}: {v}" for k, v in headers))]
    meta += [f"source-payload-digest: {said}"]
    meta += [f"payload-digest-found: {own}"] if said.startswith("sha1:") and said != own else []
    meta += [f"title: {page.title}"] if page.title is not None else []
    meta += [f"language: {page.lang}"] if page.lang else []
    meta += [f"outlink: {x} L {name}" for name, x in to]
    out = []
    for kind, text, mime, n in (("metadata", "\r\n".join(meta) + "\r\n", "application/warc-fields", len(to)), ("conversion", page.text, "text/plain; charset=utf-8", 0)):
        raw = text.encode("utf-8", "surrogatepass")
        head = [
            ("WARC-Type", kind),
            ("WARC-Record-ID", record_id(kind, source, uri, own)),
            ("WARC-Refers-To", source),
            ("WARC-Target-URI", uri),
            ("WARC-Date", field(fields, "WARC-Date") or ""),
            ("WARC-Block-Digest", digest(raw)),
            ("Content-Type", mime),
            ("Content-Length", str(len(raw))),
        ]
        out.append((kind, head, text, n))
    return out


_COLUMNS = {
    "record_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "target_uri": pa.string(), "payload_digest": pa.string(),
    "block_digest": pa.string(), "n_links": pa.int64(), "warc_headers": pa.string(), "block": pa.string(),
}
_SCHEMA = "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, n_links long, warc_headers string, block string"


def _rows(fields: Fields, block: bytes) -> Iterator[tuple]:
    for kind, head, text, n in derive(fields, block):
        own = dict(head)
        yield kind, own["WARC-Record-ID"], own["WARC-Refers-To"], own["WARC-Target-URI"], field(fields, "WARC-Payload-Digest"), own["WARC-Block-Digest"], n, header_block(head), text


def _batch(rows: list[tuple], **first: pa.Array) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([*first.values(), *(pa.array(c, t) for c, t in zip(columns, _COLUMNS.values()))], [*first, *_COLUMNS])


def derivatives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Two rows a page: (page_id, record_type, record_id, refers_to, target_uri, payload_digest,
    block_digest, n_links, warc_headers, block).

    ``date`` is the capture date of pages, which the table doesn't have.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            at, rows = [], []
            for i, (page_id, uri, raw) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
                own = list(_rows(*response(page_id, uri or "", raw or "", date)))
                rows += own
                at += [i] * len(own)
            yield _batch(rows, page_id=batch.column(0).take(pa.array(at, pa.int64())))

    kind = pages.schema["page_id"].dataType.simpleString()
    return arrow_map(pages.select("page_id", F.col("url"), F.col("html")), body, f"page_id {kind}, {_SCHEMA}")


def captures(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(warc_headers, block) of the response record of each page, as ``write`` takes them."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            made = [response(p, u or "", h or "", date) for p, u, h in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array([header_block(f) for f, _ in made], pa.string()), pa.array([b for _, b in made], pa.binary())], ["warc_headers", "block"])

    return arrow_map(pages.select("page_id", F.col("url"), F.col("html")), body, "warc_headers string, block binary")


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Derived rows of the responses in WARC files, gzipped or not, with the file's path; a file is one task's work and is held whole."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for fields, block in records(pa.BufferReader(data.as_buffer())):
                    rows += _rows(fields, block)
                    held += len(block)
                    if held > 4 << 20:
                        yield _batch(rows, path=pa.array([name] * len(rows), pa.string()))
                        rows, held = [], 0
                yield _batch(rows, path=pa.array([name] * len(rows), pa.string()))

    return arrow_map(files, body, f"path string, {_SCHEMA}")


def write(found: DataFrame, folder: str) -> DataFrame:
    """One .warc.gz file a task from (warc_headers, block) rows; returns (path, records, bytes).

    A task writes under a name of its own and moves the file into place, so one that runs again leaves the same files.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = open_fs(folder)
        files.create_dir(base, recursive=True)
        name, n, size = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0, 0
        temporary = f"{base}/.{name}-{uuid.uuid4().hex}"
        stream = None
        for batch in batches:
            for head, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stream = stream or files.open_output_stream(temporary, compression=None)
                fields = headers_of(head.encode("utf-8", "surrogatepass").split(b"\r\n")[1:])
                data = gzip.compress(serialised(fields, block or b""), mtime=0)
                stream.write(data)
                n, size = n + 1, size + len(data)
        if stream:
            stream.close()
            put_in_place(files, temporary, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

    return arrow_map(found.select("warc_headers", F.col("block").cast("binary")), body, "path string, records long, bytes long")
