"""WARC archives: one gzip member per record, written and read by Spark tasks.

The reader is sequential: it inflates a file piece by piece, frames each record
by its content length and checks its digests, holding one record at a time.
Files are opened through Arrow's file systems, so the folder may be on any store
that those reach.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.llm.shared import shared_folder, written

VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A task begins another archive after this many bytes.
FILE_BYTES = 1 << 30
READ_BYTES = 1 << 20
RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "payload binary, problem string"
)


def sha1_digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, refers_to, is_revisit: bool, date: str) -> bytes:
    """One record as a gzip member; a revisit keeps the HTTP head and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        VERSION,
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha1_digest(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:  # control characters, blanks and non-ASCII would break the head
        head.insert(3, f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if is_revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT}"]
    data = ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def inflated_members(stream, size: int = READ_BYTES) -> Iterator[Iterator[bytes]]:
    """Members of a gzip file, each as an iterator of inflated pieces of bounded size."""
    rest = stream.read(size)
    while rest:
        inflate = zlib.decompressobj(31)
        state = {"rest": rest}

        def pieces():
            data = state["rest"]
            while not inflate.eof:
                if not data:
                    data = stream.read(size)
                    if not data:
                        raise EOFError("the file ends inside a record")
                piece = inflate.decompress(data, size)
                data = inflate.unconsumed_tail
                if piece:
                    yield piece
            state["rest"] = inflate.unused_data

        member = pieces()
        yield member
        for _ in member:  # what a caller left unread
            pass
        rest = state["rest"] or stream.read(size)


def _head(buffer: bytearray, pieces: Iterator[bytes], what: str) -> dict[str, str]:
    """Cut a header block off the buffer's front."""
    at = 0
    while (end := buffer.find(b"\r\n\r\n", max(0, at - 3))) < 0:
        at = len(buffer)
        piece = next(pieces, None)
        if piece is None:
            raise ValueError(f"{what} head without end")
        buffer += piece
    lines = bytes(buffer[:end]).decode("utf-8").split("\r\n")
    del buffer[: end + 4]
    named = {"": lines[0]}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        named[name.strip().lower()] = value.strip()
    return named


def _page(name: str | None) -> int | None:
    value = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def parse(pieces: Iterator[bytes]) -> tuple:
    """One record: framed by its content length, digests compared; a row of ``RECORDS``."""
    buffer = bytearray()
    head = _head(buffer, pieces, "record")
    if not head[""].startswith("WARC/"):
        raise ValueError("not a WARC record")
    length = int(head["content-length"])
    for piece in pieces:
        buffer += piece
        if len(buffer) > length + 4:
            raise ValueError("content beyond the stated length")
    if len(buffer) != length + 4 or buffer[length:] != b"\r\n\r\n":
        raise ValueError("content length does not match")
    block = buffer[:length]
    problem = None
    if head.get("warc-block-digest") != f"sha1:{sha1_digest(block)}":
        problem = "block digest differs"
    http = _head(block, iter(()), "HTTP")
    kind, digest = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
    payload = None if kind == "revisit" else bytes(block)
    size = int(http["content-length"])
    if payload is not None:
        if len(payload) != size:
            problem = problem or "payload length differs"
        if digest != sha1_digest(payload):
            problem = problem or "payload digest differs"
    return (
        _page(head.get("warc-record-id")), head.get("warc-target-uri"), kind,
        _page(head.get("warc-refers-to")), size, digest, payload, problem,
    )


def read_records(stream) -> Iterator[tuple]:
    """Records of one archive in order; damage that breaks the framing ends the file with a problem row."""
    try:
        for member in inflated_members(stream):
            yield parse(member)
    except (EOFError, ValueError, KeyError, UnicodeDecodeError, zlib.error) as e:
        yield (None, None, "damaged", None, None, None, None, f"{type(e).__name__}: {e}")


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page; returns ``path, records, bytes`` per archive.

    Of pages with equal payloads of at least ``least_bytes`` bytes, those with the
    smallest id are responses and the others revisit it; smaller payloads are all
    responses. Null html is an empty payload, a null url leaves its header out, null
    ids come after all others. Rows that repeat the smallest id are responses too.
    Only the archives in the returned table count: what a lost task left behind in
    the folder is in none of its rows. Empty tables give no archives.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"), F.sha1(body).alias("digest"))
    often = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    )
    often = written(often.where("n > 1").select("digest", "first_id"), "warc-equal")
    marked = rows.join(often, "digest", "left").select(
        "page_id", "url", "payload", "first_id",
        (F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("is_revisit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, n, size, done = None, "", 0, 0, []
        for batch in batches:
            columns = [c for c in batch.columns]
            for page_id, url, payload, first, again in zip(*columns):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, path, n, size = store.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0, 0
                member = record(page_id.as_py(), url.as_py(), payload.as_py(), first.as_py(), again.as_py(), date)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    done.append((path, n, size))
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"]
            )

    return written(marked.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_warc(spark: SparkSession, paths: DataFrame, strict: bool = True) -> DataFrame:
    """Records of archives (``path`` per row), one task to a file; columns as ``RECORDS``.

    Revisits have a null payload; their size and digest are those of the full one.
    ``strict`` raises on the first problem, otherwise it is told in ``problem`` and a
    file whose framing is broken ends there.
    """
    n = paths.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string()),
        ])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as stream:
                    rows, held = [], 0
                    for row in read_records(stream):
                        if strict and row[-1]:
                            raise ValueError(f"{path}: {row[-1]}")
                        rows.append(row)
                        held += len(row[6] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return paths.select("path").repartition(max(1, n)).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write archives for all pages to a fresh shared folder and read them back."""
    spark = pages.sparkSession
    return read_warc(spark, write_warc(pages, shared_folder(spark, "warc"), **options))
