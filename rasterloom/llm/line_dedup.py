"""Line deduplication by content-defined chunks of lines, and by windows of two lines where chunks do not reach.

A rolling hash over the last line hashes sets chunk boundaries, so the same passage is
cut alike wherever it stands. Chunks come first: those that an earlier document has too
go whole, in ``dedup_lines`` and in ``dedup_runs``. At its ends a repeated run covers parts
of chunks only; as a run is the union of its two-line windows, ``dedup_runs`` then looks at every
window that does not lie in a chunk that went. Pieces that occur in more than
one document are fetched as text, compared byte by byte, and stay in the earliest document only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.hashing import windows
from rasterloom.llm.shared import order_id, release_shuffles, row_struct, with_text, written

#: Lines under the rolling hash; a line ends a chunk with a chance of one in so many.
ROLL, ONE_IN = 2, 4


def chunk_ends(lines: list[bytes], roll: int = ROLL, one_in: int = ONE_IN) -> list[int]:
    """Index after the last line of each chunk; depends on ``roll`` lines before it only."""
    n = len(lines)
    ones = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, n)
    cut = windows(ones, roll) % np.uint64(one_in) == 0
    ends = (np.nonzero(cut)[0] + roll).tolist()
    return ends if ends and ends[-1] == n else [*ends, n]


def chunks(text: str | None, roll: int = ROLL, one_in: int = ONE_IN) -> list[tuple[int, int, bytes]]:
    """``(lines, words?, bytes)`` of each chunk in order; joining them by newlines gives the text back."""
    lines = (text or "").encode().split(b"\n")
    out, start = [], 0
    for end in chunk_ends(lines, roll, one_in):
        body = b"\n".join(lines[start:end])
        out.append((end - start, bool(body.strip()), body))
        start = end
    return out


def _digest(body: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_digest(body)
    return int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True)


def chunk_bodies(text: str | None) -> Iterator[bytes]:
    """Chunks of two lines or more with a word."""
    return (body for n, has_word, body in chunks(text) if n >= 2 and has_word)


def pairs(lines: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """``(place, bytes)`` of every window of two lines with a word."""
    word = [bool(x.strip()) for x in lines]
    return ((k, lines[k] + b"\n" + lines[k + 1]) for k in range(len(lines) - 1) if word[k] or word[k + 1])


def whole_chunks(lines: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """``(first line, line after the last, bytes)`` of every chunk of two lines or more with a word."""
    start = 0
    for end in chunk_ends(lines):
        body = b"\n".join(lines[start:end])
        if end - start >= 2 and body.strip():
            yield start, end, body
        start = end


def pair_bodies(text: str | None) -> Iterator[bytes]:
    return (body for _, body in pairs((text or "").encode().split(b"\n")))


Pieces = Callable[[str | None], Iterator[bytes]]


def _piece_rows(rows: DataFrame, place: int, wanted: bool, pieces: Pieces) -> DataFrame:
    """``d, h, a, b`` (and ``body`` if wanted) of every piece, once per document.

    ``rows`` has ``d, h, row``, the text being field ``place`` of ``row``. With ``wanted``
    it has ``hs`` too and only pieces listed there come out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_hash, one, two, bodies = [], [], [], [], []
            for k, (d, h, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).field(place))):
                only = set(batch.column(3)[k].as_py()) if wanted else None
                seen = set()
                for body in pieces(text.as_py()):
                    a, b = _digest(body)
                    if (a, b) in seen or (only is not None and a not in only):
                        continue
                    seen.add((a, b))
                    doc.append(d)
                    text_hash.append(h)
                    one.append(a)
                    two.append(b)
                    if wanted:
                        bodies.append(body)
            columns = [pa.array(x, pa.int64()) for x in (doc, text_hash, one, two)] + ([pa.array(bodies, pa.binary())] if wanted else [])
            yield pa.RecordBatch.from_arrays(columns, ["d", "h", "a", "b", *(["body"] if wanted else [])])

    return rows.mapInArrow(run, "d long, h long, a long, b long" + (", body binary" if wanted else ""))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(order_id().alias("d"), F.xxhash64("text").alias("h"), F.struct("text").alias("row"))


def repeated_pieces(rows: DataFrame, texts: DataFrame, place: int, pieces: Pieces) -> DataFrame:
    """``d, h, gone``: per document its pieces that, byte by byte, an earlier document has too.

    ``rows`` are pieces ``d, h, a, b``, read twice.
    """
    at = F.struct("d", "h")
    ends = rows.groupBy("a", "b").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    shared = written(ends.where("lo < hi").select("a", "b"), "line-shared")
    lists = rows.join(shared, ["a", "b"]).groupBy("d", "h").agg(F.collect_set("a").alias("hs"))
    lists = written(lists, "line-lists")
    # merged, not broadcast: lists grow with the corpus
    wanted = texts.hint("merge").join(lists, ["d", "h"]).select("d", "h", "row", "hs")
    bodies = _piece_rows(wanted, place, True, pieces)
    first = bodies.groupBy("a", "b", "body").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo < hi")
    first = first.select(F.col("a").alias("a1"), F.col("body").alias("body1"), "lo")
    # joined on half the hash, so that both sides are exchanged and a hot piece can be split
    equal = F.concat("body", F.lit(b"")) == F.col("body1")
    again = bodies.join(first, (F.col("a") == F.col("a1")) & (at > F.col("lo"))).where(equal)
    return again.groupBy("d", "h").agg(F.collect_set("a").alias("gone"))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``d, h, gone``: per document its chunks that an earlier document has too."""
    texts = _texts(docs)
    return repeated_pieces(written(_piece_rows(texts, 0, False, chunk_bodies), "line-chunks"), texts, 0, chunk_bodies)


def _window_rows(rows: DataFrame) -> DataFrame:
    """``d, h, a, b, c`` of every window of two lines, ``c`` being the chunk it lies in (null if in none), once per document and chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], [], [], []
            for d, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).field(0)):
                lines = (text.as_py() or "").encode().split(b"\n")
                inside: list[int | None] = [None] * len(lines)
                for start, end, body in whole_chunks(lines):
                    inside[start : end - 1] = [_digest(body)[0]] * (end - 1 - start)
                for a, b, c in {(*_digest(body), inside[k]) for k, body in pairs(lines)}:
                    for to, v in zip(out, (d, h, a, b, c)):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["d", "h", "a", "b", "c"])

    return rows.mapInArrow(run, "d long, h long, a long, b long, c long")


Left = Callable[[str | None, set[int], set[int]], tuple[int, int, bytes]]


def _without(rows: DataFrame, place: int, gone: DataFrame, left: Left) -> DataFrame:
    """``row, n_lines, n_removed, kept``: what ``left`` leaves of each text without the pieces ``gone`` and the chunks ``cut``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[set(x.as_py() or ()) for x in batch.column(k)] for k in (1, 2)]
            out = [left(text.as_py(), hs, cut) for text, hs, cut in zip(batch.column(0).field(place), *sets)]
            columns = [pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)] + [pa.array([r[2].decode() for r in out], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", "n_lines", "n_removed", "kept"])

    full = rows.hint("merge").join(gone, ["d", "h"], "left").select("row", "gone", "cut")
    kind = rows.schema["row"].dataType.simpleString()
    return full.mapInArrow(run, f"row {kind}, n_lines long, n_removed long, kept string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(order_id().alias("d"), F.xxhash64("text").alias("h"), row_struct(docs))


def left_of_chunks(text: str | None, drop: set[int], cut: set[int]) -> tuple[int, int, bytes]:
    seen, out, n, gone = set(), [], 0, 0
    for size, has_word, body in chunks(text):
        n += size
        if size >= 2 and has_word:
            if body in seen or (cut and _digest(body)[0] in cut):
                gone += size
                continue
            seen.add(body)
        out.append(body)
    return n, gone, b"\n".join(out)


def left_of_runs(text: str | None, drop: set[int], cut: set[int]) -> tuple[int, int, bytes]:
    lines = (text or "").encode().split(b"\n")
    first: dict[bytes, int] = {}
    stay = [True] * len(lines)
    inside = [False] * len(lines)
    for start, end, body in whole_chunks(lines) if cut else ():
        if _digest(body)[0] in cut:
            inside[start : end - 1] = [True] * (end - 1 - start)
    for k, body in pairs(lines):
        # a window that overlaps its first occurrence does not repeat it
        if k - first.setdefault(body, k) >= 2 or inside[k] or (drop and _digest(body)[0] in drop):
            stay[k] = stay[k + 1] = False
    out = [x for x, s in zip(lines, stay) if s]
    return len(lines), len(lines) - len(out), b"\n".join(out)


def dedup_runs(docs: DataFrame) -> DataFrame:
    """Remove every repeated run of two lines or more: content-defined chunks first, then what windows add to them.

    Returns ``row`` (a struct of all columns of ``docs``), ``n_lines, n_removed, kept``
    per row, ``kept`` being the text that is left. Lines are parts between newlines. A
    line goes if a window of two lines that it is in, with a word in at least one of
    them, stands in an earlier document, or earlier in the same one without overlap; so
    of a run with words every line goes, but for blank lines that have only blank lines
    beside them. Documents are ordered by id, those with equal ids by a hash of their
    text; rows equal in both are not earlier than each other. Windows are judged on the
    input. Null and empty texts are one empty line and stay empty; a null id is smaller
    than any other. An empty table gives no rows.
    """
    cut = written(repeated_chunks(docs).withColumnRenamed("gone", "cut"), "line-cut")
    # the exchanges of the chunks go before those of the windows are written
    release_shuffles(docs.sparkSession)
    # a window in a chunk that goes is not looked at: the earlier document, which keeps the chunk, lists it
    inner = cut.select("d", "h", F.explode("cut").alias("c"))
    windows_left = _window_rows(_texts(docs)).join(inner, ["d", "h", "c"], "left_anti").select("d", "h", "a", "b").distinct()
    # both joins of the texts read one exchange
    rows, place = _rows(docs), docs.columns.index("text")
    gone = repeated_pieces(written(windows_left, "line-pieces"), rows, place, pair_bodies)
    return _without(rows, place, gone.join(cut, ["d", "h"], "full"), left_of_runs)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Remove repeated multi-line chunks; coarser than ``dedup_runs``.

    Returns ``row`` (a struct of all columns of ``docs``), ``n_lines, n_removed, kept``
    per row, ``kept`` being the text that is left. Lines are parts between newlines; a
    chunk counts if it has two lines or more and a word. Of equal chunks the one in the
    document of the smallest id stays, and the first one in it; documents with equal ids
    are ordered by a hash of their text, and rows equal in both are not earlier than each
    other. Chunks are judged on the input. Null and empty texts
    are one empty line and stay empty; a null id is smaller than any other. An empty
    table gives no rows.
    """
    cut = repeated_chunks(docs).select("d", "h", F.lit(None).cast("array<long>").alias("gone"), F.col("gone").alias("cut"))
    return _without(_rows(docs), docs.columns.index("text"), cut, left_of_chunks)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that are left; documents of which no word is left go."""
    left = dedup_runs(docs)
    had, has = F.coalesce(F.col("row.text"), F.lit("")), F.col("kept")
    return with_text(left.where((F.col("n_removed") == 0) | has.rlike(r"[^\x20\x09-\x0D]") | (had == "")), docs, "kept")
