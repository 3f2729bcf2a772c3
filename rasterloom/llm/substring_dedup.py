"""Substring deduplication by level-wise doubling of repeated windows.

Windows that occur in two documents at one length alone are extended to twice
that length. The first level need not look at every window: each window of
twice the length contains, among its windows of the first length, one with the
smallest hash, and equal windows contain equal ones. Only those smallest windows
are compared over the corpus (about a sixth of all), and only windows around one
that occurs in two documents go on. Nothing that repeats is missed.

Copies of whole texts are settled by a digest, and one of them goes on.

Rows name a document and a hash; per document each hash is listed once, so a hot
window has at most one row per document, and minima are taken before the
shuffle. What repeats inside one document is found where the document is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.hashing import pair_hash, signed, sliding, windows, word_hashes
from rasterloom.llm.shared import discard, given_id, order_id, release_shuffles, written

#: Turns word hashes into a second, independent family.
SALT = np.uint64(0xD6E8FEB86659FD93)


def _both(ones: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each window, 96 bits together."""
    return windows(ones, length), windows(pair_hash(ones, ones ^ SALT), length) >> np.uint64(32)


def _smallest(ones: np.ndarray, half: int) -> np.ndarray:
    """For each window of ``2 * half`` words the smallest hash of its windows of ``half``."""
    return sliding(windows(ones, half), half + 1)


def _texts(docs: DataFrame) -> DataFrame:
    """Id and text only: both joins below then read one and the same exchange."""
    return docs.select(order_id().alias("d"), "text")


def _long_rows(doc: list, values: list) -> list[pa.Array]:
    counts = [len(v) for v in values[0]]
    return [pa.array(np.repeat(np.array(doc, np.int64), counts)), *[pa.array(signed(np.concatenate(v))) for v in values]]


def anchors(texts: DataFrame, half: int) -> DataFrame:
    """``d, h``: the smallest windows of every document, each hash once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, found = [], []
            for d, text in zip(batch.column(0), batch.column(1)):
                found.append(np.unique(_smallest(word_hashes((text.as_py() or "").encode().split()), half)))
                doc.append(d.as_py())
            if doc:
                yield pa.RecordBatch.from_arrays(_long_rows(doc, [found]), ["d", "h"])

    return texts.select("d", "text").mapInArrow(run, "d long, h long")


def shared_lists(rows: DataFrame) -> DataFrame:
    """``d, hs``: per document its hashes that another row has as well; ``rows`` go after that."""
    shared = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "substring-shared")
    lists = written(rows.join(shared, "h").groupBy("d").agg(F.collect_list("h").alias("hs")), "substring-lists")
    discard(rows)
    discard(shared)
    release_shuffles(rows.sparkSession)
    return lists


def candidates(texts: DataFrame, lists: DataFrame, length: int) -> DataFrame:
    """``d, a, b``: windows of ``length`` words whose smallest half-length window is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, one, two = [], [], []
            for d, text, hs in zip(batch.column(0), batch.column(1), batch.column(2)):
                ones = word_hashes((text.as_py() or "").encode().split())
                low = signed(_smallest(ones, length // 2))
                keep = np.isin(low, hs.values.to_numpy())
                a, b = (h[keep] for h in _both(ones, length))
                first = np.unique(a, return_index=True)[1]
                doc.append(d.as_py())
                one.append(a[first])
                two.append(b[first])
            if doc:
                yield pa.RecordBatch.from_arrays(_long_rows(doc, [one, two]), ["d", "a", "b"])

    near = texts.hint("merge").join(lists, "d").select("d", "text", "hs")
    return near.mapInArrow(run, "d long, a long, b long")


def earlier_lists(rows: DataFrame) -> DataFrame:
    """``d, gone``: per document the windows that a document of smaller id has as well."""
    first = rows.groupBy("a", "b").agg(F.min("d").alias("lo"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = first.select(F.col("a").alias("a1"), F.col("b").alias("b1"), "lo")
    # joined on one half of the hash, so that both sides are exchanged and adaptive
    # execution can split a hot window; the other half is compared as it meets
    again = rows.join(first, (F.col("a") == F.col("a1")) & (F.col("b").bitwiseXOR(F.col("b1")) == 0) & (F.col("d") > F.col("lo")))
    return again.groupBy("d").agg(F.collect_list("a").alias("gone"))


def copies(texts: DataFrame) -> DataFrame:
    """``d``: documents whose text is that of a document of smaller id.

    An id with several texts is not among them.
    """
    rows = texts.select("d", F.unhex(F.sha2("text", 256)).alias("digest"))
    groups = rows.groupBy("digest").agg(F.min("d").alias("lo"), F.count(F.lit(1)).alias("c")).where("c > 1")
    again = rows.join(written(groups.select("digest", "lo"), "substring-equal"), "digest", "left")
    whole = again.groupBy("d").agg(F.every(F.coalesce(F.col("d") > F.col("lo"), F.lit(False))).alias("copy"))
    return whole.where("copy").select("d")


def remove_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """Remove every word covered by a ``length``-word window that also starts earlier.

    Earlier means in a document of smaller id, or before it in the same document;
    windows are judged on the input. Returns ``doc_id, n_words, n_removed, text`` per
    row, ``text`` being the kept words joined by one space. ``length`` is even and 4 at
    least. Null and empty texts have no words; a null id is smaller than any other;
    rows with equal ids are not earlier than each other. An empty table gives no rows.
    Other columns are ignored.
    """
    half = length // 2
    texts = _texts(docs)
    # level 1: windows of half the length that occur in two documents
    lists = shared_lists(written(anchors(texts, half), "substring-anchors"))
    # a copy of a whole text has all its windows in the document of smaller id, which alone goes on
    same = written(copies(texts), "substring-copies")
    release_shuffles(docs.sparkSession)
    # level 2: extended to the full length
    gone = earlier_lists(candidates(texts, lists.join(same, "d", "left_anti"), length))
    # no document is in both: an empty list stands for all windows
    gone = gone.unionByName(same.select("d", F.array().cast("array<bigint>").alias("gone")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, hs in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                keep = np.ones(n, bool)
                if n >= length and hs.is_valid and not len(hs):
                    keep[:] = False
                elif n >= length:
                    hashes = signed(windows(word_hashes(words), length))
                    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                    again = first[which] != np.arange(len(hashes))
                    if hs.is_valid:
                        again |= np.isin(hashes, hs.values.to_numpy())
                    if again.any():
                        edge = np.zeros(n + 1, np.int64)
                        edge[: len(again)] += again
                        edge[length : length + len(again)] -= again
                        keep = np.cumsum(edge[:n]) == 0
                kept = int(keep.sum())
                for o, v in zip(out, (n, n - kept, b" ".join(words if kept == n else compress(words, keep)).decode())):
                    o.append(v)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["d", "n_words", "n_removed", "text"])

    # merged, not broadcast: lists grow with the corpus
    full = texts.hint("merge").join(gone, "d", "left").select("d", "text", "gone")
    done = full.mapInArrow(run, "d long, n_words long, n_removed long, text string")
    return done.select(given_id().alias("doc_id"), "n_words", "n_removed", "text")


def longest_repeats(docs: DataFrame, start: int = 10) -> DataFrame:
    """How long the repeats are: doubling from ``2 * start`` words until no candidate survives.

    Returns ``length, doc_id, windows``: at each length the number of distinct windows
    of a document that another document has too. Windows of one level go on to the
    next if the window that follows them directly is shared as well.
    """
    texts, level, out = _texts(docs), 2 * start, None
    lists = shared_lists(written(anchors(texts, start), "repeat-anchors"))
    rows = candidates(texts, lists, level)
    while True:
        rows = written(rows.dropDuplicates(["d", "a", "b"]), "repeat-level")
        ends = rows.groupBy("a", "b").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi")
        alive = written(rows.join(ends, ["a", "b"]).groupBy("d").agg(F.collect_list("a").alias("hs")), "repeat-lists")
        if alive.isEmpty():
            break
        named = alive.select(
            F.lit(level).alias("length"), given_id().alias("doc_id"), F.size("hs").cast("long").alias("windows")
        )
        out = named if out is None else out.unionByName(named)
        rows, level = _extended(texts, alive, level), level * 2
    return out if out is not None else docs.sparkSession.createDataFrame([], "length int, doc_id long, windows long")


def _extended(texts: DataFrame, alive: DataFrame, length: int) -> DataFrame:
    """Windows of twice the length whose two halves are both shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, one, two = [], [], []
            for d, text, hs in zip(batch.column(0), batch.column(1), batch.column(2)):
                ones = word_hashes((text.as_py() or "").encode().split())
                shared = np.isin(signed(windows(ones, length)), hs.values.to_numpy())
                a, b = _both(ones, 2 * length)
                keep = (shared[: len(a)] & shared[length : length + len(a)]) if len(a) else np.zeros(0, bool)
                first = np.unique(a[keep], return_index=True)[1]
                doc.append(d.as_py())
                one.append(a[keep][first])
                two.append(b[keep][first])
            if doc:
                yield pa.RecordBatch.from_arrays(_long_rows(doc, [one, two]), ["d", "a", "b"])

    return texts.hint("merge").join(alive, "d").select("d", "text", "hs").mapInArrow(run, "d long, a long, b long")
