"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. The vector of an
n-gram binds the vectors of its letters (element-wise product), each permuted (rotated) by its
distance from the last letter. Bundling adds: a text is the sum of the vectors of its n-grams, a language
prototype the sum over all its texts. Since bundling is linear, Spark adds the
n-gram counts of a language first and binds each distinct n-gram once. A text goes
to the prototype of largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.llm.sentencepiece_codec import portions
from rasterloom.llm.shared import written

DIMENSIONS, GRAM = 2048, 3
#: Prototypes that scoring tasks hold at once (2048 doubles each, 16 MB in all); more are gone through in blocks.
PROTOTYPES = 1024
#: Vectors a task remembers; they are drawn anew beyond that.
REMEMBERED = 8192
UNKNOWN = "und"
_BITS = np.uint64(21)
_LETTER = np.uint64((1 << 21) - 1)


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vector of a code point: the same on every machine and in every run."""
    bits = np.random.Generator(np.random.PCG64([code, 0x1A9])).integers(0, 2, dimensions, np.int8)
    return bits * np.int8(2) - np.int8(1)


class Space:
    """Letter and n-gram vectors of a task, and texts as counted n-grams."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram = dimensions, gram
        self.letters: dict[tuple[int, int], np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.table = np.empty((REMEMBERED, dimensions), np.int8)
        self.is_letter: dict[int, bool] = {}

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of a text and how often each occurs; none where the text has no letter.

        Letters are lower-cased, everything else parts words. A word has a gap on both sides, which counts as a letter.
        """
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, where = np.unique(codes, return_inverse=True)
        known = self.is_letter
        for k in kinds.tolist():
            if k not in known:
                known[k] = chr(k).isalpha()
        letter = np.array([known[k] for k in kinds.tolist()], bool)[where]
        if not letter.any():
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.uint64)
        gap = codes == 32
        codes = codes[~(gap & np.concatenate([[False], gap[:-1]]))]
        n = len(codes) - self.gram + 1
        if n < 1:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys = codes[:n].copy()
        for k in range(1, self.gram):
            keys = (keys << _BITS) | codes[k : k + n]
        return np.unique(keys, return_counts=True)

    def bind(self, key: int) -> np.ndarray:
        out = None
        for turn in range(self.gram):
            code = (key >> (21 * turn)) & 0x1FFFFF
            vector = self.letters.get((code, turn))
            if vector is None:
                if len(self.letters) >= REMEMBERED:
                    self.letters.clear()
                vector = self.letters[code, turn] = np.roll(letter_vector(code, self.dimensions), turn)
            out = vector if out is None else out * vector
        return out

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the n-grams' vectors, each as often as it counts; exact, in doubles."""
        total = np.zeros(self.dimensions)
        for s in range(0, len(keys), REMEMBERED // 4):
            part, weight = keys[s : s + REMEMBERED // 4].tolist(), counts[s : s + REMEMBERED // 4]
            if len(self.place) + len(part) > REMEMBERED:
                self.place.clear()
            rows = []
            for key in part:
                at = self.place.get(key)
                if at is None:
                    at = self.place[key] = len(self.place)
                    self.table[at] = self.bind(key)
                rows.append(at)
            # single precision holds whole numbers up to 2^24
            kind = np.float32 if weight.sum() < 1 << 24 else np.float64
            total += weight.astype(kind) @ self.table[rows].astype(kind)
        return total


def gram_counts(rows: DataFrame, gram: int) -> DataFrame:
    """``lang, gram, n`` over all rows of ``lang, text``; tasks add up before anything moves."""
    limit = 1 << 18

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(1, gram)
        sums: dict[str, dict[int, int]] = {}
        size = 0

        def out():
            for lang, counted in sums.items():
                keys, counts = np.fromiter(counted.keys(), np.int64), np.fromiter(counted.values(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts = space.grams(text.as_py())
                held = sums.setdefault(lang, {})
                size -= len(held)
                for k, c in zip(keys.tolist(), counts.tolist()):
                    held[k] = held.get(k, 0) + c
                size += len(held)
                if size > limit:
                    yield from out()
                    sums.clear()
                    size = 0
        yield from out()

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def prototypes(counts: DataFrame, dimensions: int, gram: int) -> DataFrame:
    """``lang, vector array<double>``: n-grams bundled in every task, the tasks' vectors added per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dimensions, gram)
        sums: dict[str, np.ndarray] = {}

        def out():
            if sums:
                vectors = pa.array([v for v in sums.values()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), vectors], ["lang", "vector"])

        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            which, keys, n = lang.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i, name in enumerate(lang.dictionary.to_pylist()):
                mine = which == i
                part = space.bundle(keys[mine].view(np.uint64), n[mine])
                sums[name] = sums[name] + part if name in sums else part
                if len(sums) >= PROTOTYPES:
                    yield from out()
                    sums.clear()
        yield from out()

    parts = counts.mapInArrow(run, "lang string, vector array<double>")
    added = parts.select("lang", F.posexplode("vector").alias("pos", "x")).groupBy("lang", "pos").agg(F.sum("x").alias("x"))
    return added.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("vector"))


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, gram: int = GRAM) -> DataFrame:
    """Prototypes ``lang, vector, place`` of all rows of ``lang, text`` whose language is known.

    ``place`` numbers the languages in blocks of ``PROTOTYPES``. Rows without a letter add nothing;
    a language without any n-gram has no prototype.
    """
    counts = written(gram_counts(docs.where("lang is not null and text is not null").select("lang", "text"), gram), "gram-counts")
    return written(prototypes(counts, dimensions, gram), "prototypes")


def predict(docs: DataFrame, profiles: DataFrame, dimensions: int = DIMENSIONS, gram: int = GRAM, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred, score`` to every row of ``docs`` from its text alone.

    ``profiles`` is what ``learn`` returns. ``score`` is the cosine with the nearest
    prototype, 0 where it is negative; of equal ones the smallest language name wins. A null
    text, one without a letter, and any text when nothing was learned are ``und`` with score 0.
    Columns of ``docs`` named ``lang_pred`` or ``score`` are replaced, all others stay.
    """
    names = [r.lang for r in profiles.select("lang").sort("lang").toLocalIterator()]
    blocks = [names[s : s + PROTOTYPES] for s in range(0, len(names), PROTOTYPES)] or [[]]
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("string").alias("lang_pred"), F.lit(-2.0).alias("score"))
    for i, block in enumerate(blocks):
        rows = {r.lang: r.vector for r in profiles.where(F.col("lang").between(block[0], block[-1])).toLocalIterator()} if block else {}
        vectors = np.array([rows[name] for name in block]).reshape(len(block), dimensions)
        lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)
        found = found.mapInArrow(_scorer(block, vectors, dimensions, gram, text_col, i == len(blocks) - 1), found.schema)
    return found


def _scorer(names: list[str], vectors: np.ndarray, dimensions: int, gram: int, text_col: str, last: bool):
    """One pass over the rows that betters ``lang_pred`` and ``score`` by a block of prototypes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dimensions, gram)
        for batch in batches:
            for part in portions(batch):
                best, score = part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()
                for i, text in enumerate(part.column(text_col)):
                    keys, counts = space.grams(text.as_py())
                    if len(keys) and names:
                        bundle = space.bundle(keys, counts)
                        length = np.linalg.norm(bundle)
                        cosines = vectors @ (bundle / length) if length else np.zeros(len(names))
                        top = int(np.argmax(cosines))
                        if cosines[top] > score[i]:
                            best[i], score[i] = names[top], float(cosines[top])
                if last:
                    score = [0.0 if b is None else min(1.0, max(0.0, s)) for b, s in zip(best, score)]
                    best = [UNKNOWN if b is None else b for b in best]
                columns = [*part.columns[:-2], pa.array(best, part.schema.field(part.num_columns - 2).type), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return run


def identify(docs: DataFrame, held_out: Column, dimensions: int = DIMENSIONS, gram: int = GRAM) -> DataFrame:
    """Learn from all rows of ``docs`` that are not held out, predict every row.

    Returns ``doc_id, held_out, lang_pred, score``. Only ``lang`` and ``text`` are learned from,
    only ``text`` is predicted from. Rows that repeat count each; an empty table gives no rows.
    """
    profiles = learn(docs.where(~held_out), dimensions, gram)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return predict(rows, profiles, dimensions, gram).select("doc_id", "held_out", "lang_pred", "score")
