"""Alignment of two tokenizers over the same bytes, as an Arrow pipeline inside Spark tasks.

A block of texts becomes two flat token columns: the ids per distinct chunk are taken
once, lists are flattened, parent indices name each token's document, and segmented
running sums of token lengths give byte ends. An Acero hash join of both columns on the
document-end key yields every distinct end once; there exactly one A token and one B token
hold the byte before it, so the joined rows, in order, are the links. ``Table.group_by``
counts id pairs per block, Spark merges the counts, and every block gets back the
totals of the pairs that it holds.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from rasterloom.llm.sentencepiece_codec import portions, splits_at_markers
from rasterloom.llm.shared import written

#: Bytes of text in one block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Chunks that are encoded at once.
PART = 2048
#: A chunk starts at a space after a visible character, or at a line end between two: neither tokenizer crosses there.
BREAK = re.compile("(?<=[!-~¡-ɏ])(?= |\n[!-~¡-ɏ])")
#: Bits of a key that hold the byte end within a document.
END_BITS = 36
PAIR_BITS = 32

ALIGNED = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pair array<int>, times array<int>, pairs array<long>, sums array<long>"
)
ARROW = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64())]
    + [("groups_sha256", pa.string()), ("pair", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
    + [("pairs", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))]
)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where visible, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Coder:
    """Both tokenizers of a task, with the bytes and decimal digits of every id."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names]
        self.bytes = [pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes)]
        self.lengths = [pa.array([len(t) for t in x], pa.int64()) for x in (a_bytes, b_bytes)]
        self.digits = [pa.array(map(str, range(len(x))), pa.large_string()) for x in (a_bytes, b_bytes)]
        state = tokenizers.Tokenizer.to_str(self.a)
        plain = '"normalizer":null' in state and re.search(r'"pre_tokenizer":\{"type":"ByteLevel"[^}]*"use_regex":true', state)
        self.lone = self.b.piece_to_id("▁")
        line_ends = not any("\n" in name for name in names) and self.b.encode("\na")[0] == self.lone
        self.by_chunk = bool(plain) and line_ends and splits_at_markers(self.b)

    def chunks(self, text: str) -> list[str]:
        return BREAK.split(" " + text) if self.by_chunk else [" " + text]

    def encode(self, chunks: list[str]) -> list[pa.Array]:
        """Ids of each chunk, by A as it stands and by B, which puts a space in front of its own accord."""
        parts = []
        # in small parts: what the encoders return holds far more than the ids
        for s in range(0, len(chunks), PART):
            part = chunks[s : s + PART]
            a = [e.ids for e in self.a.encode_batch_fast(part, add_special_tokens=False)]
            b = self.b.encode([c.removeprefix(" ") for c in part], num_threads=1)
            # before a line end that space stands alone and goes again; a chunk of one space is what B calls an empty text
            b = [(ids if len(c) > 1 else [self.lone]) if c[0] == " " else ids[1:] for c, ids in zip(part, b)]
            parts.append([pa.array(x, pa.list_(pa.int32())) for x in (a, b)])
        return [pa.concat_arrays([p[k] for p in parts] or [pa.array([], pa.list_(pa.int32()))]) for k in (0, 1)]


def _joined(lists: pa.ListArray, table: pa.Array) -> pa.Array:
    """Bytes of every list of ids."""
    return pc.binary_join(pa.LargeListArray.from_arrays(lists.offsets.cast(pa.int64()), table.take(lists.values)), pa.scalar(b"", pa.large_binary()))


def _offsets(owner: np.ndarray, n: int) -> np.ndarray:
    """Where the elements of each of ``n`` owners start, for elements in their order."""
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def align_block(coder: Coder, ids: pa.Array, texts: pa.Array, block: int) -> Iterator[pa.RecordBatch]:
    """A row per document, and one with the block's id pairs and their counts."""
    n = len(texts)
    known = texts.to_pylist()
    chunks = pa.array([coder.chunks(t) if t else [] for t in known], pa.list_(pa.string()))
    owner = pc.list_parent_indices(chunks).cast(pa.int64())
    words = chunks.flatten().dictionary_encode()
    coded = coder.encode(words.dictionary.to_pylist())

    # a document counts if the bytes of its tokens are its text; only those with an odd chunk are put together whole
    plain = words.dictionary.cast(pa.large_binary())
    joined = [_joined(lists, table) for lists, table in zip(coded, coder.bytes)]
    right = pc.and_(pc.equal(joined[0], plain), pc.equal(joined[1], plain))
    odd = pc.unique(owner.filter(pc.invert(right.take(words.indices)))).to_pylist()
    fits = np.array([bool(t) for t in known], bool)
    starts = chunks.offsets.to_pylist() if odd else []
    for d in odd:
        at = words.indices.slice(starts[d], starts[d + 1] - starts[d])
        fits[d] = all(b"".join(j.take(at).to_pylist()) == (" " + known[d]).encode() for j in joined)
    if odd:
        use = pa.array(fits).take(owner)
        owner, occurring = owner.filter(use), words.indices.filter(use)
    else:
        occurring = words.indices

    # segmented running sums: the bytes before a document are taken off the sum over the block
    sizes = np.where(fits, [1 + len(t.encode()) if t else 0 for t in known], 0).astype(np.int64)
    base = pa.array(np.cumsum(sizes) - sizes)
    sides = []
    for lists, lengths in zip(coded, coder.lengths):
        per_chunk = lists.take(occurring)
        token = per_chunk.flatten()
        doc = owner.take(pc.list_parent_indices(per_chunk))
        end = pc.subtract(pc.cumulative_sum(lengths.take(token)), base.take(doc))
        sides.append((token, doc, pc.add(pc.shift_left(doc, pa.scalar(END_BITS, pa.int64())), end)))
    (a, a_doc, a_key), (b, b_doc, b_key) = sides
    ends = pa.table({"key": a_key, "a": a}).join(pa.table({"key": b_key, "b": b}), "key", join_type="full outer", use_threads=False)
    ends = ends.take(pc.sort_indices(ends["key"])).combine_chunks()
    link_doc = pc.shift_right(ends["key"], pa.scalar(END_BITS, pa.int64()))
    in_a, in_b = pc.is_valid(ends["a"]), pc.is_valid(ends["b"])
    common = pc.and_(in_a, in_b)

    # the last token of a document always ends a group, so no group holds tokens of two documents
    texts_of = []
    for token, digits, mask in ((a, coder.digits[0], common.filter(in_a)), (b, coder.digits[1], common.filter(in_b))):
        cut = np.flatnonzero(np.asarray(mask.combine_chunks())) + 1
        offsets = pa.array(np.concatenate([[0], cut]), pa.int64())
        texts_of.append(pc.binary_join(pa.LargeListArray.from_arrays(offsets, digits.take(token)), pa.scalar(",", pa.large_string())))
    groups = pc.binary_join_element_wise(*texts_of, pa.scalar("|", pa.large_string()))
    group_doc = np.asarray(link_doc.filter(common).combine_chunks())
    by_doc = pa.LargeListArray.from_arrays(pa.array(_offsets(group_doc, n)), groups)
    lines = pc.binary_join(by_doc, pa.scalar(";", pa.large_string()))
    sha = [hashlib.sha256(x.as_buffer()).hexdigest() if f else "" for x, f in zip(lines, fits)]

    # every distinct end is one link: the next A end and the next B end belong to the tokens that hold the byte before it
    filled = [pc.fill_null_backward(ends[c].combine_chunks()).cast(pa.int64()) for c in "ab"]
    pair = pc.add(pc.shift_left(filled[0], pa.scalar(PAIR_BITS, pa.int64())), filled[1])
    counts = pa.table({"doc": link_doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    counts = counts.take(pc.sort_indices(counts["doc"])).combine_chunks()
    index = counts["pair"].combine_chunks().dictionary_encode()
    whole = pa.table({"i": index.indices, "n": counts["count_all"]}).group_by("i", use_threads=False).aggregate([("n", "sum")])
    whole = whole.take(pc.sort_indices(whole["i"])).combine_chunks()
    offsets = pa.array(_offsets(np.asarray(counts["doc"].combine_chunks()), n), pa.int32())

    def per_doc(owners) -> pa.Array:
        return pa.array(np.bincount(np.asarray(owners), minlength=n), pa.int64())

    def nothing(kind) -> pa.Array:
        return pa.nulls(n, kind)

    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, block), pa.int64()), ids, per_doc(a_doc), per_doc(b_doc), per_doc(group_doc),
            per_doc(link_doc.combine_chunks()), pa.array(sha, pa.string()),
            pa.ListArray.from_arrays(offsets, index.indices.cast(pa.int32())),
            pa.ListArray.from_arrays(offsets, counts["count_all"].combine_chunks().cast(pa.int32())),
            nothing(pa.list_(pa.int64())), nothing(pa.list_(pa.int64())),
        ],
        schema=ARROW,
    )
    row = {f.name: None for f in ARROW} | {"block": block, "pairs": index.dictionary.to_numpy(), "sums": whole["n_sum"].to_numpy()}
    yield pa.RecordBatch.from_pylist([row], schema=ARROW)


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align the tokens of a byte-level BPE (A) and of a SentencePiece model (B) over every whole text.

    Returns ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row. A
    reads a space and the text, B adds that space itself. Null and empty texts, and texts
    that the bytes of either side's tokens do not give back, have no tokens: zeros and ''.
    Rows that repeat an id or a text are each aligned and each count towards the pair
    totals; null ids stay null; an empty table gives no rows. A very long text is a
    block of its own. Both paths must be readable on every executor. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pa.set_cpu_count(1)
        coder = Coder(byte_level, pieces)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in portions(batch, BLOCK_BYTES):
                yield from align_block(coder, part.column(0), part.column(1), block)
                block += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    aligned = written(rows.mapInArrow(run, ALIGNED), "aligned")

    held = aligned.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "sums")).alias("pos", "p"))
    held = held.select(F.col("block").alias("home"), "pos", F.col("p.pairs").alias("key"), F.col("p.sums").alias("n"))
    totals = held.groupBy("key").agg(F.sum("n").alias("total"))
    # rows of one B id: at most as many as A has ids
    same_b = Window.partitionBy(F.col("key").bitwiseAND((1 << PAIR_BITS) - 1))
    totals = written(totals.withColumn("best", F.col("total") == F.max("total").over(same_b)), "pair-totals")
    wanted = held.select("home", "pos", "key").join(totals, "key").select("home", "pos", "total", "best")

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        totals = right.take(pc.sort_indices(right["pos"])).combine_chunks()
        pair, times = (left[c].combine_chunks() for c in ("pair", "times"))
        owner, index = pc.list_parent_indices(pair), pair.flatten()
        times = times.flatten().cast(pa.int64())
        add = pa.table(
            {
                "doc": owner,
                "count_sum": pc.multiply(times, totals["total"].take(index)),
                "n_best": pc.if_else(totals["best"].take(index), times, 0),
            }
        )
        sums = add.group_by("doc", use_threads=False).aggregate([("count_sum", "sum"), ("n_best", "sum")])
        whole = [np.zeros(len(left), np.int64) for _ in range(2)]
        for out, c in zip(whole, ("n_best_sum", "count_sum_sum")):
            out[sums["doc"].to_numpy()] = sums[c].to_numpy()
        return pa.table([*left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).columns, *map(pa.array, whole), left["groups_sha256"]], schema=FOUND)

    documents = aligned.where("pairs is null").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "times")
    return documents.groupBy("block").cogroup(wanted.groupBy("home")).applyInArrow(look_up, RESULT)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
FOUND = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])
