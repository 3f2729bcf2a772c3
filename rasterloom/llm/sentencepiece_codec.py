"""SentencePiece encoding and decoding through a table of distinct chunks.

In a BPE model none of whose pieces holds a whitespace marker after another
character, no merge crosses from a word into the marker of the next one. A text
then falls into chunks (markers followed by a word) that are encoded on their
own. Each task segments every distinct chunk once and joins the ids back by
position; a model without that property is encoded text by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
CHUNK = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
#: Distinct chunks a task remembers; the table starts anew beyond that.
TABLE_ROWS = 500_000


def splits_at_markers(sp) -> bool:
    """Whether chunks can be encoded on their own with this model."""
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        return False
    # leading spaces must survive, and a text must get one marker of its own in front
    return sp.encode("   a") == sp.encode(f"  {MARK}a") and sp.decode(sp.encode("  a  b ")) == "  a  b "


class ChunkTable:
    """Ids of distinct chunks, and texts encoded by looking chunks up in it."""

    def __init__(self, sp, rows: int = TABLE_ROWS):
        self.sp, self.rows, self.ids, self.by_chunk = sp, rows, {}, splits_at_markers(sp)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not self.by_chunk:
            return self.sp.encode(text)
        table, out = self.ids, []
        # the encoder puts a marker in front of each chunk, which is the chunk's first space
        for chunk in CHUNK.findall(" " + text):
            known = table.get(chunk)
            if known is None:
                if len(table) >= self.rows:
                    table.clear()
                # nothing but a marker is what the encoder calls an empty text
                known = table[chunk] = self.sp.encode(chunk[1:]) if len(chunk) > 1 else [self.sp.piece_to_id(MARK)]
            out += known
        return out


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Encode every text and decode the ids again, without begin and end ids.

    Returns ``doc_id, ids array<int>, decoded`` per row, and ``text`` if asked for. Null
    and empty texts have no ids and decode to ''. Repeated rows and ids are kept, null
    ids too; an empty table gives no rows. ``model`` is a path that every executor can
    read. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        table = ChunkTable(sp)
        for batch in batches:
            for part in portions(batch):
                ids = [table.encode(t.as_py()) for t in part.column(1)]
                decoded = pa.array([sp.decode(i) for i in ids], pa.string())
                columns = [part.column(0), pa.array(ids, pa.list_(pa.int32())), decoded]
                names = ["doc_id", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(*((columns + [part.column(1)], names + ["text"]) if keep_text else (columns, names)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string" + (", text string" if keep_text else ""))


def portions(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes; a part has a row at least."""
    rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch[start : start + rows]
