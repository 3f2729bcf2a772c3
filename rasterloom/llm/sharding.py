"""Sharding by extendible hashing.

A directory indexed by hash-prefix bits points at shards. A shard that is above
its byte limit is split on the next bit, and only such shards are, so shard
names are bit strings of different lengths and a growing corpus moves few
documents. Bytes are summed once per fine prefix; the directory is the set of
tree nodes that fit while their parents do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.shared import written

#: Bits looked at beyond the expected depth, so that a first pass settles most prefixes.
SPARE_BITS = 4
#: Hash bits of a document; equal hashes are equal documents.
HASH_BITS = 128


def _bits(hex32) -> F.Column:
    def half(start: int):
        return F.lpad(F.conv(F.substring(hex32, start, 16), 16, 2), 64, "0")

    return F.concat(half(1), half(17))


def sized_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, bits, bytes, copies``: one row per distinct document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.sha2(text, 256))).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    rows = rows.groupBy("digest", "doc_id", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    return rows.withColumn("bits", _bits(F.col("digest")))


def directory(keys: DataFrame, limit: int) -> DataFrame:
    """Shards as ``shard, depth, shard_bytes, shard_docs`` plus the fine prefixes they own.

    Returns a row per fine prefix: ``prefix`` (its bits), ``shard`` (the leading bits
    that name its shard), ``shard_bytes``, ``shard_keys``.
    """
    mass = F.col("bytes") * F.col("copies")
    total = keys.agg(F.coalesce(F.sum(mass), F.lit(0))).first()[0]
    depth = min(HASH_BITS, max(1, -(-int(total) // max(1, limit))).bit_length() + SPARE_BITS)
    done, pending, floor = None, keys, 0
    while True:
        cells = pending.groupBy(F.substring("bits", 1, depth).alias("prefix")).agg(
            F.sum(mass).alias("bytes"), F.count(F.lit(1)).alias("keys")
        )
        # every prefix of a cell below the bits already split is a node of the tree
        nodes = cells.withColumn("d", F.explode(F.sequence(F.lit(floor), F.lit(depth))))
        nodes = nodes.withColumn("node", F.expr("substring(prefix, 1, d)"))
        sums = nodes.groupBy("node", "d").agg(F.sum("bytes").alias("shard_bytes"), F.sum("keys").alias("shard_keys"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_keys") == 1) | (F.col("d") == HASH_BITS)
        # fitting is inherited, so a cell's shard is its shortest prefix that fits
        owner = (
            nodes.select("prefix", "node", "d")
            .join(sums.where(fits).drop("d"), "node")
            .groupBy("prefix")
            .agg(F.min(F.struct("d", "node", "shard_bytes", "shard_keys")).alias("s"))
            .select("prefix", F.col("s.node").alias("shard"), "s.shard_bytes", "s.shard_keys")
        )
        found = written(owner, "shard-directory")
        done = found if done is None else done.unionByName(found)
        if depth == HASH_BITS:
            return done
        open_cells = cells.join(found, "prefix", "left_anti").select(F.col("prefix").alias("_open"))
        rest = pending.join(open_cells, F.substring("bits", 1, depth) == F.col("_open"), "left_semi")
        rest = written(rest, "shard-pending")
        if rest.isEmpty():
            return done
        pending, floor, depth = rest, depth + 1, min(HASH_BITS, depth + 8)


def extendible_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every document to a shard of at most ``limit`` bytes of text.

    Returns ``doc_id, shard, page, depth, bytes, shard_bytes`` per row of ``docs``.
    ``shard`` names the hash prefix; the whole table may be one shard named ''.
    A single document above the limit is a shard of its own. Rows equal in id and
    text have equal hashes, which no bit can part: copies beyond the limit go to
    overflow pages 1, 2, ... of their shard, each within the limit; everything else
    has page 0, and ``shard_bytes`` counts all pages. Null texts have 0 bytes, null
    ids hash as an empty id. An empty table gives no rows. Other columns are ignored.
    """
    keys = written(sized_keys(docs, id_col, text_col), "shard-keys")
    cells = directory(keys, limit)
    widths = [r[0] for r in cells.select(F.length("prefix")).distinct().collect()]  # one per pass
    each = F.explode(F.array(*[F.lit(w) for w in widths] or [F.lit(0)]))
    # a key finds its cell under exactly one of the widths
    routed = keys.withColumn("_w", each).withColumn("prefix", F.expr("substring(bits, 1, _w)"))
    placed = routed.join(cells, "prefix").withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    )
    fit = F.greatest(F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1))), F.lit(1))
    alone = (F.col("shard_keys") == 1) & (F.col("copies") > 1)
    return placed.select(
        "doc_id",
        "shard",
        F.when(alone, F.floor(F.col("copy") / fit)).otherwise(F.lit(0)).cast("long").alias("page"),
        F.length("shard").alias("depth"),
        "bytes",
        "shard_bytes",
    )
