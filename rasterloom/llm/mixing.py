"""Mixing sources to target weights by a low-discrepancy schedule.

Slot ``n`` of the schedule gets the golden-ratio point ``frac(n * phi)``, kept as
an integer so that every run and engine agrees; the point falls into the
interval of cumulative target shares that belongs to a source. The slots of a
source, ranked, take that source's blocks in turn. Blocks hold equally many words
of the source's documents in a shuffled (hash) order, read at most
``max_epochs`` times. A source whose target is a few blocks only would be missed by the
points, or hit too often: it has shorter blocks of its own, in slots at even distances.

Ranks and word offsets are running sums in levels: inside bounded chunks, over
chunk totals, over totals of totals. No window ever holds all rows of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rasterloom.llm.shared import SPACE, SPACE_CHARS, n_words, row_struct, with_text, written

#: 2**32 divided by the golden ratio, and the number of points.
GOLDEN, POINTS = 2654435769, 1 << 32
#: Rows of one chunk of a running sum on average, and chunks of one chunk above.
CHUNK_ROWS, FAN = 500, 1000
#: Equal parts of the point range; slots and source intervals meet in them.
CELLS = 4096
#: A block has at most this many words, and small corpora get about this many slots.
BLOCK_WORDS, LEAST_SLOTS = 4096, 1 << 17
#: A source with a target of fewer blocks than this gets about so many shorter ones.
OWN_BLOCKS = 128


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """``source, rank, weight, source_size, target``, one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes. A target stops at ``max_epochs`` times its source's
    size; the excess goes to the others by weight until none is above. The fixpoint
    is a level per weight: with sources ordered by cap per weight, the level implied
    by capping the first k rises until k is right and falls afterwards.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * max_epochs
    ranked = (
        by_source.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("weight", turn)
        .withColumn("cap", cap)
    )
    before = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.col("capped")) / F.col("open")
    levels = (
        ranked.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(everything))
    )
    return levels.select(
        "source", "rank", "weight", "source_size",
        F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def running_total(df: DataFrame, group: str, chunk: str, n_chunks: int, order: list, value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over all earlier rows of a group.

    ``chunk`` rises with ``order``; a window holds one chunk, or ``FAN`` chunk totals.
    """
    totals = df.groupBy(group, chunk).agg(F.sum(value).alias("_t"))
    if n_chunks <= FAN:
        ahead = W.partitionBy(group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
        starts = totals.withColumn("_start", F.coalesce(F.sum("_t").over(ahead), F.lit(0)))
    else:
        up = totals.withColumn(f"_{chunk}", F.floor(F.col(chunk) / FAN))
        starts = running_total(up, group, f"_{chunk}", -(-n_chunks // FAN), [chunk], F.col("_t"), "_start")
    inside = W.partitionBy(group, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    # the result of a level above is itself named _start
    return (
        df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts.select(group, chunk, F.col("_start").alias("_ahead")), [group, chunk])
        .withColumn(name, (F.col("_in") + F.col("_ahead")).cast("long"))
        .drop("_in", "_ahead")
    )


def shuffle_key(seed: int = 0) -> Column:
    """60 hash bits of a document's id: its place in the shuffled source."""
    text = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def has_own_blocks(block: int) -> Column:
    return F.col("target") < OWN_BLOCKS * block


def block_length(block: int) -> Column:
    """Words of a block of the source with a ``target``."""
    own = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("target") / OWN_BLOCKS).cast("long"))
    return F.when(has_own_blocks(block), own).otherwise(F.lit(block).cast("long"))


def mix(
    docs: DataFrame,
    weights=(5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    block_words: int | None = None,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Schedule of the mix, and the sizes it rests on.

    Returns ``(pieces, placed)``. ``pieces`` has a row per block part of a document
    that the mix takes: ``slot, source, rank, block, doc_id, row_key, start, epoch,
    word_from, word_to`` (words of the document, end exclusive). ``placed`` has
    ``doc_id, source, rank, size, row_key, start, source_size, target`` per document;
    ``start`` is its first word's place in its source. A slot that a source with blocks
    of its own takes has the number of the slot that it stands beside.

    A null text has size 0 and is never taken; a null source is a source; documents
    with equal ids follow each other by size. Empty tables give empty results.
    Sources without words have target 0. Other columns of ``docs`` are ignored.
    """
    sized = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size")),
        "mix-sizes",
    )
    n_rows, n_all = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    total = int(n_all * share)
    block = block_words or max(1, min(BLOCK_WORDS, total // LEAST_SLOTS))
    targets = written(source_targets(sized, weights, share, max_epochs), "mix-targets")

    n_chunks = max(1, n_rows // CHUNK_ROWS)
    of_source = targets.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    keyed = (
        sized.withColumn("row_key", shuffle_key(seed))
        .withColumn("chunk", F.floor(F.shiftright("row_key", 30) * n_chunks / (1 << 30)))
        .join(of_source, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
    )
    order = ["row_key", F.col("doc_id").asc_nulls_last(), "size"]
    placed = running_total(keyed, "rank", "chunk", n_chunks, order, F.col("size"), "start").drop("chunk")

    # slots: points of the golden ratio, mapped through the cumulative shares
    n_slots = -(-total // block)
    ahead = W.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    whole = F.sum("target").over(W.partitionBy())
    lo = F.floor(F.coalesce(F.sum("target").over(ahead), F.lit(0.0)) / whole * POINTS).cast("long")
    bounds = targets.where("target > 0").select("rank", lo.alias("lo"))
    bounds = bounds.withColumn("hi", F.coalesce(F.lead("lo").over(W.orderBy("rank")), F.lit(POINTS)))
    cell = POINTS // CELLS
    small = targets.where(F.col("target") > 0).where(has_own_blocks(block)).select("rank", block_length(block).alias("words"), "target")
    cells = bounds.where("lo < hi").join(small.select("rank"), "rank", "left_anti").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell)))
    )
    slots = docs.sparkSession.range(n_slots).select(
        F.col("id").alias("slot"), (F.col("id") % (1 << 31) * GOLDEN % POINTS).alias("point")
    )
    hit = (
        slots.withColumn("cell", F.floor(F.col("point") / cell))
        .join(cells, "cell")
        .where("point >= lo AND point < hi")
        .select("slot", "rank", F.floor(F.col("slot") / CHUNK_ROWS).alias("part"))
    )
    n_parts = max(1, -(-n_slots // CHUNK_ROWS))
    ranked = running_total(hit, "rank", "part", n_parts, ["slot"], F.lit(1), "block").drop("part")
    # small sources: as many blocks as come nearest to the target, at even distances
    many = F.greatest(F.lit(1).cast("long"), F.round(F.col("target") / F.col("words")).cast("long"))
    own = small.withColumn("many", many).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)))
    beside = F.floor((2 * F.col("block") + 1) * n_slots / (2 * F.col("many"))).cast("long")
    ranked = ranked.select("slot", "rank", "block").unionByName(own.select(beside.alias("slot"), "rank", "block"))

    # block parts of documents, once per epoch
    at, size, words = F.col("at"), F.col("size"), F.col("words")
    parts = (
        placed.where("size > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
        .withColumn("at", F.col("epoch") * F.col("source_size") + F.col("start"))
        .withColumn("words", block_length(block))
        .withColumn("block", F.explode(F.sequence(F.floor(at / words), F.floor((at + size - 1) / words))))
    )
    pieces = parts.join(ranked, ["rank", "block"]).select(
        "slot", "source", "rank", "block", "doc_id", "row_key", "start", "epoch",
        F.greatest(F.col("block") * words - at, F.lit(0)).alias("word_from"),
        F.least((F.col("block") + 1) * words - at, size).alias("word_to"),
    )
    return pieces, placed


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken`` of a mix."""
    pieces, placed = mix(docs, **options)
    # a document with words has a start of its own in its source, whatever its id
    taken = pieces.groupBy("rank", "start").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    none = F.lit(0).cast("long")
    columns = ["doc_id", "size", "source_size", "target"]
    some = placed.where("size > 0").join(taken, ["rank", "start"], "left")
    return some.select(*columns, F.coalesce("taken", none).alias("taken")).unionByName(
        placed.where("size = 0").select(*columns, none.alias("taken"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, once per epoch, with the columns of ``docs``.

    A document of which the mix takes a part is cut to those words, joined by one
    space, and its ``n_chars`` follows. Documents with equal id, source and size take
    the places of their group in an arbitrary but even way.
    """
    pieces, _ = mix(docs, **options)
    takes = pieces.groupBy("row_key", "doc_id", "source", "start", "epoch").agg(
        F.min("word_from").alias("first"), F.max("word_to").alias("end")
    )
    takes = takes.groupBy("row_key", "doc_id", "source", "start").agg(
        F.sort_array(F.collect_list(F.struct("epoch", "first", "end"))).alias("takes")
    )
    same = ["row_key", "id", "of"]
    takes = takes.select("row_key", F.col("doc_id").alias("id"), F.col("source").alias("of"), "start", "takes")
    takes = takes.withColumn("turn", F.row_number().over(W.partitionBy(*same).orderBy("start"))).drop("start")
    mine = docs.where(n_words(F.col("text")) > 0).select(
        shuffle_key(options.get("seed", 0)).alias("key"),
        n_words(F.col("text")).alias("size"),
        row_struct(docs),
    )
    mine = mine.withColumn("n", F.row_number().over(W.partitionBy("key", "row.doc_id", "row.source").orderBy("size")))
    joined = mine.join(
        takes,
        (F.col("key") == F.col("row_key"))
        & F.col("row.doc_id").cast("long").eqNullSafe(F.col("id"))
        & F.col("row.source").eqNullSafe(F.col("of"))
        & (F.col("n") == F.col("turn")),
    ).withColumn("take", F.explode("takes"))
    first, end, text = F.col("take.first"), F.col("take.end"), F.col("row.text")
    words = F.split(F.btrim(text, F.lit(SPACE_CHARS)), f"[{SPACE}]+")
    part = F.array_join(F.filter(words, lambda w, i: (i >= first) & (i < end)), " ")
    out = joined.withColumn("cut", F.when((first == 0) & (end == F.col("size")), text).otherwise(part))
    return with_text(out, docs, "cut")
