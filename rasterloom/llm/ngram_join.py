"""Similarity join of n-gram sets through prefix trees.

A set is ordered by a global order, rare n-grams first. Two sets that are similar
enough share an n-gram among the first few of both (their prefixes), so every
n-gram names as its *leader* the smallest document that has it in its prefix, and
the sets that follow one leader meet in one cell. Each cell is a prefix tree of
whole sets, frequent n-grams first, so that similar sets share paths; a set walks
the tree with the overlap it has so far and leaves a subtree when what remains of
either set cannot reach the threshold, or when all of the subtree is already in
the set's class.

Equal sets are one node. Large cells are cut into blocks that meet pairwise; in
very large ones the sets linked to the leader are settled first, and only the
others go on to meet all. Classes are connected components of the links found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.llm.graph import roots
from rasterloom.llm.hashing import signed, windows, word_hashes
from rasterloom.llm.shared import NO_ID, SPACE, order_id, release_shuffles, row_struct, written

#: Frequencies are kept for so many classes of hashes: 2 MB, whatever the corpus.
FREQ_BITS, FREQ_ROW = 18, 1024
#: A signature has as many parity bits as its set has n-grams, rounded up to a power of two, and this many at least.
LEAST_BITS = 512
#: Members of a block by signature, n-grams of a block of sets, members of a very large cell.
BLOCK_MEMBERS, BLOCK_TOKENS, HOT_MEMBERS = 256, 1 << 20, 20_000


def ngrams(text: str | None, n: int) -> np.ndarray:
    """Hashes of the distinct n-grams; a shorter text is one n-gram, a text without words none."""
    words = (text or "").encode().lower().split()
    return np.unique(windows(word_hashes(words), min(n, len(words)))) if words else np.zeros(0, np.uint64)


def _class(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - FREQ_BITS)).astype(np.int64)


def frequencies(texts: DataFrame, n: int) -> np.ndarray:
    """How often each class of n-gram hashes occurs over all documents: a table of fixed size."""
    size, rows = 1 << FREQ_BITS, (1 << FREQ_BITS) // FREQ_ROW

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, _class(ngrams(text.as_py(), n)), 1)
        parts = [zlib.compress(p.tobytes(), 1) for p in total.reshape(rows, FREQ_ROW)]
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array(parts, pa.binary())], ["k", "c"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(c), np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["k", "c"]
        )

    merged = texts.select("text").mapInArrow(count, "k int, c binary").repartition(16, "k").mapInArrow(add, "k int, c binary")
    out = np.zeros(size, np.int64)
    for row in merged.collect():  # 256 rows of 8 kB
        out[row.k * FREQ_ROW : (row.k + 1) * FREQ_ROW] += np.frombuffer(row.c, np.int64)
    return out


def rare_first(tokens: np.ndarray, often: np.ndarray) -> np.ndarray:
    return tokens[np.lexsort((tokens, often[_class(tokens)]))]


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def signature(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of n-grams in each of some classes, as bits of longs."""
    size = max(LEAST_BITS, 1 << (len(tokens) - 1).bit_length()) if len(tokens) else LEAST_BITS
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(sig: np.ndarray, words: int) -> np.ndarray:
    """The signature of the same set in fewer bits."""
    return np.bitwise_xor.reduce(sig.reshape(-1, words), axis=0)


def sketches(texts: DataFrame, n: int, percent: int, often) -> DataFrame:
    """``doc_id, d, n, k1, k2, sig, prefix`` of every row; ``d`` is its key, ``k1, k2`` name its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = often.value
        for batch in batches:
            sizes, one, two, sigs, prefixes = [], [], [], [], []
            for text in batch.column(2):
                tokens = ngrams(text.as_py(), n)
                both = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64)
                sizes.append(len(tokens))
                one.append(both[0])
                two.append(both[1])
                sigs.append(signature(tokens))
                prefixes.append(signed(rare_first(tokens, counts)[: prefix_length(len(tokens), percent) if len(tokens) else 0]))
            if sizes:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                        pa.array(sigs, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "d", "n", "k1", "k2", "sig", "prefix"],
                )

    schema = "doc_id long, d long, n long, k1 long, k2 long, sig array<long>, prefix array<long>"
    return texts.select("doc_id", "d", "text").mapInArrow(run, schema)


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one cell after another, from batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cells = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(cells[1:] != cells[:-1])[0] + 1).tolist(), len(cells)]
        for a, b in zip(cuts, cuts[1:]):
            if held and a < b and held[0].column(0)[0] != batch.column(0)[a]:
                yield pa.Table.from_batches(held)
                held = []
            if a < b:
                held.append(batch[a:b])
    if held:
        yield pa.Table.from_batches(held)


def spread(members: DataFrame, weight: str, limit: int) -> DataFrame:
    """Cut cells heavier than ``limit`` into blocks that meet pairwise, so that all their pairs still meet."""
    loads = members.groupBy("cell").agg(F.sum(weight).alias("_w"))
    heavy = written(
        loads.where(F.col("_w") > limit).select("cell", F.ceil(F.col("_w") / limit).cast("long").alias("_b")), "ngram-heavy"
    )
    if heavy.isEmpty():
        return members
    i, j, b = F.col("_i"), F.col("_j"), F.col("_b")
    cut = (
        members.join(heavy, "cell", "left")
        .withColumn("_i", F.when(b.isNotNull(), F.pmod(F.xxhash64("d", F.lit(7)), b)))
        .withColumn("_j", F.explode(F.when(b.isNotNull(), F.sequence(F.lit(0).cast("long"), b - 1)).otherwise(F.array(F.lit(0).cast("long")))))
    )
    name = F.when(b.isNotNull(), F.concat_ws("/", "cell", F.least(i, j).cast("string"), F.greatest(i, j).cast("string")))
    return cut.withColumn("cell", F.coalesce(name, F.col("cell"))).drop("_b", "_i", "_j")


def _reachable(n: np.ndarray, sigs: list[np.ndarray], probe: np.ndarray, percent: int) -> np.ndarray:
    """Members that sizes and signatures allow a link to, among pairs with a probing member."""
    alive = np.zeros(len(n), bool)
    words = np.array([len(s) for s in sigs])
    # per length, the members that have as many bits or more, folded to that length
    folds = {}
    for w in np.unique(words):
        who = np.nonzero(words >= w)[0]
        folds[w] = (who, np.stack([folded(sigs[k], w) for k in who]))
    for w, (who, sig) in folds.items():
        for k in np.nonzero(probe[who])[0]:
            me = who[k]
            # members with more bits are met here if the probing one has just these
            near = who if words[me] == w else who[words[who] == w]
            apart = np.bitwise_count((sig if words[me] == w else sig[words[who] == w]) ^ sig[k]).sum(1).astype(np.int64)
            # an element of one set only flips one bit, so the overlap is at most this
            most = np.minimum((n[near] + n[me] - apart) // 2, np.minimum(n[near], n[me]))
            ok = (100 + percent) * most >= percent * (n[near] + n[me])
            ok[near == me] = False
            if ok.any():
                alive[near[ok]] = alive[me] = True
    return alive


class Node:
    """A path without forks, with what is known of the sets below."""

    __slots__ = ("path", "children", "ends", "low", "high", "some", "uniform")

    def __init__(self, path, children, ends, low, high, some, uniform=True):
        self.path, self.children, self.ends = path, children, ends
        self.low, self.high = low, high  # sizes of the sets below
        self.some, self.uniform = some, uniform  # one set below; whether all are of its class


class Tree:
    """Prefix tree of ordered sets with joint classes."""

    def __init__(self, percent: int):
        self.percent, self.root = percent, Node([], {}, [], 0, 0, -1)
        self.parent: list[int] = []
        self.sizes: list[int] = []

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def add(self, tokens: list[int], probing: bool = True) -> list[int]:
        """Put a set into the tree; if it probes, returns sets that join it with their classes."""
        me = len(self.parent)
        self.parent.append(me)
        self.sizes.append(len(tokens))
        found = self._probe(me, tokens) if probing else []
        self._insert(me, tokens)
        return found

    def _probe(self, me: int, tokens: list[int]) -> list[int]:
        n, pc = len(tokens), self.percent
        place = {t: k for k, t in enumerate(tokens)}
        out: list[int] = []
        stack = [(self.root, 0, 0, 0)]  # node, overlap, tokens passed, own tokens that are behind
        while stack:
            node, have, passed, behind = stack.pop()
            if node.some < 0 or 100 * node.high < pc * n or pc * node.low > 100 * n:
                continue
            if node.uniform and self.find(node.some) == self.find(me):
                continue
            # tokens that the largest set below may have and this set not
            spare = (100 * node.high - pc * n) // (100 + pc)
            miss = passed - have
            for t in node.path:
                k = place.get(t)
                if k is None:
                    miss += 1
                    if miss > spare:
                        break
                else:
                    have += 1
                    behind = k + 1
            if miss > spare or (100 + pc) * (have + n - behind) < pc * (n + node.low):
                continue
            passed += len(node.path)
            for y in node.ends:
                if (100 + pc) * have >= pc * (n + self.sizes[y]):
                    a, b = self.find(me), self.find(y)
                    if a != b:
                        self.parent[max(a, b)] = min(a, b)
                        out.append(y)
            ahead = (have, passed, behind)
            stack += [(c, *ahead) for t, c in node.children.items() if t not in place]
            stack += [(c, *ahead) for t, c in node.children.items() if t in place]  # likely links first
        return out

    def _insert(self, me: int, tokens: list[int]) -> None:
        node, k, n = self.root, 0, len(tokens)
        while True:
            path, m = node.path, 0
            while m < len(path) and k + m < n and path[m] == tokens[k + m]:
                m += 1
            if m < len(path):  # fork inside the path
                rest = Node(path[m:], node.children, node.ends, node.low, node.high, node.some, node.uniform)
                node.path, node.children, node.ends = path[:m], {path[m]: rest}, []
            k += m
            if node.some < 0:
                node.low, node.high, node.some = n, n, me
            else:
                node.low, node.high = min(node.low, n), max(node.high, n)
                node.uniform = node.uniform and self.find(node.some) == self.find(me)
            if k == n:
                node.ends.append(me)
                return
            if tokens[k] not in node.children:
                node.children[tokens[k]] = Node(tokens[k:], {}, [me], n, n, me)
                return
            node = node.children[tokens[k]]


def links_in_cells(texts: DataFrame, members: DataFrame, sketch: DataFrame, n: int, percent: int, often) -> DataFrame:
    """``u, v``: links that join all similar members of each cell.

    ``members`` has ``cell string, d, probe``; pairs of which neither member probes are
    taken to be settled and are not looked at.
    """

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in by_cell(batches):
            size = cell["n"].to_numpy()
            sigs = [x.values.to_numpy().view(np.uint64) for x in cell["sig"]]
            alive = _reachable(size, sigs, cell["probe"].to_numpy(), percent)
            if alive.any():
                kept = cell.select(["cell", "d", "probe", "n"]).filter(pa.array(alive)).combine_chunks()
                yield from kept.to_batches()

    sized = members.join(sketch.select("d", "n", "sig"), "d").withColumn("one", F.lit(1))
    near = spread(sized, "one", BLOCK_MEMBERS).select("cell", "d", "probe", "n", "sig").repartition("cell").sortWithinPartitions("cell")
    near = written(near.mapInArrow(filtered, "cell string, d long, probe boolean, n long"), "ngram-near")
    cells = spread(near, "n", BLOCK_TOKENS)
    lists = cells.groupBy("d").agg(F.collect_list(F.struct("cell", "probe")).alias("cells"))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = often.value
        last = None
        for batch in batches:
            for d, text, cells in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                if last is not None and d.as_py() == last:  # equal rows follow each other
                    continue
                last = d.as_py()
                tokens = signed(rare_first(ngrams(text.as_py(), n), counts)[::-1])
                rows = len(cells)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c["cell"] for c in cells], pa.string()), pa.array([c["probe"] for c in cells], pa.bool_()),
                        pa.array([d.as_py()] * rows, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * len(tokens)), pa.array(np.tile(tokens, rows))),
                    ],
                    ["cell", "probe", "d", "tokens"],
                )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in by_cell(batches):
            tree, ids, u, v = Tree(percent), cell["d"].to_pylist(), [], []
            for k, (probing, tokens) in enumerate(zip(cell["probe"].to_pylist(), cell["tokens"])):
                for y in tree.add(tokens.values.to_numpy().tolist(), probing):
                    u.append(ids[k])
                    v.append(ids[y])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    sets = texts.select("d", "text").hint("merge").join(lists, "d").mapInArrow(ordered, "cell string, probe boolean, d long, tokens array<long>")
    # members that do not probe come first, so that those that do find them in the tree
    sets = sets.repartition("cell").sortWithinPartitions("cell", "probe", "d")
    return sets.mapInArrow(joined, "u long, v long").distinct()


def row_key() -> Column:
    """Key of a row: a hash of its id and text, so that one id with several texts has several keys."""
    return F.xxhash64(order_id(), F.coalesce("text", F.lit("")))


def _classes(docs: DataFrame, n: int, percent: int, hot_members: int = HOT_MEMBERS) -> tuple[DataFrame, DataFrame]:
    """``(rows, classes)``: ``doc_id, n, k1, k2`` per row, and ``e1, e2, first`` per set.

    ``first`` has ``id, d``: the smallest id of the set's class and the key of a row
    that has it.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("d"), "text")
    often = spark.sparkContext.broadcast(frequencies(texts, n))  # 2 MB, fixed
    sketch = written(sketches(texts, n, percent, often), "ngram-sketches")

    # equal sets are one node, named by the smallest key of their rows; ids are labels for later
    least = F.min(F.struct(order_id().alias("id"), "d")).alias("first")
    equal = sketch.where("n > 0").groupBy("k1", "k2").agg(F.min("d").alias("rep"), F.max("d").alias("hi"), least)
    equal = written(equal, "ngram-equal")
    copies = sketch.select("d", "k1", "k2").join(equal.where("rep < hi").select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), "rep"),
        (F.col("k1") == F.col("e1")) & (F.col("k2").bitwiseXOR(F.col("e2")) == 0) & (F.col("d") > F.col("rep")))
    nodes = sketch.where("n > 0").join(written(copies.select("d").distinct(), "ngram-copies"), "d", "left_anti")
    nodes = written(nodes.select("d", "n", "sig", "prefix").dropDuplicates(["d"]), "ngram-nodes")

    # every n-gram in a prefix names its leader
    prefix = nodes.select("d", F.explode("prefix").alias("t"))
    leaders = prefix.groupBy("t").agg(F.min("d").alias("leader"), F.count(F.lit(1)).alias("c")).where("c > 1")
    leaders = leaders.select(F.col("t").alias("t1"), "leader")
    follows = prefix.join(leaders, F.col("t") == F.col("t1")).select("leader", "d").distinct()
    follows = written(follows, "ngram-follows")
    release_shuffles(spark)
    stars = written(follows.groupBy("leader").agg(F.count(F.lit(1)).alias("c")), "ngram-stars")
    cell = F.col("leader").cast("string")
    few = follows.join(stars.where(F.col("c") <= hot_members), "leader", "left_semi")
    links = links_in_cells(texts, few.select(cell.alias("cell"), "d", F.lit(True).alias("probe")), nodes, n, percent, often)
    links = written(links, "ngram-links")

    hot = stars.where(F.col("c") > hot_members)
    if not hot.isEmpty():
        # first every member against its leader alone, in as many cells as it takes
        many = follows.join(hot.select("leader"), "leader", "left_semi")
        part = F.pmod(F.xxhash64("d"), F.ceil(F.col("c") / BLOCK_MEMBERS).cast("long"))
        named = F.concat_ws(":", cell, F.col("k").cast("string")).alias("cell")
        rest = many.join(hot, "leader").where("d <> leader").withColumn("k", part).select(named, "d", F.lit(False).alias("probe"))
        heads = hot.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("c") / BLOCK_MEMBERS).cast("long") - 1)))
        heads = heads.select(named, F.col("leader").alias("d"), F.lit(True).alias("probe"))
        straight = written(links_in_cells(texts, rest.unionByName(heads), nodes, n, percent, often), "ngram-straight")
        # members not linked to the leader meet all others; linked ones are of one class already
        tied = straight.select(F.least("u", "v").alias("leader"), F.greatest("u", "v").alias("d"))
        tied = tied.withColumn("tied", F.lit(True))
        loose = many.join(tied, ["leader", "d"], "left").select(cell.alias("cell"), "d", F.col("tied").isNull().alias("probe"))
        links = links.unionByName(straight).unionByName(links_in_cells(texts, loose, nodes, n, percent, often))

    found = roots(links)
    classes = equal.join(found, F.col("rep") == F.col("u"), "left").select(
        F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.coalesce("v", "rep").alias("root"), "first"
    )
    classes = written(classes, "ngram-classes")
    firsts = classes.groupBy("root").agg(F.min("first").alias("first"))
    named = written(classes.drop("first").join(firsts, "root").select("e1", "e2", "first"), "ngram-named")
    return sketch.select("doc_id", "n", "k1", "k2"), named


def similar_classes(docs: DataFrame, n: int = 4, percent: int = 85, hot_members: int = HOT_MEMBERS) -> DataFrame:
    """Classes of documents joined by links between n-gram sets.

    Words are parts between white space, A-Z lower-cased; a document's set holds its
    distinct ``n``-word shingles, or its whole sequence if it has fewer words. Two
    documents link when ``100 * intersection >= percent * union``. Returns ``doc_id,
    n_shingles, component_id`` per row, ``component_id`` being the smallest id reachable.

    Texts that are null or have no word have an empty set and are alone. A null id is
    smaller than any other and is given back as null. Rows with equal ids are compared
    each with its own text, and linked only if their texts are. An empty table gives no
    rows. Other columns are ignored.
    """
    rows, named = _classes(docs, n, percent, hot_members)
    on = (F.col("k1") == F.col("e1")) & (F.col("k2").bitwiseXOR(F.col("e2")) == 0) & (F.col("n") > 0)
    root = F.coalesce("first.id", order_id())
    return rows.join(named, on, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(root != F.lit(NO_ID), root).alias("component_id")
    )


def one_per_class(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """One row of every class, of its smallest id, with the columns of ``docs``.

    Rows go only if another one stands for their class, whatever their ids; rows
    without a word are alone and stay.
    """
    _, named = _classes(docs, n, percent)
    kept = named.select(F.col("first.d").alias("k")).distinct()
    word = F.coalesce("text", F.lit("")).rlike(f"[^{SPACE}]")
    others = [f"`{c}`" for c, t in docs.dtypes if "map<" not in t]
    rows = docs.where(word).select(row_key().alias("d"), F.xxhash64(*others).alias("h"), row_struct(docs))
    # merged, not broadcast: the list grows with the corpus
    stay = rows.hint("merge").join(kept, F.col("d") == F.col("k"), "left_semi")
    # rows of one id and text, alike but for other columns
    first = stay.groupBy("d").agg(F.min_by("row", "h").alias("row")).select("row.*")
    return first.unionByName(docs.where(~word))
