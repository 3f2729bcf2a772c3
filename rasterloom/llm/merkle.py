"""Merkle manifest of a dataset: 16-ary trees per source below a tree of the sources.

Leaves are numbered by running sums over range-partitioned rows, so no task holds a
source. Each level is one grouped aggregate over runs of 16 nodes, and the built levels
are stored as node rows that name their parent. A recursive query then climbs from the leaves:
the leaves of a run have the same ancestors, so they climb in one row that holds a hash per
leaf; every step joins the parent, appends its siblings and folds each hash with them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from rasterloom.llm.shared import written

FAN = 16
#: Bytes of a digest, and the tree number of the tree over all sources.
SIZE, TOP = 32, -1


def field(value: Column) -> Column:
    """A value as the leaf hash reads it: byte count, colon, value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def hash_of(digests: Column) -> Column:
    """Hash of digests that stand one after another, read as lower-case hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def without(run: Column, pos: Column) -> Column:
    """The digests of a run but the one at ``pos``."""
    at = (pos * SIZE).cast("int")
    return F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + SIZE + 1, F.lit(FAN * SIZE)))


def folded(run: Column, pos: Column, digest: Column) -> Column:
    """Hash of a run in which ``digest`` stands at ``pos``."""
    at = (pos * SIZE).cast("int")
    return hash_of(F.concat(F.substring(run, F.lit(1), at), digest, F.substring(run, at + SIZE + 1, F.lit(FAN * SIZE))))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``idx`` (from 0 within ``group``) and ``n`` (rows of the group), in the given order.

    Rows go to ranges; a window holds the rows of one range, or one count per range and group.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, group, *order).withColumn("part", F.spark_partition_id()), "ranged")
    ahead = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(group, "part").agg(F.count(F.lit(1)).alias("c"))
    starts = counts.select(
        F.col(group).alias("g"),
        F.col("part").alias("p"),
        F.coalesce(F.sum("c").over(ahead), F.lit(0)).alias("start"),
        F.sum("c").over(Window.partitionBy(group)).alias("n"),
    )
    here = Window.partitionBy("part", group).orderBy(*order)
    ranked = ranged.withColumn("rank", F.row_number().over(here))
    return ranked.join(starts, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g"))).select(
        *rows.columns, (F.col("start") + F.col("rank") - 1).cast("long").alias("idx"), "n"
    )


def levels(leaves: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """Roots ``tree, root`` of the trees over ``tree, idx, n, digest``, and the node rows of each level.

    A node row has ``tree, level, idx, run`` (its children's digests), ``digest`` and ``n``, the nodes of its level.
    """
    now, tops, built = leaves.select("tree", "idx", "n", "digest"), [], []
    most = leaves.agg(F.max("n")).first()[0] or 0
    level = 0
    while most > 1:
        level += 1
        tops.append(now.where("n = 1").select("tree", "digest"))
        runs = (
            now.where("n > 1")
            .groupBy("tree", F.expr(f"idx div {FAN}").alias("idx"))
            .agg(
                F.array_sort(F.collect_list(F.struct((F.col("idx") % FAN).cast("int").alias("pos"), "digest"))).alias("kids"),
                F.first("n").alias("n"),
            )
            .select(
                "tree", F.lit(level).alias("level"), "idx", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"),
                F.aggregate("kids", F.lit(b""), lambda run, kid: F.concat(run, kid["digest"])).alias("run"),
            )
        )
        now = written(runs.withColumn("digest", hash_of(F.col("run"))), f"{name}-level")
        built.append(now)
        most = math.ceil(most / FAN)
    tops.append(now.where("n = 1").select("tree", "digest"))
    roots = tops[0]
    for top in tops[1:]:
        roots = roots.unionByName(top)
    return roots, built


CLIMB = """
WITH RECURSIVE climb(tree, run, up_tree, up_level, up_idx, up_pos, siblings, hashes) AS (
  SELECT tree, run, up_tree, up_level, up_idx, up_pos, CAST('' AS BINARY), hashes FROM {start}
  UNION ALL
  SELECT c.tree, c.run, n.up_tree, n.up_level, n.up_idx, n.up_pos,
         concat(c.siblings, substr(n.run, 1, c.up_pos * {size}), substr(n.run, c.up_pos * {size} + {size} + 1)),
         transform(c.hashes, h -> unhex(sha2(lower(hex(concat(
           substr(n.run, 1, c.up_pos * {size}), h, substr(n.run, c.up_pos * {size} + {size} + 1)))), 256)))
  FROM climb c JOIN {nodes} n ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_idx = n.idx)
SELECT tree, run, siblings, hashes FROM climb WHERE up_tree IS NULL"""


def verify(docs: DataFrame, tampered: Column, text: Column, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """Build the manifest of ``docs`` and prove every row against it.

    ``fields`` are hashed in their order, the first is the id, and ``source`` and ``text`` are among
    them. Where ``tampered`` holds, the proof starts from the row with ``text`` in
    place of its text. Returns ``doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified``. Null values hash as a dash, so null and empty texts
    differ; null sources are one source, the first; null ids come first in their source and ``tampered`` decides
    on them. Rows that share an id are ordered by their leaf; equal rows are leaves of their own, and
    lie in one range. A source with one row has that leaf as subroot, and a
    table with one source its subroot as root. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    plain = [F.col(f"`{c}`") for c in fields]
    other = [F.when(tampered, text).otherwise(c) if name == "text" else c for name, c in zip(fields, plain)]
    rows = docs.select(
        plain[0].cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        leaf_hash(*plain).alias("leaf"), F.when(tampered, leaf_hash(*other)).alias("changed"),
    )
    leaves = numbered(rows, "source", ["doc_id", "leaf"])
    leaves = written(leaves, "leaves")

    # sources are numbered in their order; a lone one has no tree above it
    sources = leaves.groupBy("source").agg(F.count(F.lit(1)).alias("rows")).withColumn("every", F.lit(TOP).cast("long"))
    sources = written(numbered(sources, "every", ["source"]).select(F.col("source").alias("s"), F.col("idx").alias("tree"), F.col("n").alias("trees")), "sources")
    leaves = leaves.join(sources, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "leaf", "changed", "idx", "n", "tree", "trees")
    leaves = written(leaves.withColumn("digest", F.col("leaf")), "leaves")

    subroots, low = levels(leaves, "source")
    subroots = written(subroots, "subroots")
    tops = subroots.join(sources, "tree").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("n"), "digest")
    root, high = levels(tops, "top")
    # a single digest, or nothing of an empty table
    root = root.first()
    root = F.lit(bytes(root.digest) if root else None).cast("binary")

    # node rows with their parents: inside a tree by position, from a subroot to the tree of the sources
    def parent_linked(node: DataFrame, top: bool) -> DataFrame:
        inner = F.col("n") > 1
        joined = node if top else node.join(sources.select("tree", "trees"), "tree")
        upper = F.lit(False) if top else ~inner & (F.col("trees") > 1)

        def up(inside: Column, above: Column) -> Column:
            return F.when(inner, inside).when(upper, above)

        return joined.select(
            "tree", "level", "idx", "run",
            up(F.col("tree"), F.lit(TOP).cast("long")).alias("up_tree"),
            up(F.col("level") + 1, F.lit(1)).alias("up_level"),
            up(F.expr(f"idx div {FAN}"), F.expr(f"tree div {FAN}")).alias("up_idx"),
            up(F.col("idx") % FAN, F.col("tree") % FAN).cast("int").alias("up_pos"),
        )

    nodes = None
    for node, top in [(x, False) for x in low] + [(x, True) for x in high]:
        linked = parent_linked(node, top)
        nodes = linked if nodes is None else nodes.unionByName(linked)

    # where the climb starts: runs of leaves whose first fold is done, and lone leaves
    held = leaves.select(
        "tree", F.expr(f"idx div {FAN}").alias("run"), (F.col("idx") % FAN).cast("int").alias("pos"), "doc_id", "leaf",
        F.coalesce("changed", "leaf").alias("proved"), "n", "trees",
    )
    members = held.groupBy("tree", "run").agg(
        F.array_sort(F.collect_list(F.struct("pos", "doc_id", "leaf", "proved"))).alias("members"), F.first("n").alias("n"), F.first("trees").alias("trees")
    )
    members = members.withColumn("bytes", F.aggregate("members", F.lit(b""), lambda run, m: F.concat(run, m["leaf"])))
    members = written(
        members.withColumn(
            "hashes",
            F.when(F.col("n") == 1, F.transform("members", lambda m: m["proved"])).otherwise(
                F.transform("members", lambda m: folded(F.col("bytes"), m["pos"], m["proved"]))
            ),
        ),
        "runs",
    )
    one, only = F.col("n") == 1, F.col("n") <= FAN

    def start(alone: Column, above: Column) -> Column:
        """Of a run that is not the whole source, and of one that is."""
        return F.when(~one & ~only, alone).when(F.col("trees") > 1, above)

    begin = members.select(
        "tree", "run", "hashes",
        start(F.col("tree"), F.lit(TOP).cast("long")).alias("up_tree"),
        start(F.lit(2), F.lit(1)).alias("up_level"),
        start(F.expr(f"run div {FAN}"), F.expr(f"tree div {FAN}")).alias("up_idx"),
        start(F.col("run") % FAN, F.col("tree") % FAN).cast("int").alias("up_pos"),
    )
    if nodes is None:
        climbed = begin.select("tree", "run", F.lit(b"").alias("siblings"), "hashes")
    else:
        nodes = written(nodes, "nodes")
        climbed = climb(begin, nodes)
    proofs = (
        members.select("tree", "run", "members", "bytes", "n")
        .join(climbed, ["tree", "run"])
        .join(subroots.withColumnRenamed("digest", "subroot"), "tree")
        .select("bytes", "n", "siblings", "subroot", root.alias("root"), F.explode(F.arrays_zip("members", "hashes")).alias("m"))
    )
    own = F.when(F.col("n") == 1, F.lit(b"")).otherwise(without(F.col("bytes"), F.col("m.members.pos")))
    text_of = lambda c: F.lower(F.hex(c))
    return proofs.select(
        F.col("m.members.doc_id").alias("doc_id"),
        text_of(F.col("m.members.leaf")).alias("leaf"),
        text_of(F.col("subroot")).alias("subroot"),
        text_of(F.col("root")).alias("root"),
        F.sha2(text_of(F.concat(own, F.col("siblings"))), 256).alias("proof_sha256"),
        text_of(F.col("m.hashes")).alias("folded_root"),
        (F.col("m.hashes") == F.col("root")).alias("verified"),
    )


def climb(begin: DataFrame, nodes: DataFrame) -> DataFrame:
    """Siblings and folded hashes at the root, for every run of leaves."""
    spark = begin.sparkSession
    begin.createOrReplaceTempView("merkle_start")
    nodes.createOrReplaceTempView("merkle_nodes")
    # the depth is the logarithm of the rows; the number of rows that climb is that of the table
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(CLIMB.format(start="merkle_start", nodes="merkle_nodes", size=SIZE))
