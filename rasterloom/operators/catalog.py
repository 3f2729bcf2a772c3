"""Catalog building: name matching, de-duplication, upserts, id rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterloom.operators import quantiles
from rasterloom.session import checkpoint


def last_wins(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row per key, the one written last; aggregated map-side."""
    picked = F.max_by(F.struct(*values), order).alias("_v")
    return df.groupBy(*keys).agg(picked).select(*keys, "_v.*")


def longest_stem(files: DataFrame, stems: DataFrame, keys: list[str], base: str, stem: str) -> DataFrame:
    """Each file with the longest stem of its own group contained in its name.

    A stem is anchored by its first letters, as many as the largest power of two it holds; so a short
    stem shortens no other's anchor. A name is expanded to its parts of the lengths
    that its group's stems call for, at most one row per place and length, and meets the stems
    whose anchor it holds, which are then looked for in it. A group with most of the files
    and stems spreads over its anchors. Empty stems are found nowhere.
    """
    size = F.pow(F.lit(2), F.floor(F.log2(F.length(stem)))).cast("int")
    stems = stems.select(*keys, stem).distinct().where(F.length(stem) > 0)
    stems = stems.withColumn("_long", size).withColumn("_at", F.substring(F.col(stem), F.lit(1), F.col("_long")))
    # a handful of lengths per group
    lengths = stems.groupBy(*keys).agg(F.array_sort(F.collect_set("_long")).alias("_lengths"))

    def parts(long):
        places = F.sequence(F.lit(1), F.greatest(F.length(base) - long + 1, F.lit(1)))
        return F.array_distinct(F.transform(places, lambda i: F.substring(F.col(base), i, long)))

    named = files.join(lengths, keys).withColumn("_at", F.explode(F.array_distinct(F.flatten(F.transform("_lengths", parts)))))
    hit = named.join(stems.drop("_long"), [*keys, "_at"]).where(F.contains(base, stem))
    best = F.max_by(stem, F.struct(F.length(stem), F.col(stem)))
    return hit.groupBy(*files.columns).agg(best.alias(stem))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Merge by key: new values replace old ones, nothing else is dropped."""
    tagged = old.select(*keys, *values, F.lit(0).alias("_gen")).unionByName(
        new.select(*keys, *values, F.lit(1).alias("_gen"))
    )
    return last_wins(tagged, keys, "_gen", values)


def append_new(held: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    return held.unionByName(extra.join(held.select(key), key, "left_anti").select(held.columns))


def assert_unique(df: DataFrame, key: str) -> DataFrame:
    """Fail the job when ``key`` repeats; otherwise pass every row through."""
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    checked = dup.withColumn(
        "_ok", F.assert_true(F.col("_n") == 1, F.concat(F.lit("duplicate id "), F.col(key).cast("string")))
    ).where(F.col("_ok").isNull())
    return df.join(checked.select(key), key)


def seam_classes(nn: DataFrame, body: DataFrame, keys, normal: dict[str, float], least: int) -> DataFrame:
    """Split nearest-neighbour offsets into along-normal and in-plane parts per pair."""
    perp = F.lit(0.0)
    for c, w in normal.items():
        perp = perp + (F.col(f"r_{c}") - F.col(c)) * w
    parts = nn.select(
        *keys, F.abs(perp).alias("perp"), F.sqrt(F.greatest(F.col("d2") - perp * perp, F.lit(0.0))).alias("inplane")
    )
    edge = F.col("inplane") > F.col("perp")
    # neighbours are looked for once: of their offsets the counts are written, those above are only counted
    parts = parts.select(*keys, *[F.when(edge, F.col(c)).alias(c) for c in ("perp", "inplane")])
    parts = checkpoint(parts.groupBy(*parts.columns).agg(F.count(F.lit(1)).alias("n")))
    edge, n = F.col("perp").isNotNull(), F.col("n")
    each = parts.where(edge).withColumn("_", F.explode(F.array_repeat(F.lit(1), n.cast("int"))))
    mid = quantiles.medians(each, keys, {"perp": "perp", "inplane": "inplane"})
    g = parts.groupBy(*keys).agg(F.sum(n).alias("near"), F.coalesce(F.sum(F.when(edge, n)), F.lit(0)).alias("seam"))
    g = g.where(F.col("seam") >= least).join(body, keys).join(mid, keys)
    kind = F.when(F.col("near") / F.col("body") > 0.5, "duplicate").otherwise("seam")
    return g.select(
        *keys, "near", "seam", F.round(F.col("seam") / F.col("near"), 3).alias("edge_on"), "perp", "inplane", kind.alias("kind")
    )


def nested_maps(rows: DataFrame, keys: list[str], model: str, url: str) -> DataFrame:
    """One entry per volume carrying its maps sorted by model."""
    maps = F.array_sort(F.collect_list(F.struct(F.col(model).alias("model"), F.col(url).alias("url"))))
    return rows.groupBy(*keys).agg(maps.alias("maps"))


def round_robin(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """Take rows turn by turn across groups, best first, until ``n`` are taken.

    Only the best ``n`` of a group can ever be reached, so the global ordering
    sees at most ``n`` rows per group.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", group).limit(n)
