"""Variant search with controls in the objective, and falsification of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.operators import quantiles


def variants_long(df: DataFrame, variants: list[tuple[int, dict[str, float]]], maps: list[str], keep: list[str]) -> DataFrame:
    """One row per cell and variant with the variant's weighted score."""
    table = F.array(
        *[
            F.struct(F.lit(i).alias("variant"), *[F.lit(float(w.get(m, 0.0))).alias(f"w_{m}") for m in maps])
            for i, w in variants
        ]
    )
    v = df.select(*keep, *maps, F.explode(table).alias("p"))
    score = F.lit(0.0)
    for m in maps:
        score = score + F.col(m) * F.col(f"p.w_{m}")
    return v.select(*keep, F.col("p.variant").alias("variant"), score.alias("score"))


def separation(long: DataFrame, keys: list[str], target: Column) -> DataFrame:
    """Standardised score difference between target and rest, per variant and tile."""
    on, off = F.when(target, F.col("score")), F.when(~target, F.col("score"))
    return long.groupBy("variant", *keys).agg(
        ((F.avg(on) - F.avg(off)) / F.nullif(F.stddev_pop("score"), F.lit(0.0))).alias("d"),
        F.count(on).alias("n_on"),
    )


def funnel(tune: DataFrame, held: DataFrame, blank: DataFrame, bars: dict[str, float]) -> DataFrame:
    """Median per stage, penalised by the controls, with the stage each variant reached."""
    med = lambda df, name: quantiles.medians(df, ["variant"], {name: "d"})
    m = med(tune, "tune").join(med(held, "held"), "variant", "left").join(med(blank, "blank"), "variant", "left")
    final = F.col("held") - 0.5 * F.greatest(F.lit(0.0), F.abs("blank") - bars["blank"])
    stage = (
        F.when(F.col("tune") < bars["tune"], "rejected").when(F.col("held") < bars["held"], "screened")
        .when(final >= bars["final"], "gated").otherwise("tested")
    )
    return m.withColumns({"penalised": final, "stage": stage})


def partial_signs(long: DataFrame, keys: list[str]) -> DataFrame:
    """Worst scroll of a variant: it must hold on every scroll, not on one."""
    return quantiles.medians(long, ["variant", *keys], {"m": "d"}).groupBy("variant").agg(
        F.min("m").alias("worst"), F.count(F.lit(1)).alias("scrolls")
    )


def auc_per_tile(long: DataFrame, keys: list[str], target: str) -> DataFrame:
    return quantiles.auc(long, ["variant", *keys], "score", F.col(target), least=50)
