"""Ordered rules that turn measurements into verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Acquisition limits used by the silence diagnosis.
CLIFF_UM, OPT_PROP, OPT_KEV, COVERAGE_OK, SILENT_P99 = 3.4, 0.22, 78, 70.0, 200


def silence_reason(um: Column, prop: Column, kev: Column, cov: Column, p99: Column) -> tuple[Column, Column]:
    """First gate a silent map fails at, and the off-recipe note."""
    off = F.concat_ws(
        "; ",
        F.when(F.abs(prop - OPT_PROP) > 0.03, F.concat(prop.cast("string"), F.lit(" m propagation"))),
        F.when(F.abs(kev - OPT_KEV) > 6, F.concat(kev.cast("string"), F.lit(" keV"))),
    )
    verdict = (
        F.when(um >= CLIFF_UM, "PHYSICS")
        .when(cov < COVERAGE_OK, "DATA")
        .when(p99 >= SILENT_P99, "INK FOUND")
        .when(off != "", "PROTOCOL")
        .otherwise("UNRECOVERED")
    )
    return verdict, off


def pair_failures(rules: dict[str, Column]) -> Column:
    """Every failed rule's reason, in rule order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def certificate(kind, n, home, other, quiet, both) -> Column:
    """Verdict of a second source on a labelled crop."""
    ink = (
        F.when(n == 0, "no ink footprint in this crop")
        .when(home < 0.2, "not called by its own source")
        .when(other >= 0.5, "corroborated")
        .when(other >= 0.2, "mixed")
        .otherwise("not corroborated")
    )
    blank = (
        F.when(n == 0, "no shared sheet in this crop")
        .when(quiet >= 0.9, "both agree blank")
        .when(both >= 0.5, "both call ink")
        .otherwise("partially disputed")
    )
    return F.when(kind == "ink", ink).otherwise(blank)


def span_verdict(span: Column) -> Column:
    return F.when(span >= 8, "SHEET").when(span >= 3, "marginal").otherwise("compressed / no sheet")


def survives(p: Column, passed: Column, draws: Column) -> Column:
    """A count survives its null when rarely matched and the gate rarely passes by chance."""
    return (p < 0.05) & (passed < draws * 0.5)


def fit_budget(levels: DataFrame, cost, budget: int, steps: int = 12) -> DataFrame:
    """First of up to ``steps`` halvings about the centre whose cost fits.

    Halving has a closed form per step (never below one chunk), so the loop is
    an exploded step number and a minimum.
    """
    f = F.col("factor")
    size = lambda full, chunk, i: F.greatest(chunk * f * 1.0, full * f / F.pow(F.lit(2.0), i))
    tried = levels.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    tried = tried.withColumns(
        {"bw": F.least(size(F.col("w"), F.col("cw"), F.col("i")), F.when(F.col("i") == 0, F.col("w") * f * 1.0).otherwise(1e18)),
         "bh": F.least(size(F.col("h"), F.col("ch"), F.col("i")), F.when(F.col("i") == 0, F.col("h") * f * 1.0).otherwise(1e18))}
    )
    tried = tried.withColumns(
        {"bx": F.col("w") * f / 2.0 - F.col("bw") / 2.0, "by": F.col("h") * f / 2.0 - F.col("bh") / 2.0}
    )
    tried = tried.withColumn("cost", cost(tried))
    fits = (F.col("cost") <= budget) | (F.col("i") == steps)
    return tried.where(fits).groupBy("id").agg(
        F.min_by(F.struct("i", "bx", "by", "bw", "bh", "cost"), "i").alias("b")
    ).select("id", "b.*")
