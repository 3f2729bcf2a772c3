"""Experiments on linear scores, answered from one set of per-tile moments.

A tile keeps the sums and products of its features, covariates and targets. The
correlation of any weighted sum of features with any target, and what is left of it once
covariates are taken out, follow from those few numbers, so variants, ablations,
jittered weights and null targets are rows of a small table joined with tiles; no raster is read again or copied
per experiment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.operators import quantiles
from rasterloom.session import checkpoint

#: Bits of a mask that mark shifted targets.
MOST_SHIFTS = 62


def shifted_marks(cells: DataFrame, target: str, shifts: list[tuple[int, int]], out: str = "marks") -> DataFrame:
    """Add a bit mask: bit k is set where ``target`` lands when the segment is rolled by ``shifts[k]``.

    Only cells with the target are multiplied.
    """
    if len(shifts) > MOST_SHIFTS:
        raise ValueError(f"{len(shifts)} shifts, {MOST_SHIFTS} at most")
    table = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(1 << k).cast("long").alias("bit")) for k, (dy, dx) in enumerate(shifts)])
    moved = cells.where(target).select("seg", "h", "w", "y", "x", F.explode(table).alias("s"))
    moved = moved.groupBy("seg", F.pmod(F.col("y") + F.col("s.dy"), "h").alias("y"), F.pmod(F.col("x") + F.col("s.dx"), "w").alias("x")).agg(
        F.bit_or("s.bit").alias(out)
    )
    return cells.join(moved, ["seg", "y", "x"], "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


class Moments:
    """Names of a tile's sums: ``n``, ``s_u`` and ``p_u_v`` of the given columns."""

    def __init__(self, features: list[str], covariates: list[str], targets: list[str]):
        self.features, self.covariates, self.targets = features, covariates, targets

    def pairs(self) -> list[tuple[str, str]]:
        own = [*self.features, *self.covariates]
        inner = [(u, v) for i, u in enumerate(own) for v in own[i:]]
        return inner + [(u, t) for t in self.targets for u in [*own, t]]

    def collect(self, cells: DataFrame, tile: list) -> DataFrame:
        """One row per tile; sums are combined in every task first."""
        every = [*self.features, *self.covariates, *self.targets]
        return cells.groupBy(*tile).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(u).alias(f"s_{u}") for u in every],
            *[F.sum(F.col(u).cast("long") * F.col(v)).alias(f"p_{u}_{v}") for u, v in self.pairs()],
        )

    def cov(self, u: str, v: str) -> Column:
        """n squared times the covariance of two columns."""
        u, v = (u, v) if (u, v) in set(self.pairs()) else (v, u)
        return F.col("n").cast("double") * F.col(f"p_{u}_{v}") - F.col(f"s_{u}").cast("double") * F.col(f"s_{v}")

    def prepare(self, df: DataFrame) -> DataFrame:
        """Add what ``r`` and ``partial_r`` read: the variance of the weighted sum of features (weights ``w_…``), and its covariance with each column.

        As columns of their own they are worked out once, however many correlations are asked for.
        """
        weighted = lambda v: sum((F.col(f"w_{f}") * self.cov(f, v) for f in self.features[1:]), F.col(f"w_{self.features[0]}") * self.cov(self.features[0], v))
        df = df.withColumns({f"_c_{v}": weighted(v) for v in (*self.features, *self.covariates, *self.targets)})
        terms = [F.col(f"w_{f}") * F.col(f"_c_{f}") for f in self.features]
        own = {f"_v_{v}": self.cov(v, v) for v in (*self.covariates, *self.targets)}
        return df.withColumns({"_v_score": sum(terms[1:], terms[0]), **own})

    def r(self, target: str) -> Column:
        """Correlation of the score with a target; null where either is constant."""
        a, b = F.col("_v_score"), F.col(f"_v_{target}")
        return F.when((a > 1e-9) & (b > 1e-9), F.col(f"_c_{target}") / F.sqrt(a) / F.sqrt(b))

    def partial_r(self, target: str) -> Column:
        """Correlation once the covariates are regressed out of both sides, one after another."""
        names = ["score", target, *self.covariates]

        def plain(u: str, v: str) -> Column:
            if u == v:
                return F.col(f"_v_{u}")
            return F.col(f"_c_{v if u == 'score' else u}") if "score" in (u, v) else self.cov(u, v)

        m = {(u, v): plain(u, v) for i, u in enumerate(names) for v in names[i:]}
        for k, pivot in enumerate(self.covariates):
            left = ["score", target, *self.covariates[k + 1 :]]
            at = lambda u, v: m.get((u, v), m.get((v, u)))
            p = at(pivot, pivot)
            m = {
                (u, v): at(u, v) - F.when(p > 1e-9, at(u, pivot) * at(v, pivot) / p).otherwise(0.0)
                for i, u in enumerate(left) for v in left[i:]
            }
        a, b = m["score", "score"], m[target, target]
        return F.when((a > 1e-6) & (b > 1e-6), m["score", target] / F.sqrt(a) / F.sqrt(b))


def expand(tiles: DataFrame, rows: list[tuple], names: list[str], moments: Moments) -> DataFrame:
    """Every tile once for each experiment: its ``names`` (text) and a weight ``w_…`` per feature, in the order of the row, ready for ``r``.

    Experiments are parameters: a list written into the plan, not data.
    """
    k = len(names)
    table = F.array(*[
        F.struct(*[F.lit(str(v)).alias(n) for n, v in zip(names, r)], *[F.lit(float(w)).alias(f"w_{f}") for f, w in zip(moments.features, r[k:])]) for r in rows
    ])
    return moments.prepare(tiles.withColumn("_e", F.explode(table)).select(*tiles.columns, "_e.*"))


def draw(number: Column, seed: int) -> Column:
    """A number in [0, 1) per tile: the same for a seed in every run."""
    x, k = (number * 7919 + F.lit(seed)) % F.lit(1 << 32), F.lit(2654435769)
    # in halves of 16 bits: the whole product leaves 64 bits from block 105 on
    low, high = x % F.lit(1 << 16), F.floor(F.abs(x) / float(1 << 16)) * F.signum(x).cast("long")
    return (low * k + high * k % F.lit(1 << 16) * F.lit(1 << 16)) % F.lit(1 << 32) / float(1 << 32)


def medians_of(scored: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    return quantiles.medians(scored.where(F.col(value).isNotNull()), by, {out: value})


class Funnel:
    """Stages that only the survivors of the one before reach.

    ``variants`` are rows ``(name, weights…)``. ``run`` multiplies a stage's tiles by the variants
    that are still in, so its work is survivors times tiles; the survivors are then read off
    the stage's medians, one per variant.
    """

    def __init__(self, moments: Moments, variants: list[tuple]):
        self.moments, self.alive, self.reports = moments, list(variants), []

    def run(self, name: str, tiles: DataFrame, value: Column, keeps: Column) -> None:
        """Median of ``value`` per variant over the stage's tiles; ``keeps``, of the medians so far, decides who goes on."""
        if not self.alive:
            return
        # kept as plain numbers: what follows would work the expressions out again
        scored = checkpoint(expand(tiles, self.alive, ["variant"], self.moments).select("variant", value.alias("_v")))
        count = scored.groupBy("variant").agg(F.count("_v").alias(f"{name}_tiles"))
        now = count.join(medians_of(scored, ["variant"], "_v", name), "variant", "left")
        if self.reports:
            now = self.reports[-1][1].join(now, "variant")
        now = checkpoint(now)
        self.reports.append((name, now))
        kept = {r.variant for r in now.where(F.coalesce(keeps, F.lit(False))).select("variant").collect()}
        self.alive = [v for v in self.alive if v[0] in kept]

    def report(self) -> DataFrame:
        """One row per variant that had a tile: figures of every stage it reached, and the stage that it failed or ``gated``."""
        whole = self.reports[0][1]
        for name, now in self.reports[1:]:
            whole = whole.join(now.select("variant", name, f"{name}_tiles"), "variant", "left")
        stage = F.coalesce(*[F.when(F.col(f"{n}_tiles").isNotNull(), n) for n, _ in reversed(self.reports)])
        return whole.withColumn("stage", F.when(F.col("variant").isin([v[0] for v in self.alive]), "gated").otherwise(stage))


def falsify(tiles: DataFrame, moments: Moments, trials: list[tuple], sets: dict[str, str], target: str, control: str, bars: dict[str, float], scroll: str = "scroll"):
    """Ablations and verdicts of candidates: two relations.

    ``trials`` are rows ``(candidate, experiment, weights…)`` with the experiments ``whole``, ``drop …``, ``alone …``
    and ``jitter …``. ``sets`` say which tiles are a ``fresh`` draw, which of them the ``jitter`` trials use, which are ``blank``
    and which are ``blind`` (``control`` is their target). The ablations have the median correlation of every experiment. A verdict
    needs all five legs: the fresh median holds; the worst scroll holds, on two scrolls or more; half of the jittered
    neighbours hold; blank and blind tiles stay quiet. ``killed_by`` names the first that fails; an unmeasured control
    fails too. Signs are those of the fresh median.
    """
    every = expand(tiles, trials, ["candidate", "experiment"], moments)
    jitter = F.col("experiment").startswith("jitter")
    whole = F.col("experiment") == "whole"
    of = {k: F.expr(condition) for k, condition in sets.items()}
    kind = F.when(of["fresh"] & (~jitter | of["jitter"]), "fresh").when(of["blank"] & whole, "blank").when(of["blind"] & whole, "blind")
    value = F.when(F.col("kind") == "fresh", moments.r(target)).otherwise(F.abs(moments.r(control)))
    scored = every.withColumn("kind", kind).where("kind IS NOT NULL").select("candidate", "experiment", "kind", scroll, value.alias("r"))
    scored = checkpoint(scored).where("r IS NOT NULL")
    by = ["candidate", "experiment", "kind"]
    med = medians_of(scored, by, "r", "m").join(scored.groupBy(*by).agg(F.count(F.lit(1)).alias("tiles")), by)
    med = checkpoint(med)
    ablation = med.where("kind = 'fresh'").select("candidate", "experiment", F.col("m").alias("r"), "tiles")
    main = med.where(whole).groupBy("candidate").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("m"))).alias(k) for k in ("fresh", "blank", "blind")],
        F.max(F.when(F.col("kind") == "fresh", F.col("tiles"))).alias("fresh_tiles"),
    )
    main = main.withColumn("sign", F.when(F.col("fresh") < 0, -1.0).otherwise(1.0))
    per = medians_of(scored.where(whole & (F.col("kind") == "fresh")), ["candidate", scroll], "r", "m").join(main.select("candidate", "sign"), "candidate")
    per = per.groupBy("candidate").agg(F.min(F.col("m") * F.col("sign")).alias("worst"), F.count(F.lit(1)).alias("scrolls"))
    near = med.where(jitter & (F.col("kind") == "fresh")).join(main.select("candidate", "sign"), "candidate")
    near = near.groupBy("candidate").agg(F.avg((F.col("m") * F.col("sign") >= bars["fresh"]).cast("double")).alias("jitter"))
    out = main.join(per, "candidate", "left").join(near, "candidate", "left")
    legs = {
        "fresh": F.abs("fresh") >= bars["fresh"],
        "scroll": (F.col("worst") >= bars["worst"]) & (F.col("scrolls") >= 2),
        "jitter": F.col("jitter") >= bars["jitter"],
        "blank": F.col("blank") <= bars["blank"],
        "blind": F.col("blind") <= bars["blind"],
    }
    killed = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in legs.items()])
    out = out.withColumn("killed_by", killed).withColumn("survived", killed.isNull())
    return ablation, out.select("candidate", "fresh", "fresh_tiles", "worst", "scrolls", "jitter", "blank", "blind", "killed_by", "survived")
