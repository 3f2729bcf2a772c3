"""Aggregates over masked cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.session import checkpoint


def n_where(c: Column) -> Column:
    return F.count_if(c)


def jaccard(a: Column, b: Column, empty: float | None = None) -> Column:
    """Intersection over union of two call flags; ``empty`` when nothing is called."""
    both, either = F.count_if(a & b), F.count_if(a | b)
    value = both / F.nullif(either, F.lit(0))
    return value if empty is None else F.coalesce(value, F.lit(empty))


def share(c: Column) -> Column:
    return F.count_if(c) / F.count(F.lit(1))


def cohens_d(v: Column, in_a: Column) -> Column:
    a, b = F.when(in_a, v), F.when(~in_a, v)
    pooled = F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2.0)
    return F.when(pooled > 1e-9, (F.avg(a) - F.avg(b)) / pooled)


def guarded_sd(sd: Column, floor: float = 1e-9) -> Column:
    return F.when(sd > floor, sd).otherwise(1.0)


def beside(df: DataFrame, small: DataFrame, keys: list[str], limit: int = 10_000) -> DataFrame:
    """Join figures per group to the rows: made first, counted, broadcast if they are few."""
    small = checkpoint(small)
    return df.join(F.broadcast(small) if small.count() <= limit else small, keys)


def zscore(df: DataFrame, keys: list[str], cols: dict[str, str], where: Column | None = None):
    """Population z-scores against the whole group or against ``where`` only.

    Moments are aggregated map-side and joined back, because a window over the
    whole segment would gather it in one task.
    """
    pick = (lambda c: F.when(where, F.col(c))) if where is not None else F.col
    aggs = []
    for c in sorted(set(cols.values())):
        aggs += [F.avg(pick(c)).alias(f"_mu_{c}"), F.stddev_pop(pick(c)).alias(f"_sd_{c}")]
    moments = df.groupBy(*keys).agg(*aggs)
    joined = df.join(moments, keys)
    return joined.withColumns(
        {o: (F.col(c) - F.col(f"_mu_{c}")) / guarded_sd(F.col(f"_sd_{c}")) for o, c in cols.items()}
    ).drop(*[f"_{s}_{c}" for c in set(cols.values()) for s in ("mu", "sd")])


def enrichment(obs: Column, null_mean: Column, digits: int = 2) -> Column:
    """Observed over null, undefined where the null is numerically nothing."""
    return F.when(null_mean > 1e-6, F.round(obs / null_mean, digits))


def normal_equations(df: DataFrame, keys: list[str], xs: list[str], ys: list[str]) -> DataFrame:
    """All second moments of ``[1, xs, ys]`` per group in one aggregation."""
    names = ["_one", *xs, *ys]
    aggs = []
    for i, a in enumerate(names):
        for b in names[i:]:
            left = F.lit(1.0) if a == "_one" else F.col(a).cast("double")
            right = F.lit(1.0) if b == "_one" else F.col(b).cast("double")
            aggs.append(F.sum(left * right).alias(f"m_{a}_{b}"))
    return df.groupBy(*keys).agg(*aggs)


def partial_corr(df: DataFrame, keys: list[str], x: str, y: str, covs: list[str]) -> DataFrame:
    """Correlation of ``x`` and ``y`` after least squares on ``covs`` and 1.

    The cross-moment matrix is aggregated by Spark; each group then needs one
    solve of a (covariates + 1) system, done on a few numbers per group.
    """
    names = ["_one", *covs, x, y]
    moments = normal_equations(df, keys, covs, [x, y])
    order = [f"m_{a}_{b}" for i, a in enumerate(names) for b in names[i:]]

    @F.pandas_udf("double")
    def solve(m: pd.Series) -> pd.Series:
        k = len(names)
        iu = np.triu_indices(k)
        out = []
        for flat in m:
            g = np.zeros((k, k))
            g[iu] = flat
            g = g + np.triu(g, 1).T
            p = k - 2
            s = g[p:, p:] - g[p:, :p] @ np.linalg.pinv(g[:p, :p]) @ g[:p, p:]
            den = s[0, 0] * s[1, 1]
            n = g[0, 0]
            flat_side = min(s[0, 0], s[1, 1]) / n < 1e-18
            out.append(None if flat_side or den <= 0 else float(s[0, 1] / np.sqrt(den)))
        return pd.Series(out, dtype="float64")

    return moments.select(*keys, solve(F.array(*order)).alias("partial_r"))
