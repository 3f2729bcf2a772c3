"""Depth-stack operators.

A stack is a relation of voxels, partitioned by column ``(seg, y, x)``; whatever
is computed per column needs no exchange of its own. Per-layer and per-segment
figures are aggregated map-side and joined back as small tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.operators import quantiles

COLUMN = ["seg", "y", "x"]


def layer_profile(vol: DataFrame, keys=("seg",)) -> DataFrame:
    return vol.groupBy(*keys, "z").agg(F.avg("v").alias("mean"))


def layer_peak(vol: DataFrame, keys=("seg",)) -> DataFrame:
    """Brightest layer (first on ties) and the contrast of the profile."""
    prof = layer_profile(vol, keys)
    return prof.groupBy(*keys).agg(
        F.max_by("z", F.struct("mean", -F.col("z"))).alias("pk"),
        (F.max("mean") - F.min("mean")).alias("span"),
    )


def with_peak(vol: DataFrame, keys=("seg",)) -> DataFrame:
    return vol.join(layer_peak(vol, keys), list(keys))


def around_peak(vol: DataFrame, keep: int) -> DataFrame:
    """Only layers within ``keep`` of the peak; layer numbers start at 0 again."""
    v = with_peak(vol).where(F.abs(F.col("z") - F.col("pk")) <= keep)
    base = F.greatest(F.col("pk") - keep, F.lit(0))
    return v.withColumn("z", F.col("z") - base).withColumn("pk", F.col("pk") - base)


def height_map(vol: DataFrame, band: int, um: float) -> DataFrame:
    """Intensity-weighted depth around the peak in microns, mean removed."""
    v = with_peak(vol).where(F.abs(F.col("z") - F.col("pk")) <= band)
    h = v.groupBy(*COLUMN).agg(
        (
            F.sum(F.col("v") * (F.col("z") - F.col("pk")))
            / F.greatest(F.sum("v").cast("double"), F.lit(1e-6))
            * um
        ).alias("_h")
    )
    mean = h.groupBy("seg").agg(F.avg("_h").alias("_m"))
    return h.join(mean, "seg").select(*COLUMN, (F.col("_h") - F.col("_m")).alias("height"))


def band_mean(vol: DataFrame, band: int, offset: int = 0) -> DataFrame:
    """Mean of ``2*band+1`` layers around the peak plus offset, kept inside the stack."""
    top = F.greatest(F.lit(band), F.col("d") - band - 1)
    centre = F.greatest(F.lit(band), F.least(F.col("pk") + offset, top))
    v = with_peak(vol).where(F.abs(F.col("z") - centre) <= band)
    return v.groupBy(*COLUMN).agg(
        F.avg("v").alias("img"), F.first("h").alias("h"), F.first("w").alias("w")
    )


def sheet_centroid(vol: DataFrame, lo: int, hi: int) -> DataFrame:
    """Depth centroid of the column's intensity above its own minimum in [lo, hi)."""
    c = vol.where((F.col("z") >= lo) & (F.col("z") < hi)).groupBy(*COLUMN).agg(
        F.min("v").alias("_mn"),
        F.sum("v").alias("_s"),
        F.sum(F.col("v") * F.col("z")).alias("_sz"),
        F.sum("z").alias("_z"),
        F.count(F.lit(1)).alias("_n"),
    )
    tot = F.col("_s") - F.col("_n") * F.col("_mn")
    num = F.col("_sz") - F.col("_mn") * F.col("_z")
    return c.select(
        *COLUMN, F.when(tot > 1e-3, num / tot).otherwise(F.lit((lo + hi) / 2.0)).alias("depth")
    )


def response_label(vol: DataFrame, floor: float, contrast: float) -> DataFrame:
    """Per column: does the best layer clear the floor, is it distinct, where is it."""
    best = F.max(F.struct("v", (-F.col("z")).alias("neg")))
    r = vol.groupBy(*COLUMN).agg(best.alias("_b"), F.median("v").alias("_med"))
    return r.select(
        *COLUMN,
        (F.col("_b.v") >= floor).alias("ink"),
        ((F.col("_b.v") - F.col("_med")) >= contrast).alias("sharp"),
        (-F.col("_b.neg")).alias("depth"),
    )


def tails(vol: DataFrame, hi_pct: float, lo_pct: float, least: int = 1000) -> DataFrame:
    """Voxels with flags for the bright and dark tail of the non-air values."""
    solid = F.when(F.col("v") > 0, F.col("v"))
    cuts = vol.groupBy("seg").agg(
        quantiles.byte_percentile(solid, hi_pct).alias("_hi"),
        quantiles.byte_percentile(solid, lo_pct).alias("_lo"),
        F.count(solid).alias("_n"),
    ).where(F.col("_n") >= least)
    on = F.col("v") > 0
    return vol.join(cuts, "seg").withColumns(
        {"hot": (F.col("v") >= F.col("_hi")) & on, "cold": (F.col("v") <= F.col("_lo")) & on}
    ).drop("_hi", "_lo", "_n")


def columns_as_arrays(vol: DataFrame) -> DataFrame:
    """One row per column holding its layers in order."""
    stacked = F.array_sort(F.collect_list(F.struct("z", "v")))
    return vol.groupBy(*COLUMN).agg(
        F.transform(stacked, lambda s: s["v"].cast("double")).alias("prof")
    )


#: Side of the squares of columns that a segment's shares are.
SHARE = 64


def layer_covariance(vol: DataFrame) -> DataFrame:
    """Covariance of layers across columns, per segment: rows (seg, i, j, c).

    Columns of a segment are brought together, a large segment in several shares, and sorted;
    a task adds up one small cross-product matrix per share, so the sums that meet
    are a few per segment however many batches and segments there are. They carry the
    layers' own sums, so nothing is joined.
    """
    share = [F.floor(F.col(c) / SHARE) for c in ("y", "x")]
    cols = columns_as_arrays(vol).repartition("seg", *share).sortWithinPartitions("seg").select("seg", "prof")

    def told(seg: str, g: np.ndarray) -> pd.DataFrame:
        i, j = (v.ravel() for v in np.indices((len(g) - 1, len(g) - 1)))
        return pd.DataFrame({"seg": seg, "i": i, "j": j, "s": g[1:, 1:].ravel(), "mi": g[0, i + 1], "mj": g[0, j + 1], "n": g[0, 0]})

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            for seg, part in pdf.groupby("seg"):
                # sorted: what another segment follows is complete
                for done in [k for k in held if k != seg]:
                    yield told(done, held.pop(done))
                x = np.stack(part["prof"].to_numpy())
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                held[seg] = held.get(seg, 0) + x.T @ x
        for seg, g in held.items():
            yield told(seg, g)

    sums = cols.mapInPandas(grams, "seg string, i int, j int, s double, mi double, mj double, n double")
    sums = sums.groupBy("seg", "i", "j").agg(*[F.sum(c).alias(c) for c in ("s", "mi", "mj", "n")])
    c = F.col("s") / F.col("n") - F.col("mi") / F.col("n") * F.col("mj") / F.col("n")
    return sums.select("seg", "i", "j", c.alias("c"))


LOADINGS = "array<struct<explained:double,loading:array<double>>>"


def _leading(cells: pd.Series, k: pd.Series) -> pd.Series:
    out = []
    for entries, n in zip(cells, k):
        d = max(int(e["i"]) for e in entries) + 1
        cov = np.zeros((d, d))
        for e in entries:
            cov[int(e["i"]), int(e["j"])] = e["c"]
        vals, vecs = np.linalg.eigh(cov)
        order = np.argsort(vals)[::-1][: int(n)]
        vals, vecs = vals[order], vecs[:, order]
        rows = []
        for c in range(len(order)):
            v = vecs[:, c]
            v = -v if v[np.argmax(np.abs(v))] < 0 else v
            rows.append({"explained": float(vals[c] / vals.sum()), "loading": v.tolist()})
        out.append(rows)
    return pd.Series(out)


def depth_basis(vol: DataFrame, k: int) -> DataFrame:
    """Leading components of the pooled layer covariance: (comp, explained, loading).

    The pooled matrix is depth x depth whatever the data volume. Shares are over
    the retained components; each loading's largest entry is positive.
    """
    pooled = layer_covariance(vol).groupBy("i", "j").agg(F.avg("c").alias("c"))
    one = pooled.agg(F.collect_list(F.struct("i", "j", "c")).alias("cells"))
    leading = F.pandas_udf(_leading, LOADINGS)
    return one.select(F.posexplode(leading("cells", F.lit(k))).alias("comp", "e")).select(
        "comp", "e.explained", "e.loading"
    )


def resample_loading(w: Column, n: int) -> Column:
    """Linear resampling of a loading to ``n`` layers, unit length again."""
    size = F.size(w)

    def at(i: Column) -> Column:
        pos = i * (size - 1) / F.lit(float(max(n - 1, 1)))
        lo = F.floor(pos).cast("int")
        hi = F.least(lo + 1, size - 1)
        return F.get(w, lo) + (F.get(w, hi) - F.get(w, lo)) * (pos - lo)

    raw = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(raw, lambda v: v / F.when(norm > 1e-9, norm).otherwise(1.0))


def project(vol: DataFrame, basis: DataFrame) -> DataFrame:
    """Score of every column on every component, layer means removed."""
    means = layer_profile(vol).withColumnRenamed("mean", "_m")
    free = vol.join(means, ["seg", "z"])
    # one row per component, each depth numbers long
    w = F.broadcast(basis.select("comp", F.posexplode("loading").alias("z", "wt")))
    return (
        free.join(w, "z")
        .groupBy(*COLUMN, "comp")
        .agg(F.sum((F.col("v") - F.col("_m")) * F.col("wt")).alias("score"))
    )
