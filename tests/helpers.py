"""Small planes and stacks, and their numpy counterparts."""

import numpy as np
from pyspark.sql import functions as F


def plane_df(spark, arrays: dict, seg: str = "s"):
    h, w = next(iter(arrays.values())).shape
    ys, xs = np.mgrid[0:h, 0:w]
    cols = [a.ravel().tolist() for a in arrays.values()]
    rows = list(zip(ys.ravel().tolist(), xs.ravel().tolist(), *cols))
    df = spark.createDataFrame(rows, ["y", "x", *arrays])
    return df.select(
        F.lit(seg).alias("seg"), F.lit(h).alias("h"), F.lit(w).alias("w"),
        F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *arrays,
    )


def volume_df(spark, a, seg: str = "s"):
    d, h, w = a.shape
    z, y, x = np.mgrid[0:d, 0:h, 0:w]
    rows = list(zip(z.ravel().tolist(), y.ravel().tolist(), x.ravel().tolist(), a.ravel().astype(int).tolist()))
    df = spark.createDataFrame(rows, ["z", "y", "x", "v"])
    ints = [F.col(c).cast("int").alias(c) for c in ("z", "y", "x", "v")]
    return df.select(F.lit(seg).alias("seg"), F.lit(d).alias("d"), F.lit(h).alias("h"), F.lit(w).alias("w"), *ints)


def back(df, value: str, shape, fill=np.nan):
    out = np.full(shape, fill, float)
    for r in df.select("y", "x", value).collect():
        if r[value] is not None:
            out[r.y, r.x] = r[value]
    return out


def box_edge(a, r):
    p = np.pad(a.astype(float), r, mode="edge")
    return sum(p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(2 * r + 1) for j in range(2 * r + 1)) / (2 * r + 1) ** 2


def uniform_mirror(a, size):
    left, right = size // 2, size - 1 - size // 2
    p = np.pad(a.astype(float), ((left, right), (left, right)), mode="symmetric")
    return sum(p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(size) for j in range(size)) / size**2


def flood(mask):
    """Components by spreading the smallest cell number until nothing changes."""
    ids = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    far = mask.size + 1
    while True:
        p = np.pad(np.where(mask, ids, far), 1, constant_values=far)
        low = np.min([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]], axis=0)
        new = np.where(mask, low, 0)
        if (new == ids).all():
            names = np.unique(new[mask])
            return np.where(mask, np.searchsorted(names, new) + 1, 0)
        ids = new


def tie_auc(score, pos):
    a, b = score[pos], score[~pos]
    return float(((a[:, None] > b[None]).sum() + 0.5 * (a[:, None] == b[None]).sum()) / (len(a) * len(b)))
