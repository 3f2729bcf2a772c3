"""Line-wise raster windows.

Every neighbourhood operator here is separable: one pass along raster lines
(partition ``keys + y``, order ``x``) and one along columns (``keys + x``, order
``y``). A task only ever holds single lines, so a segment of any size spreads
over as many tasks as it has lines. Passes that share an axis share one
exchange and one sort; callers group their work by axis for that reason.

Sliding sums come from running sums looked up at both window ends, so the cost
does not depend on the radius; short ones are sums of neighbours.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

KEYS = ("seg",)
#: Reach up to which a sum of neighbours is cheaper than running sums.
NEAR = 4


@dataclass(frozen=True)
class Axis:
    """A raster direction: the cell coordinate it runs along and its extent."""

    pos: str
    others: tuple[str, ...]
    extent: str

    def window(self, keys=KEYS) -> WindowSpec:
        return Window.partitionBy(*keys, *self.others).orderBy(self.pos)


ROW = Axis("x", ("y",), "w")
COL = Axis("y", ("x",), "h")
DEPTH = Axis("z", ("y", "x"), "d")


def _full(win: WindowSpec) -> WindowSpec:
    return win.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def sliding_sum(
    df: DataFrame,
    axis: Axis,
    cols: dict[str, tuple[str, int, int]],
    mode: str = "replicate",
    keys=KEYS,
) -> DataFrame:
    """Add ``out = sum(in[pos-left .. pos+right])`` for each ``out: (in, left, right)``.

    ``mode`` says what lies beyond the edge: the edge value again
    (``replicate``), nothing (``zero``), or the mirrored line (``reflect``).
    Lines must be dense.
    """
    if max(max(left, right) for _, left, right in cols.values()) <= {"reflect": 1, "replicate": NEAR}.get(mode, 0):
        return _sliding_near(df, axis, cols, mode, keys)
    if mode == "reflect":
        return _sliding_reflect(df, axis, cols, keys)
    win = axis.window(keys)
    inputs = sorted({c for c, _, _ in cols.values()})
    upto = win.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    aux = {}
    for c in inputs:
        aux[f"_run_{c}"] = F.sum(c).over(upto)
        aux[f"_sum_{c}"] = F.sum(c).over(_full(win))
        if mode == "replicate":
            aux[f"_fst_{c}"] = F.first(c).over(_full(win))
            aux[f"_lst_{c}"] = F.last(c).over(_full(win))
    df = df.withColumns(aux)
    pos, last = F.col(axis.pos), F.col(axis.extent) - 1
    out = {}
    for name, (c, left, right) in cols.items():
        run, total = F.col(f"_run_{c}"), F.col(f"_sum_{c}")
        upper = F.coalesce(F.lead(run, right).over(win), total) if right else run
        value = upper - F.coalesce(F.lag(run, left + 1).over(win), F.lit(0))
        if mode == "replicate":
            value = (
                value
                + F.greatest(F.lit(left) - pos, F.lit(0)) * F.col(f"_fst_{c}")
                + F.greatest(pos + right - last, F.lit(0)) * F.col(f"_lst_{c}")
            )
        out[name] = value
    return df.withColumns(out).drop(*aux)


def _sliding_near(df, axis, cols, mode, keys) -> DataFrame:
    """Short windows as sums of neighbours: one window step, no running sums and no padding."""
    win = axis.window(keys)
    if mode == "reflect":
        # one step beyond the edge, the mirror image is the edge cell
        df = df.where(F.col(axis.pos).isNotNull())
    kinds = dict(df.dtypes)
    inputs = sorted({c for c, _, _ in cols.values()})
    kind = {c: "long" if kinds[c] in ("tinyint", "smallint", "int", "bigint") else "double" for c in inputs}
    value = {c: F.coalesce(F.col(c).cast(k), F.lit(0).cast(k)) for c, k in kind.items()}
    far = {side: max(n[k] for n in cols.values()) for k, side in ((1, F.lag), (2, F.lead))}
    near = {(c, side, j): side(value[c], j).over(win) for c in inputs for side, reach in far.items() for j in range(1, reach + 1)}
    for c in inputs if mode == "replicate" else ():
        near |= {(c, F.first): F.first(c).over(_full(win)), (c, F.last): F.last(c).over(_full(win))}
    named = {k: f"_near_{i}" for i, k in enumerate(near)}
    df = df.withColumns({named[k]: v for k, v in near.items()})
    pos, last = F.col(axis.pos), F.col(axis.extent) - 1
    out = {}
    for name, (c, left, right) in cols.items():
        beyond = value[c] if mode == "reflect" else F.lit(0).cast(kind[c])
        total = value[c]
        for side, reach in ((F.lag, left), (F.lead, right)):
            for j in range(1, reach + 1):
                total = total + F.coalesce(F.col(named[c, side, j]), beyond)
        if mode == "replicate":
            total = (
                total
                + F.greatest(F.lit(left) - pos, F.lit(0)) * F.col(named[c, F.first])
                + F.greatest(pos + right - last, F.lit(0)) * F.col(named[c, F.last])
            )
        out[name] = total
    return df.withColumns(out).drop(*named.values())


def _mirrored(pos: Column, n: Column, reach: int) -> Column:
    """Padded positions ``-reach .. n-1+reach`` a cell fills when the line is mirrored."""
    near = F.array_compact(
        F.array(pos, F.when(pos < reach, -1 - pos), F.when(pos >= n - reach, 2 * n - 1 - pos))
    )
    # a reach beyond the whole line folds back and forth
    turns = F.ceil(F.lit(reach) / (2 * n)).cast("int") + 1
    every = F.flatten(
        F.transform(F.sequence(-turns, turns), lambda k: F.array(pos + 2 * n * k, -1 - pos + 2 * n * k))
    )
    far = F.filter(every, lambda p: (p >= -reach) & (p < n + reach))
    return F.when(n >= reach, near).otherwise(far)


def _sliding_reflect(df, axis, cols, keys) -> DataFrame:
    reach = max(max(left, right) for _, left, right in cols.values())
    pos, n = F.col(axis.pos), F.col(axis.extent)
    padded = df.withColumn("_at", F.explode(_mirrored(pos, n, reach)))
    win = Window.partitionBy(*keys, *axis.others).orderBy("_at")
    upto = win.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inputs = sorted({c for c, _, _ in cols.values()})
    aux = {f"_run_{c}": F.sum(c).over(upto) for c in inputs}
    padded = padded.withColumns(aux)
    out = {}
    for name, (c, left, right) in cols.items():
        run = F.col(f"_run_{c}")
        upper = F.lead(run, right).over(win) if right else run
        out[name] = upper - F.coalesce(F.lag(run, left + 1).over(win), F.lit(0))
    return padded.withColumns(out).where(F.col("_at") == pos).drop(*aux, "_at")


def box_mean(df: DataFrame, cols: dict[str, tuple[str, int]], first: Axis = ROW, keys=KEYS):
    """Edge-replicated mean over ``(2r+1) x (2r+1)`` for each ``out: (in, r)``.

    Sums run over both axes and are divided once, so integer planes stay exact.
    """
    second = COL if first is ROW else ROW
    part = {f"_{o}": (c, r, r) for o, (c, r) in cols.items()}
    df = sliding_sum(df, first, part, keys=keys)
    df = sliding_sum(df, second, {o: (f"_{o}", r, r) for o, (_, r) in cols.items()}, keys=keys)
    return df.withColumns(
        {o: F.col(o) / float((2 * r + 1) ** 2) for o, (_, r) in cols.items()}
    ).drop(*part)


def uniform_mean(df: DataFrame, cols: dict[str, tuple[str, int]], first: Axis = ROW, keys=KEYS):
    """Mirror-edged ``size x size`` mean; even sizes reach one further back."""
    second = COL if first is ROW else ROW
    part = {f"_{o}": (c, s // 2, s - 1 - s // 2) for o, (c, s) in cols.items()}
    df = sliding_sum(df, first, part, "reflect", keys)
    again = {o: (f"_{o}", s // 2, s - 1 - s // 2) for o, (_, s) in cols.items()}
    df = sliding_sum(df, second, again, "reflect", keys)
    return df.withColumns({o: F.col(o) / float(s * s) for o, (_, s) in cols.items()}).drop(*part)


def valid_box(df: DataFrame, cols: dict[str, str], k: int, keys=KEYS) -> DataFrame:
    """``k x k`` sums anchored at the top-left cell, only where the box fits."""
    row = {f"_{o}": (c, 0, k - 1) for o, c in cols.items()}
    df = sliding_sum(df, ROW, row, "zero", keys).where(F.col("x") <= F.col("w") - k)
    df = sliding_sum(df, COL, {o: (f"_{o}", 0, k - 1) for o in cols}, "zero", keys)
    return df.where(F.col("y") <= F.col("h") - k).drop(*row)


def gradient(c: str, axis: Axis, keys=KEYS) -> Column:
    """Central difference, one-sided at the ends of the line."""
    win = axis.window(keys)
    here, prev, nxt = F.col(c), F.lag(c).over(win), F.lead(c).over(win)
    return (
        F.when(prev.isNull(), nxt - here)
        .when(nxt.isNull(), here - prev)
        .otherwise((nxt - prev) / 2.0)
        .cast("double")
    )


def line_extreme(df, axis: Axis, cols: dict[str, tuple[str, int]], how: str, keys=KEYS):
    """Windowed ``max`` or ``min`` over ``pos-r .. pos+r``, clipped at the edges."""
    agg = {"max": F.max, "min": F.min}[how]
    win = axis.window(keys)
    return df.withColumns({o: agg(c).over(win.rowsBetween(-r, r)) for o, (c, r) in cols.items()})


def square_extreme(df, cols: dict[str, tuple[str, int]], how: str, keys=KEYS) -> DataFrame:
    """Square-window ``max`` (dilation) or ``min`` (erosion, edges clipped)."""
    part = {f"_{o}": v for o, v in cols.items()}
    df = line_extreme(df, ROW, part, how, keys)
    df = line_extreme(df, COL, {o: (f"_{o}", r) for o, (_, r) in cols.items()}, how, keys)
    return df.drop(*part)


def gauss_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    total = sum(raw)
    return [v / total for v in raw]


def gaussian(df: DataFrame, cols: dict[str, str], sigma: float, keys=KEYS, first: Axis = ROW):
    """Separable Gaussian with mirrored edges.

    Each pass pads the line by mirroring and combines the neighbours with
    ``lag``/``lead``, which stay one sorted window whatever the radius.
    """
    weights = gauss_weights(sigma)
    r = len(weights) // 2
    second = COL if first is ROW else ROW
    for axis, pick in ((first, lambda o, c: c), (second, lambda o, c: o)):
        pos, n = F.col(axis.pos), F.col(axis.extent)
        padded = df.withColumn("_at", F.explode(_mirrored(pos, n, r)))
        win = Window.partitionBy(*keys, *axis.others).orderBy("_at")
        out = {}
        for o, c in cols.items():
            src = pick(o, c)
            terms = F.col(src) * weights[r]
            for i in range(1, r + 1):
                both = F.lag(src, i).over(win) + F.lead(src, i).over(win)
                terms = terms + both * weights[r + i]
            out[o] = terms
        df = padded.withColumns(out).where(F.col("_at") == pos).drop("_at")
    return df
