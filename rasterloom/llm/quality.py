"""Quality rules: robust multivariate outliers per language and source.

Every document gets counts and a vector of transformed statistics. Each group
(language and source) gets a minimum-covariance-determinant estimate: concentration
steps keep the half of the group that is nearest and estimate from it again, until no determinant
falls. Three starts, all from medians and median deviations, are tried for two steps, the one of least determinant
goes on. A document is rejected if its
Mahalanobis distance is beyond what a normal vector exceeds once in a million.

Vectors are kept as integers (1024 to the unit), so sums are exact and every run,
however its rows are dealt, gives the same estimates. Medians and the nearest half
come from counts of values and of distance bins; no group is ever gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rasterloom.llm.shared import written

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
PUNCTUATION = b".,;:!?\"'()-"
BLANK = b" \t\n\x0b\x0c\r"
UNIT = 1024
#: Statistics of the vector with the smallest spread that counts as normal variation.
FLOORS = {
    "word_length": 0.05,  # log of characters per word
    "symbols": 0.15,  # log(1 + 10 symbols per word)
    "dup_lines": 0.12,  # share of lines equal to an earlier one
    "repeats": 0.10,  # share of words in repeated three-word windows
    "upper": 0.20,  # log(0.02 + upper-case letters per character of words)
    "punctuation": 0.20,  # log(0.05 + punctuation per word)
}
DIMS = len(FLOORS)
#: What a covariance of its own takes; groups smaller than this are judged with the other small groups of their language.
LEAST_GROUP = 5 * DIMS
#: Steps that every start gets, and by how much a determinant must fall to count as moved.
TRIALS, MOVED = 2, 1e-9
#: Tables of at most this many groups (about 0.5 kB each) are broadcast.
BROADCAST_GROUPS = 10_000


def _without(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_punctuation."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    seen, lines, dup = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        size = len(number)
        pair = ids[:-2] * size + ids[1:-1]
        if size > 2_000_000:  # three numbers no longer fit one integer
            pair = np.unique(pair, return_inverse=True)[1]
        _, which, often = np.unique(pair * size + ids[2:], return_inverse=True, return_counts=True)
        again = often[which] >= 2
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeated = int(covered.sum())
    return (
        n,
        len(text) - _without(data, BLANK),
        _without(data, SYMBOLS),
        dup,
        repeated,
        lines,
        _without(data, UPPER),
        _without(data, PUNCTUATION),
    )


def vector(c: np.ndarray) -> np.ndarray:
    """Transformed statistics of rows of ``counts``, in 1/1024."""
    n, chars, symbols, dup, repeats, lines, upper, punct = c.astype(float).T
    w, ch, ln = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    stats = [np.log(ch / w), np.log1p(10 * symbols / w), dup / ln, repeats / w, np.log(upper / ch + 0.02), np.log(punct / w + 0.05)]
    return np.rint(np.stack(stats, 1) * UNIT).astype(np.int64)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``row, lang, source``, counts and vector ``v`` of every whole text.

    ``row`` is a struct of the id, or of all columns of ``docs`` if ``whole``.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns] if whole else [F.col("doc_id").cast("long").alias("doc_id")]
    place = docs.columns.index("text")
    rows = docs.select(
        F.struct(*columns).alias("row"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        *([] if whole else ["text"]),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(0).field(place) if whole else batch.column(3)
            table = np.array([counts(t.as_py()) for t in texts], np.int64)
            ends = pa.array(np.arange(0, DIMS * len(table) + 1, DIMS, dtype=np.int32))
            vectors = pa.ListArray.from_arrays(ends, pa.array(vector(table).ravel()))
            columns = [*batch.columns[:3], *[pa.array(table[:, k]) for k in range(len(COUNTS))], vectors]
            yield pa.RecordBatch.from_arrays(columns, ["row", "lang", "source", *COUNTS, "v"])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, lang string, source string, "
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = rows.mapInArrow(run, schema + ", ".join(f"{c} long" for c in COUNTS) + ", v array<long>")
    return counted.withColumn("base_failed", failed)


def _beside(small: DataFrame) -> DataFrame:
    """A table of groups: broadcast while it is known to be small, else left to a shuffled join."""
    return F.broadcast(small) if small.count() <= BROADCAST_GROUPS else small


def group_names(stats: DataFrame, least: int) -> DataFrame:
    """``l, s, gid``: the group whose estimate judges a language and source, null if too few are alike."""
    lang, both = F.to_json(F.array("lang")), F.to_json(F.array("lang", "source"))
    sizes = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < least
    of_lang = F.sum(F.when(small, F.col("n")).otherwise(0)).over(W.partitionBy("lang"))
    pooled = sizes.withColumn("gid", F.when(~small, both).when(of_lang >= least, lang))
    rest = F.sum(F.when(F.col("gid").isNull(), F.col("n")).otherwise(0)).over(W.partitionBy())
    named = pooled.withColumn("gid", F.coalesce("gid", F.when(rest >= least, F.lit("[]"))))
    return written(named.select(F.col("lang").alias("l"), F.col("source").alias("s"), "gid"), "quality-groups")


def named(stats: DataFrame, names: DataFrame) -> DataFrame:
    on = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    return stats.join(_beside(names), on, "left").drop("l", "s")


def _medians(rows: DataFrame) -> DataFrame:
    """Per group ``med`` and ``spread``: medians and scaled median deviations of each statistic, not below its floor."""
    hist = rows.select("gid", F.posexplode("v").alias("dim", "x")).groupBy("gid", "dim", "x").agg(F.count(F.lit(1)).alias("c"))

    def median(h: DataFrame, value: str, name: str) -> DataFrame:
        w = W.partitionBy("gid", "dim")
        run = F.sum("c").over(w.orderBy(value))
        return (
            h.withColumns({"_run": run, "_all": F.sum("c").over(w)})
            .where("2 * _run >= _all")
            .groupBy("gid", "dim")
            .agg(F.min(value).alias(name))
        )

    med = median(hist, "x", "med")
    apart = hist.join(med, ["gid", "dim"]).groupBy("gid", "dim", F.abs(F.col("x") - F.col("med")).alias("a"))
    both = med.join(median(apart.agg(F.sum("c").alias("c")), "a", "mad"), ["gid", "dim"])
    floor = F.element_at(F.array(*[F.lit(f) for f in FLOORS.values()]), F.col("dim") + 1)
    both = both.withColumn("spread", F.greatest(F.col("mad") * 1.4826 / UNIT, floor))
    lists = both.groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("dim", "med", "spread"))).alias("s"))
    return lists.select("gid", F.transform("s", lambda e: e["med"]).alias("med"), F.transform("s", lambda e: e["spread"]).alias("spread"))


def starts(rows: DataFrame) -> DataFrame:
    """Three estimates ``k`` per group: from the half nearest to the medians by squares, by sums and by the largest of the scaled deviations."""
    z = [F.abs(F.col("v")[i] - F.col("med")[i]) / UNIT / F.col("spread")[i] for i in range(DIMS)]
    norms = [sum((x * x for x in z[1:]), z[0] * z[0]), sum(z[1:], z[0]), F.greatest(*z)]
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _bin(n).alias("b")) for k, n in enumerate(norms)]))
    medians = written(_medians(rows), "quality-medians")
    placed = rows.join(_beside(medians), "gid").select("gid", "v", kinds.alias("e")).select("gid", "e.k", "v", "e.b")
    return nearest_half(placed)


ESTIMATE = "gid string, k int, mu array<double>, inv array<double>, det double"
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def _chi2(x: float, dims: int) -> float:
    """Chi-square distribution for an even number of dimensions."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dims // 2))


def chi2_quantile(q: float, dims: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi2(mid, dims) < q else (lo, mid)
    return lo


#: What the covariance of the nearest half of a normal sample is short of the whole's.
CONSISTENCY = 0.5 / _chi2(chi2_quantile(0.5, DIMS), DIMS + 2)


def distance() -> Column:
    """Squared Mahalanobis distance of ``v`` from the estimate beside it."""
    d = [F.col("v")[i] / F.lit(float(UNIT)) - F.col("mu")[i] for i in range(DIMS)]
    terms = [d[i] * d[j] * F.col("inv")[i * DIMS + j] * (1 if i == j else 2) for i, j in PAIRS]
    return sum(terms[1:], terms[0])


def _bin(d2: Column) -> Column:
    return F.floor(F.log1p(F.greatest(d2, F.lit(0.0))) * 64)


def nearest_half(placed: DataFrame) -> DataFrame:
    """Estimates from the nearest half of every group and start, ``placed`` being ``gid, k, v`` with a distance bin ``b``."""
    w = W.partitionBy("gid", "k")
    cut = (
        placed.groupBy("gid", "k", "b").agg(F.count(F.lit(1)).alias("c"))
        .withColumns({"_run": F.sum("c").over(w.orderBy("b")), "_all": F.sum("c").over(w)})
        .where(f"2 * _run >= _all + {DIMS + 1}")
        .groupBy("gid", "k")
        .agg(F.min("b").alias("cut"))
    )
    cut = written(cut, "quality-cut")
    near = placed.join(_beside(cut), ["gid", "k"]).where("b <= cut")
    sums = near.groupBy("gid", "k").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col("v")[i]) for i in range(DIMS)]).alias("s1"),
        F.array(*[F.sum(F.col("v")[i] * F.col("v")[j]) for i, j in PAIRS]).alias("s2"),
    )

    def run(batches):
        floor = np.diag(np.square(list(FLOORS.values())))
        for pdf in batches:
            out = []
            for gid, k, n, s1, s2 in zip(pdf["gid"], pdf["k"], pdf["n"], pdf["s1"], pdf["s2"]):
                # exact integers until the last division
                cov = np.zeros((DIMS, DIMS))
                for (i, j), s in zip(PAIRS, s2):
                    cov[i, j] = cov[j, i] = (int(s) * int(n) - int(s1[i]) * int(s1[j])) / (int(n) ** 2 * UNIT**2)
                cov = cov * CONSISTENCY + floor
                mu = [int(s) / (int(n) * UNIT) for s in s1]
                out.append((gid, k, mu, np.linalg.inv(cov).ravel().tolist(), float(np.linalg.det(cov))))
            yield pd.DataFrame(out, columns=["gid", "k", "mu", "inv", "det"])

    return sums.mapInPandas(run, ESTIMATE)


def concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step for every estimate."""
    beside = _beside(estimate.select("gid", "k", "mu", "inv"))
    return nearest_half(rows.join(beside, "gid").select("gid", "k", "v", _bin(distance()).alias("b")))


def estimates(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates, one per group.

    Of the three starts the one with the least determinant after ``TRIALS`` steps goes on (of equal ones
    the first). A group is done when a step no longer lowers its determinant; what it had before stays. Every step lowers the
    determinant of each group that is left, so the steps end, and only such groups are gone through again.
    """
    now = written(starts(rows), "quality-start")
    for _ in range(TRIALS):
        now = written(concentrate(rows, now), "quality-step")
    best = F.min_by(F.struct("k", "mu", "inv", "det"), F.struct("det", "k")).alias("e")
    now, done = written(now.groupBy("gid").agg(best).select("gid", "e.*"), "quality-step"), None
    while True:
        after = written(concentrate(rows, now), "quality-step")
        fell = after.join(now.select("gid", F.col("det").alias("was")), "gid").where(f"det < was * (1 - {MOVED})").drop("was")
        fell = written(fell, "quality-step")
        still = now.join(fell.select("gid"), "gid", "left_anti")
        done = still if done is None else done.unionByName(still)
        if fell.isEmpty():
            return written(done, "quality-estimates")
        now = fell


def fit(stats: DataFrame, least_group: int = LEAST_GROUP) -> tuple[DataFrame, DataFrame]:
    """Group names and estimates from all documents that pass the base rules."""
    good = stats.where("NOT base_failed")
    names = group_names(good, least_group)
    rows = written(named(good.select("lang", "source", "v"), names).where("gid IS NOT NULL").select("gid", "v"), "quality-vectors")
    return names, estimates(rows)


def verdicts(stats: DataFrame, names: DataFrame, found: DataFrame, tail: float) -> DataFrame:
    """Add ``distance`` and ``kept``."""
    d2 = F.when(F.col("mu").isNotNull(), distance())
    within = F.coalesce(d2 <= chi2_quantile(1 - tail, DIMS), F.lit(True))
    judged = named(stats, names).join(_beside(found), "gid", "left")
    return judged.withColumns({"distance": d2, "kept": ~F.col("base_failed") & within})


def judge(docs: DataFrame, tail: float = 1e-6, least_group: int = LEAST_GROUP) -> DataFrame:
    """Counts and verdict per document.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance, kept`` per row. ``base_failed``: fewer than 50 words, or
    more than half of the words in repeated three-word windows. ``kept`` is false for
    those and for documents whose squared ``distance`` exceeds the chi-square quantile
    at ``1 - tail``. Estimates rest on all documents that do not fail the base rules.

    Null texts have no words. Null languages and sources are groups like any other.
    Groups under ``least_group`` documents are judged with the other small groups of
    their language, then with all small groups; where even those are too few,
    ``distance`` is null and the base rules decide. Repeated rows and ids count each.
    An empty table gives no rows. Other columns are ignored.
    """
    stats = written(statistics(docs), "quality-stats")
    names, found = fit(stats, least_group)
    return verdicts(stats, names, found, tail).select("row.doc_id", *COUNTS, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, tail: float = 1e-6, least_group: int = LEAST_GROUP) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Estimates come first; then the texts are read once more and each row is judged
    where it stands, so texts are never shuffled and rows need no key.
    """
    stats = written(statistics(docs), "quality-stats")
    names, found = fit(stats, least_group)
    return verdicts(statistics(docs, whole=True), names, found, tail).where("kept").select("row.*")
