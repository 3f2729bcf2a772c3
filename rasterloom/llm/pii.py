"""Personal data: overlapping candidate spans, boosted trees, calibrated thresholds.

Base spans follow fixed formats and checks and always stay. Generators propose more
spans of the same kinds in looser formats, overlapping each other. Gradient
boosted trees score every candidate by its format and context; per kind, the
lowest score above which held-out candidates are right often enough selects.

Labels need no annotation. Right are base spans; wrong are candidates that fail the check
of their kind, that lie across a base span of another kind, or that a word such as ``version``
or ``token`` announces as something else. The last two pass the check, so the
trees choose among plausible candidates. All others stay unlabelled and are only scored.

Everything is expressions over one row, so texts never move and are searched once; spans
are sorted and swept, so the work of a text grows with its spans, not with their
square. The trees become one expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.llm.shared import discard, row_struct, with_text, written

KINDS = ["email", "ip", "card", "phone"]
# The base formats. Possessive quantifiers match the same, since nothing
# follows a repeated part that it could give characters back to, and they need no stack.
LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions without which a base format cannot match.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
AT, DOT = r"(?:@|\((?:at|AT)\)|\[(?:at|AT)\])", r"(?:\.|\((?:dot|DOT)\)|\[(?:dot|DOT)\]|\[\.\])"
#: Looser formats; several may propose overlapping spans.
LOOSE = [
    ("email", rf"(?<!{LOCAL}){LOCAL}++\x20?{AT}\x20?{LABEL}++(?:\x20?{DOT}\x20?{LABEL}++)*+", r"@|\([aA][tT]\)|\[[aA][tT]\]"),
    ("ip", r"(?<![0-9.])[0-9]{1,4}+(?:(?:\.|\[\.\])[0-9]{1,4}+){3}+(?![0-9])", r"[0-9](?:\.|\[\.\])[0-9]"),
    ("card", r"(?<![0-9])[0-9]{14,19}+(?![0-9])", r"[0-9]{14}"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}+(?![0-9])", r"[0-9]{4}[\x20.-][0-9]{4}[\x20.-]"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}+[\x20.-]?[0-9]{1,3}+(?![0-9])", r"[0-9]{4}[\x20.-][0-9]{4}[\x20.-]"),
    ("card", r"(?<![0-9])[0-9]{4}[\x20.-][0-9]{6}[\x20.-][0-9]{5}(?![0-9])", r"[0-9]{4}[\x20.-][0-9]{6}"),
    ("phone", r"(?<![0-9+])(?:\+?[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])", r"[0-9]{4}"),
    ("phone", r"\+[0-9][\x20().0-9-]{3,40}[0-9]", r"\+[0-9]"),
]
KEYWORDS = [
    r"(?i)(?:tel|phone|call|fax|mobil)",
    r"(?i)(?:mail|contact|write)",
    r"(?i)(?:\bip\b|host|addr|server)",
    r"(?i)(?:card|visa|credit|pay|account)",
    r"(?i)(?:token|key|hash|version|build|order|=)",
]
#: What announces something else, right before a candidate.
OTHERWISE = r"(?i)(?:token|key|hash|version|build|order|commit|sha|uuid|isbn|serial|\bv)[\s\p{Punct}]{0,3}$"
#: Labelled candidates that training takes at most of a kind and label, on average.
SAMPLE_ROWS = 20_000
TREES, DEPTH = 12, 3
#: Share of right ones among held-out candidates above a threshold.
PRECISION = 0.95
#: Candidates of all kinds that a kind's own share is drawn towards, and steps of the score.
WEIGHT, BINS = 20, 1000


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, start: Column, step, kind: str, chunk: int = 256) -> Column:
    """The states of a left fold, one per element, of SQL type ``kind``.

    Arrays can only be appended to by copying, so states are gathered in pieces.
    """

    def piece(part: Column, state: Column) -> Column:
        zero = F.struct(state.alias("s"), F.array().cast(f"array<{kind}>").alias("o"))
        follow = lambda a, x: let(step(a["s"], x), lambda s: F.struct(s.alias("s"), F.concat(a["o"], F.array(s)).alias("o")))
        return F.aggregate(part, zero, follow)

    def whole(v: Column) -> Column:
        zero = F.struct(start.cast(kind).alias("s"), F.array().cast(f"array<array<{kind}>>").alias("o"))
        follow = lambda a, c: let(
            piece(F.slice(v, c * chunk + 1, F.lit(chunk)), a["s"]),
            lambda r: F.struct(r["s"].alias("s"), F.concat(a["o"], F.array(r["o"])).alias("o")),
        )
        parts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int"))
        done = F.flatten(F.aggregate(parts, zero, follow)["o"])
        return F.when(F.size(v) > 0, done).otherwise(F.array().cast(f"array<{kind}>"))

    return let(values, whole)


def prefix_sums(values: Column, chunk: int = 256) -> Column:
    """Inclusive running sums of an array."""
    return scan(values, F.lit(0), lambda total, x: (total + x).cast("long"), "bigint", chunk)


SPAN = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def found(df: DataFrame, formats: list[tuple[str, str, str]]) -> DataFrame:
    """Add a column per format: its leftmost non-overlapping matches in ``text``, with context.

    ``formats`` has (column, pattern, hint); texts without the hint are not searched.
    Positions count code points, ends are exclusive.
    """
    text, none = F.col("text"), F.array().cast("array<string>")
    hit = {c: F.when(text.rlike(h), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for c, p, h in formats}
    df = df.withColumns({f"{c}_m": m for c, m in hit.items()})
    df = df.withColumns(
        {f"{c}_g": F.when(F.size(f"{c}_m") > 0, F.split(text, p, -1)).otherwise(none) for c, p, _ in formats}
    )

    def place(c: str) -> Column:
        m, g = F.col(f"{c}_m"), F.col(f"{c}_g")
        step = F.transform(
            m, lambda x, i: (F.char_length(F.get(g, i)) + F.when(i > 0, F.char_length(F.get(m, i - 1))).otherwise(0)).cast("long")
        )
        whole = F.zip_with(
            F.transform(m, lambda x, i: F.struct(x.alias("value"), F.right(F.get(g, i), F.lit(24)).alias("before"), F.left(F.get(g, i + 1), F.lit(4)).alias("after"))),
            prefix_sums(step),
            lambda x, s: F.struct(
                s.alias("start"), (s + F.char_length(x["value"])).alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")
            ),
        )
        return F.when(F.size(m) > 0, whole).otherwise(F.array().cast(SPAN))

    return df.withColumns({c: place(c) for c, _, _ in formats}).drop(*[f"{c}_{x}" for c, _, _ in formats for x in "mg"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the check digit of a string of digits is right."""

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(i % 2 == 1, twice).otherwise(d)

    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), part)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The check of a kind, whatever the format."""
    if kind == "email":
        return value.rlike(rf"(?:@|[aA][tT][)\]]).*{DOT}")
    if kind == "ip":
        parts = F.split(F.regexp_replace(value, r"\[\.\]", "."), r"\.")
        short = F.transform(parts, lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(short, lambda p: (F.char_length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        return F.char_length(digits(value)).between(14, 19) & luhn(F.substring(digits(value), 1, 19))
    return F.char_length(digits(value)).between(10, 15)


def _named(spans: Column, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"),
            s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after"),
        ),
    )


def reaches(base: Column, loose: Column) -> Column:
    """Per candidate, the farthest end of each kind's base spans that begin before it ends.

    A candidate meets a base span of a kind just if that end lies behind its start. Starts of base
    spans and ends of candidates are swept together.
    """
    opens = F.transform(
        base, lambda b: F.struct(b["start"].alias("pos"), F.lit(1).alias("opens"), F.lit(0).alias("at"), b["kind"].alias("kind"), b["end"].alias("end"))
    )
    closes = F.transform(
        loose, lambda c, i: F.struct(c["end"].alias("pos"), F.lit(0).alias("opens"), i.alias("at"), c["kind"].alias("kind"), F.lit(0).cast("long").alias("end"))
    )
    step = lambda far, e: F.transform(
        far, lambda v, k: F.when((e["opens"] == 1) & (e["kind"] == k), F.greatest(v, e["end"])).otherwise(v)
    )
    nothing = F.array(*[F.lit(0).cast("long") for _ in KINDS])

    def swept(events: Column) -> Column:
        both = F.zip_with(
            events, scan(events, nothing, step, "array<bigint>"), lambda e, far: F.struct(e["at"].alias("at"), e["opens"].alias("opens"), far.alias("far"))
        )
        return F.transform(F.array_sort(F.filter(both, lambda r: r["opens"] == 0)), lambda r: r["far"])

    return let(F.array_sort(F.concat(opens, closes)), swept)


def base_and_candidates(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``doc_id, base, loose``: checked base spans by start, and all proposed spans with the base matches that fail.

    A proposed span tells whether it is ``valid`` and meets a base span of its own kind
    (``own``) or another (``other``). With ``whole``, ``row`` holds all columns of ``docs``.
    """
    keep = [row_struct(docs)] if whole else []
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    loose = [(f"l{k}", p, h) for k, (_, p, h) in enumerate(LOOSE)]
    df = found(df, [(k, BASE[k], HINT[k]) for k in KINDS] + loose).drop("text")

    def checked(k: str, wanted: bool) -> Column:
        return _named(F.filter(k, lambda s: valid(k, s["value"]) == wanted), k)

    bad = [checked(k, False) for k in KINDS]
    more = [_named(F.col(f"l{k}"), kind) for k, (kind, _, _) in enumerate(LOOSE)]
    once = lambda a: F.filter(a, lambda c, i: (i == 0) | (c != F.get(a, i - 1)))
    df = df.select(
        "doc_id",
        *(["row"] if whole else []),
        F.array_sort(F.concat(*[checked(k, True) for k in KINDS])).alias("base"),
        let(F.array_sort(F.concat(*bad, *more)), once).alias("loose"),
    )
    passes = lambda c: reduce(lambda a, b: a | b, [(c["kind"] == i) & valid(k, c["value"]) for i, k in enumerate(KINDS)])
    more = F.zip_with(
        "loose",
        reaches(F.col("base"), F.col("loose")),
        lambda c, far: F.struct(
            *[c[x].alias(x) for x in ("start", "kind", "end", "value", "before", "after")],
            passes(c).alias("valid"),
            (F.get(far, c["kind"]) > c["start"]).alias("own"),
            F.exists(F.transform(far, lambda v, k: (k != c["kind"]) & (v > c["start"])), lambda x: x).alias("other"),
        ),
    )
    return df.withColumn("loose", more)


def features(c: Column) -> Column:
    """Format and context of a candidate, as numbers."""
    v, before, after = c["value"], c["before"], c["after"]
    d = digits(v)
    count = lambda pattern: F.regexp_count(v, F.lit(pattern))
    flags = [
        *[c["kind"] == k for k in range(len(KINDS))],
        v.startswith("+"), v.contains("@"), v.contains("("), v.rlike(r"\[|\((?:at|AT|dot|DOT)\)"),
        before.rlike(r"[\p{L}]$"), before.rlike("[0-9]$"), before.rlike(r"(?:^|\s)$"), before.rlike(r"[\"'=#/_-]$"),
        after.rlike(r"^\p{L}"), after.rlike("^[0-9]"), after.rlike(r"^(?:\s|$)"), after.rlike(r"^[\"'=#/_-]"), before.rlike("[0-9]"),
        *[before.rlike(k) for k in KEYWORDS],
    ]
    numbers = [
        F.char_length(v), F.char_length(d), count("[0-9]+"), count(r"[\x20.()-]"), count(r"\p{L}+"),
        F.size(F.array_distinct(F.split(d, ""))),
    ]
    return F.array(*[f.cast("double") for f in flags], *[n.cast("double") for n in numbers])


def labelled(spans: DataFrame) -> DataFrame:
    """``kind, label, f, h`` of candidates that are known to be right or wrong; ``h`` hashes kind and value."""
    doubtful = lambda c: c["before"].rlike(OTHERWISE)
    right = F.filter("base", lambda c: ~doubtful(c))
    wrong = F.filter("loose", lambda c: ~c["valid"] | c["other"] | (doubtful(c) & ~c["own"]))
    tagged = lambda a, label: F.transform(
        a, lambda c: F.struct(c["kind"].alias("kind"), F.lit(label).alias("label"), c["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after"))
    )
    rows = spans.select(F.explode(F.concat(tagged(right, 1.0), tagged(wrong, 0.0))).alias("c"))
    return rows.select("c.kind", "c.label", features(F.col("c")).alias("f"), F.xxhash64("c.kind", "c.value").alias("h"))


def tree_expression(node, f: Column) -> Column:
    """A fitted regression tree as an expression over the feature array."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    test = f[split.featureIndex()] <= F.lit(float(split.threshold()))
    return F.when(test, tree_expression(node.leftChild(), f)).otherwise(tree_expression(node.rightChild(), f))


class Model:
    """Boosted trees and a threshold per kind; without training data it selects nothing."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[int, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def score(self, f: Column) -> Column:
        margin = reduce(lambda a, b: a + b, [tree_expression(t, f) * F.lit(w) for t, w in zip(self.trees, self.weights)])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def thresholds(counts: list[tuple[int, int, int, int]], precision: float) -> dict[int, float]:
    """Per kind, the least score above which enough is right, of ``(kind, bin, right, n)``.

    A kind's share of right candidates is drawn towards that of all kinds as if it had
    ``WEIGHT`` more of theirs; so a rare kind follows all kinds, a frequent one itself,
    and none is switched off for want of rows.
    """
    right, n = ({k: [0] * (BINS + 1) for k in range(len(KINDS))} for _ in "rn")
    for kind, at, r, m in counts:
        right[kind][at] += r
        n[kind][at] += m
    out, r, m = {}, [0] * len(KINDS), [0] * len(KINDS)
    for at in range(BINS, -1, -1):
        for k in right:
            r[k] += right[k][at]
            m[k] += n[k][at]
        pooled = (sum(r) + 0.5) / (sum(m) + 1)
        for k in right:
            if r[k] + WEIGHT * pooled >= precision * (m[k] + WEIGHT) and sum(m):
                out[k] = at / BINS
    return out


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, precision: float = PRECISION, seed: int = 1) -> Model:
    """Train and calibrate on the candidates of ``docs``, see ``fit_spans``."""
    spans = written(base_and_candidates(docs), "pii-spans")
    model = fit_spans(spans, sample_rows, precision, seed)
    discard(spans)
    return model


def fit_spans(spans: DataFrame, sample_rows: int = SAMPLE_ROWS, precision: float = PRECISION, seed: int = 1) -> Model:
    """Train on four fifths of the labelled values, calibrate on all candidates with the others.

    Training takes a sample by a hash of the value, ``sample_rows`` of a kind and label on
    average at most; calibration counts every held-out candidate. Without right or
    without wrong candidates nothing can be learned and the model adds nothing.
    """
    rows = written(labelled(spans), "pii-labelled")
    held = F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.lit(5)) == 0
    sizes = rows.where(~held).groupBy("kind", "label").count().collect()
    if len({r["label"] for r in sizes}) < 2:
        discard(rows)
        return Model([], [], {})
    place = F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1_000_000))
    share = reduce(
        lambda a, b: a | b,
        [(F.col("kind") == r["kind"]) & (F.col("label") == r["label"]) & (place < int(1_000_000 * min(1.0, sample_rows / r["count"]))) for r in sizes],
    )
    # in a fixed order and one partition, so that every run fits the same trees
    train = rows.where(~held & share).orderBy("kind", "label", "f").coalesce(1)
    fitted = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, cacheNodeIds=False
    ).fit(train.select("label", array_to_vector("f").alias("features")))
    roots = [t._call_java("rootNode") for t in fitted.trees]
    model = Model(roots, list(fitted.treeWeights), {})
    scored = rows.where(held).select("kind", "label", F.floor(model.score(F.col("f")) * BINS).cast("int").alias("at"))
    counts = scored.groupBy("kind", "at").agg(F.sum("label").cast("long").alias("right"), F.count(F.lit(1)).alias("n"))
    model.thresholds = thresholds([tuple(r) for r in counts.collect()], precision)
    discard(rows)
    return model


SCORED = "struct<start:bigint,kind:int,end:bigint,p:double>"


def sweep(picked: Column) -> Column:
    """Of candidates sorted by start, those that stay: where two meet, the later replaces the earlier if it ranks higher."""
    rank = lambda c: F.struct(c["p"], c["end"] - c["start"], -c["kind"])
    step = lambda now, c: F.when((c["start"] >= now["end"]) | (rank(c) > rank(now)), c).otherwise(now)
    nothing = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("kind"), F.lit(-1).alias("end"), F.lit(-1.0).alias("p"))

    def last_of_each(s: Column) -> Column:
        return F.filter(s, lambda c, i: (i == F.size(s) - 1) | (F.get(s, i + 1)["start"] >= c["end"]))

    return let(scan(picked, nothing, step, SCORED), last_of_each)


def find_spans(docs: DataFrame, model: Model | None = None, whole: bool = False) -> DataFrame:
    """Personal data of every document.

    Returns ``doc_id, base, spans`` per row: arrays of structs ``start, kind, end``
    (code points, end exclusive; ``kind`` is a place in ``KINDS``), sorted by start, then
    kind. ``spans`` holds all base spans and those that the model adds; a candidate is
    added if it reaches its kind's threshold, passes its kind's check, touches no base
    span, is not announced as something else, and a sweep from left to right finds none that meets it and ranks higher (by score, then length, then kind). ``model`` is fitted on
    ``docs`` unless given. ``whole`` adds ``row``, all columns of ``docs``. Null texts count as empty; ids may repeat or be null; an empty table
    gives no rows. Other columns are ignored.
    """
    if model is None:
        spans = written(base_and_candidates(docs), "pii-spans")
        model = fit_spans(spans)
        spans = base_and_candidates(docs, whole) if whole else spans
    else:
        spans = base_and_candidates(docs, whole)
    keep = ["doc_id", "row"] if whole else ["doc_id"]
    place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.transform("base", place).alias("base")
    if not model.thresholds:
        return spans.select(*keep, base, base.alias("spans"))
    cut = F.create_map(*[F.lit(x) for k, t in model.thresholds.items() for x in (k, float(t))])
    free = F.filter("loose", lambda c: c["valid"] & ~c["own"] & ~c["other"] & ~c["before"].rlike(OTHERWISE))
    scored = F.transform(
        free,
        lambda c: F.struct(
            c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), let(features(c), model.score).alias("p")
        ),
    )
    picked = F.filter(scored, lambda c: c["p"] >= F.coalesce(F.try_element_at(cut, c["kind"]), F.lit(2.0)))
    out = spans.withColumn("added", sweep(F.array_sort(picked.cast(f"array<{SCORED}>"))))
    both = F.array_sort(F.concat("base", F.transform("added", place)))
    return out.select(*keep, base, "added").select(*keep, "base", both.alias("spans"))


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; other columns stay.

    A span that begins inside another is hidden with it under the first one's kind.
    Null texts stay null, ``n_chars`` follows the text.
    """
    found = find_spans(docs, model, whole=True)
    text, spans = F.col("row.text"), F.col("spans")
    # how far the text is hidden before a span: the farthest end among the spans before it
    far = scan(spans, F.lit(0), lambda e, s: F.greatest(e, s["end"]), "bigint")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.slice(far, F.lit(1), F.greatest(F.size(far) - 1, F.lit(0))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(s: Column, hidden: Column) -> Column:
        gap = F.substring(text, (hidden + 1).cast("int"), F.greatest(s["start"] - hidden, F.lit(0)).cast("int"))
        return F.when(s["start"] >= hidden, F.concat(gap, F.get(names, s["kind"]))).otherwise("")

    last = F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0))
    rest = F.substring(text, (last + 1).cast("int"), F.char_length(text))
    clean = F.when(F.size(spans) > 0, F.concat(F.array_join(F.zip_with(spans, ends, lambda s, e: F.when(s.isNotNull(), piece(s, e))), ""), rest)).otherwise(text)
    return with_text(found.withColumn("clean", clean), docs, "clean")
