import base64
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import (
    exact_dedup, graph, hashing, line_dedup, mixing, ngram_join, pii, quality, sentencepiece_codec, sharding, substring_dedup, warc,
)
from rasterloom.llm.registry import ORACLES, QUERIES
from rasterloom.llm.shared import documents, n_words, shared_folder
from check import compare, duck
from tests.conftest import SF
from tests.llm import brute

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like those the operators work with.
CLASHING = ["kept", "d", "row", "size", "gid", "n", "cell", "h", "start", "block", "take", "bits", "page", "digest", "ids", "hs"]


def some_words(rnd, n):
    return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rnd.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rnd = random.Random(3)
    base = [some_words(rnd, 120) for _ in range(6)]
    lines = "\n".join(some_words(rnd, 8) for _ in range(20))
    near = base[0].split()
    near[60] = "changed"
    rows = [
        (1, base[0], "en", "a"), (2, base[0], "en", "a"), (3, " ".join(near), "en", None), (4, None, "en", "a"), (5, "", None, "b"),
        (6, base[1] + " " + base[2], "de", "b"), (7, base[3] + "\t" + base[2], "de", "b"), (8, "one two three", None, None),
        (9, "One TWO three", "en", "a"), (10, "  lone  ", "en", "a"), (11, lines, "en", "a"), (12, some_words(rnd, 9) + "\n" + lines, "en", "c"),
        (13, "same " * 90, "en", "a"), (14, base[4] + " " + base[4], "en", "a"), (15, some_words(rnd, 30_000), "en", "a"),
        (16, "x" * 50_000, "en", "a"), (17, " \n\n \t", "en", "a"), (18, base[5] + " ▁ é 😀", "fr", "c"), (18, base[5] + " ▁ é 😀", "fr", "c"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows + [(None, "no id at all", "en", "a", 12)], SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def odd_texts(odd):
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_exact_duplicates(odd, odd_texts, none):
    got = sorted_rows(exact_dedup.exact_duplicates(odd))
    want = sorted(brute.exact(odd_texts), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert got == want
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_digest_index_keeps_what_came_first(spark):
    index = exact_dedup.DigestIndex(spark, shared_folder(spark, "index"), 4)
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index.ingest(make([(1, "a"), (2, "b")])).collect()
    second = {r.doc_id: r for r in index.ingest(make([(3, "a"), (4, "c"), (5, "c")])).collect()}
    assert not second[3].kept and second[3].keep_id == 1
    assert second[5].kept and not second[4].kept and second[4].group_size == 2
    again = {r.doc_id: r for r in index.ingest(make([(5, "c")])).collect()}
    assert not again[5].kept and index.read().count() == 3
    # the files alone are the index, and they know their layout
    assert exact_dedup.DigestIndex(spark, index.path).read().count() == 3
    with pytest.raises(ValueError, match="4 buckets, not 8"):
        exact_dedup.DigestIndex(spark, index.path, 8)


def test_a_batch_may_run_again(spark):
    """A batch whose output was lost gets the same verdicts under its name, and loses no row."""
    index = exact_dedup.DigestIndex(spark, shared_folder(spark, "index"), 4)
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first, later = make([(1, "a"), (2, "b"), (3, "b")]), make([(9, "b"), (8, "c")])
    lost = sorted_rows(index.ingest(first, batch="monday"))
    again = sorted_rows(index.ingest(first, batch="monday"))
    assert again == lost and [r[3] for r in again] == [True, False, True]
    assert index.read().count() == 2
    tuesday = sorted_rows(index.ingest(later, batch="tuesday"))
    assert [r[:4] for r in tuesday] == [(8, 8, 1, True), (9, 3, 1, False)]
    # also after other batches have come
    assert sorted_rows(index.ingest(first, batch="monday")) == lost
    assert sorted_rows(exact_dedup.DigestIndex(spark, index.path).ingest(later, batch="tuesday")) == tuesday


def test_private_data(spark, odd, none):
    texts = [
        "mail a.b@c.d and x@y, e@f..g@h.i z@q.r.", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 999.1.2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112",
        "+1 (234) 555-0100 and +12 and +1234567890123456", "é😀 a@b.co +44 20 7946 0958.", "1" * 30_000, "1 " * 20_000, "a@b" + ".c" * 20_000,
        "a" * 100_000, "+" + "(" * 5_000, None, "", "4222222222222", "0" * 16, "a@b.c_d@e.f", "00001.2.3.004",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(1))
    model = pii.Model([], [], {})
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.base] for r in pii.find_spans(df, model).collect()}
    assert got == {k: brute.private(t) for k, t in enumerate(texts)}
    assert pii.find_spans(none).count() == 0
    assert pii.find_spans(odd, model).count() == odd.count()


def test_redaction(spark, odd):
    texts = ["mail é😀 a.b@c.d, or +1 (234) 555-0100!", "1.2.3.4", "4111 1111 1111 1111 and 4111.1111.1111.1111", "none", None, ""]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long").withColumn("row", F.lit("x"))
    got = pii.redacted(df, pii.Model([], [], {}))
    assert got.columns == df.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[k].text for k in range(6)] == [
        "mail é😀 [EMAIL], or [PHONE]!", "[IP]", "[CARD] and 4111.1111.1111.1111", "none", None, "",
    ]
    assert rows[1].n_chars == 4 and rows[4].n_chars is None


def test_long_lists_of_addresses(spark):
    """The work of a text grows with its spans: pairs of 30,000 would not end."""
    n = 30_000
    text = " ".join(f"user{k}@mail{k}.example.com, 4111-1111-1111-1111 4111-1111-1111-1111 22" for k in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    every = {k: 0.0 for k in range(len(pii.KINDS))}
    stump = pii.fit(spark.createDataFrame([(k, f"4111-1111-1111-1111 and 4111-1111-1111-{k:04d}") for k in range(200)], "doc_id long, text string"))
    model = pii.Model(stump.trees, stump.weights, every)
    got = pii.find_spans(df, model).select(F.size("base").alias("b"), F.size("spans").alias("s")).first()
    assert (got.b, got.s) == (n, 3 * n)


def test_sweep_against_a_loop(spark):
    rnd = random.Random(7)
    rows = []
    for k in range(60):
        spans = sorted({(a := rnd.randrange(600), rnd.randrange(4), a + rnd.randrange(1, 12), rnd.randrange(5) / 4) for _ in range(rnd.choice([0, 1, 300]))})
        rows.append((k, spans))
    df = spark.createDataFrame(rows, f"k int, v array<{pii.SCORED}>")
    for (_, spans), r in zip(rows, df.select("k", pii.sweep(F.col("v")).alias("s")).orderBy("k").collect()):
        kept = []
        for c in spans:
            rank = lambda x: (x[3], x[2] - x[0], -x[1])
            if not kept or c[0] >= kept[-1][2]:
                kept.append(c)
            elif rank(c) > rank(kept[-1]):
                kept[-1] = c
        assert [tuple(x) for x in r.s] == kept


def test_reaches_tell_which_kinds_a_candidate_meets(spark):
    rnd = random.Random(8)
    some = lambda: sorted({(a := rnd.randrange(900), rnd.randrange(4), a + rnd.randrange(1, 9)) for _ in range(rnd.choice([0, 3, 400]))})
    rows = [(k, some(), some()) for k in range(12)]
    spans = "array<struct<start:bigint,kind:int,end:bigint>>"
    df = spark.createDataFrame(rows, f"k int, b {spans}, c {spans}")
    for (_, base, loose), r in zip(rows, df.select("k", pii.reaches(F.col("b"), F.col("c")).alias("far")).orderBy("k").collect()):
        for c, far in zip(loose, r.far, strict=True):
            for kind in range(4):
                assert (far[kind] > c[0]) == any(b[1] == kind and b[0] < c[2] and c[0] < b[2] for b in base)


def test_thresholds_of_rare_kinds_follow_all(spark):
    top, low = pii.BINS - 10, 100
    got = pii.thresholds([(0, top, 500, 500), (0, low, 0, 500), (1, top, 1, 1), (2, top, 1, 10), (2, low, 0, 10)], 0.95)
    assert got[0] == got[1] == got[3] == (low + 1) / pii.BINS
    assert 2 not in got
    assert pii.thresholds([], 0.95) == {}


def test_private_model_chooses_among_valid_candidates(spark):
    """Numbers that pass the check are left alone where a word announces something else, others are found."""
    rnd = random.Random(9)

    def card():
        body = "4" + "".join(str(rnd.randrange(10)) for _ in range(14))
        return next(body + str(c) for c in range(10) if brute.luhn(body + str(c)))

    rows, want = [], {}
    for k in range(600):
        phone = lambda: f"{rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
        text = f"pay {card()} by visa, order {rnd.randrange(10**15, 10**16)} call +1 ({phone()} now, build 555-{rnd.randrange(200, 999)}-{rnd.randrange(1000, 9999)} out"
        if k % 30 == 0:
            want[k] = [card(), card()]
            text += " cards {} {} end".format(*want[k])
        rows.append((k, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    for r in pii.find_spans(df).collect():
        added = [texts[r.doc_id][s.start : s.end] for s in r.spans if s not in r.base]
        assert added == want.get(r.doc_id, [])


def test_private_model_adds_what_looks_alike(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(1500):
        phone = f"{rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
        text = f"words call +1 ({phone} then token {rnd.randrange(10**8)} and +{rnd.randrange(10**4, 10**6)} end"
        rows.append((k, text + (f" call +1 ({phone} 190.137.2.1" if k % 50 == 0 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df)
    assert pii.KINDS.index("phone") in model.thresholds
    out = {r.doc_id: r for r in pii.find_spans(df, model).collect()}
    texts = dict(rows)
    for k, r in out.items():
        base = [(s.start, s.kind, s.end) for s in r.base]
        spans = [(s.start, s.kind, s.end) for s in r.spans]
        assert set(base) <= set(spans) and base == brute.private(texts[k])
        # the format takes the address into the number; the trees part them
        added = [texts[k][a:b] for a, _, b in set(spans) - set(base)]
        assert all(t.startswith("+1 (") and len(t) == 17 for t in added)
        assert len(added) == (k % 50 == 0)


def test_prefix_sums(spark):
    values = [[], [3], list(range(700))]
    df = spark.createDataFrame([(v,) for v in values], "v array<bigint>")
    assert [r[0] for r in df.select(pii.prefix_sums(F.col("v"), 256)).collect()] == [np.cumsum(v).tolist() for v in values]


def shards_by_hand(rows, limit):
    keyed = {}
    for i, t in rows:
        h = hashlib.md5(f"{'' if i is None else i}:{hashlib.sha256((t or '').encode()).hexdigest()}".encode()).hexdigest()
        keyed.setdefault(bin(int(h, 16))[2:].zfill(128), []).append(len((t or "").encode()))
    out, stack = {}, [""]
    while stack:
        p = stack.pop()
        own = {k: v for k, v in keyed.items() if k.startswith(p)}
        if sum(map(sum, own.values())) <= limit or len(own) == 1:
            out[p] = sum(map(sum, own.values()))
        elif own:
            stack += [p + "0", p + "1"]
    return out


@pytest.mark.parametrize("limit", [1, 700, 5_000, 1 << 40])
def test_shards(odd, odd_texts, limit):
    rows = sharding.extendible_shards(odd, limit).collect()
    assert len(rows) == len(odd_texts)
    assert {r.shard: r.shard_bytes for r in rows} == {k: v for k, v in shards_by_hand(odd_texts, limit).items() if any(r.shard == k for r in rows)}
    for shard in {(r.shard, r.page) for r in rows}:
        held = [r for r in rows if (r.shard, r.page) == shard]
        assert sum(r.bytes for r in held) <= limit or len(held) == 1


def test_shards_of_many_copies_and_deep_splits(spark, none):
    rows = [(7, "copy " * 10)] * 60 + [(k, "t" * 20) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.extendible_shards(df, 100).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.shard, r.page] = sizes.get((r.shard, r.page), 0) + r.bytes
    assert max(sizes.values()) <= 100
    assert sharding.extendible_shards(none, 100).count() == 0


def test_substrings(odd, odd_texts, none):
    assert sorted_rows(substring_dedup.remove_repeats(odd)) == sorted(brute.substring(odd_texts), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substrings_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r) for r in substring_dedup.remove_repeats(documents(spark, SF)).collect()}
    assert got == {r[0]: r for r in brute.substring(rows)}


def test_substrings_of_an_id_with_several_texts(spark):
    rnd = random.Random(6)
    a, b = some_words(rnd, 60), some_words(rnd, 60)
    rows = [(1, a), (2, b), (3, a), (3, b + " " + a), (4, b), (4, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted_rows(substring_dedup.remove_repeats(df)) == sorted(brute.substring(rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_repeats_double_until_none_survives(odd, odd_texts):
    got = {(r.length, r.doc_id): r.windows for r in substring_dedup.longest_repeats(odd, 5).collect()}
    want, length = {}, 10
    while True:
        of = {}
        for i, t in odd_texts:
            w = brute.words(t)
            for s in range(len(w) - length + 1):
                of.setdefault(tuple(w[s : s + length]), set()).add(i)
        alive = {g: ids for g, ids in of.items() if len(ids) > 1}
        if not alive:
            break
        for ids in alive.values():
            for i in ids:
                want[length, i] = want.get((length, i), 0) + 1
        length *= 2
    assert got == want and length > 100


def test_windows_and_sliding():
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 1 << 63, 60).astype(np.uint64)
    for length in (1, 2, 3, 5, 10, 11, 20):
        w = hashing.windows(a, length)
        assert len(w) == 61 - length
        assert w[7] == hashing.windows(a[7 : 7 + length].copy(), length)[0]
        assert (hashing.sliding(a, length) == [a[k : k + length].min() for k in range(61 - length)]).all()
    assert len(hashing.windows(a[:3], 5)) == 0


def test_quality_counts_and_verdicts(spark, odd, odd_texts, none):
    got = {(r.doc_id, r.n_words): r for r in quality.judge(odd).collect()}
    for i, t in odd_texts:
        c = brute.counts(t)
        r = got[i, c[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (r.kept and r.base_failed)
    assert quality.judge(none).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r.kept for r in quality.judge(odd).collect())


def test_robust_estimates_ignore_a_third_of_junk(spark):
    rnd = random.Random(9)
    clean = [(k, some_words(rnd, rnd.randrange(60, 300)) + ".", "en", "s", 0) for k in range(400)]
    junk = [(1000 + k, " ".join(w.upper() + "#$%" for w in some_words(rnd, rnd.randrange(60, 300)).split()), "en", "s", 0) for k in range(200)]
    out = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(clean + junk, SCHEMA)).collect()}
    assert all(out[k] for k, *_ in clean) and not any(out[k] for k, *_ in junk)


def plain_half(x, d):
    """Estimate from the rows whose distance bin is among the nearest half's."""
    bins = np.floor(np.log1p(np.maximum(d, 0)) * 64)
    near = x[bins <= np.sort(bins)[-(-(len(x) + quality.DIMS + 1) // 2) - 1]]
    cov = np.cov(near.T, bias=True) * quality.CONSISTENCY + np.diag(np.square(list(quality.FLOORS.values())))
    return near.mean(0), cov, np.linalg.det(cov)


def plain_distance(x, mu, cov):
    return np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)


def plain_estimate(v):
    x = v / quality.UNIT
    low = lambda a: np.sort(a, 0)[(len(a) + 1) // 2 - 1]
    med = low(v)
    spread = np.maximum(low(np.abs(v - med)) * 1.4826 / quality.UNIT, list(quality.FLOORS.values()))
    z = np.abs(v - med) / quality.UNIT / spread
    found = []
    for d in ((z * z).sum(1), z.sum(1), z.max(1)):
        e = plain_half(x, d)
        for _ in range(quality.TRIALS):
            e = plain_half(x, plain_distance(x, *e[:2]))
        found.append(e)
    e = min(found, key=lambda e: e[2])
    while True:
        after = plain_half(x, plain_distance(x, *e[:2]))
        if not after[2] < e[2] * (1 - quality.MOVED):
            return e
        e = after


def test_concentration_step_equals_numpy(spark):
    rnd = np.random.default_rng(1)
    v = np.rint(rnd.normal(0, 1, (301, quality.DIMS)) * quality.UNIT).astype(int)
    rows = spark.createDataFrame([("g", x.tolist()) for x in v], "gid string, v array<bigint>")
    first = quality.starts(rows)
    step = {r.k: r for r in quality.concentrate(rows, first).collect()}
    assert len(step) == 3
    x = v / quality.UNIT
    for r in first.collect():
        cov = np.linalg.inv(np.array(r.inv).reshape(quality.DIMS, -1))
        mu, cov, det = plain_half(x, plain_distance(x, np.array(r.mu), cov))
        assert np.allclose(step[r.k].mu, mu) and np.allclose(np.array(step[r.k].inv).reshape(quality.DIMS, -1), np.linalg.inv(cov))
        assert np.isclose(step[r.k].det, det)


def test_estimates_of_mixed_groups_equal_numpy(spark):
    """Several groups, some with a large share of outliers, each to the end of its own steps."""
    rnd = np.random.default_rng(4)
    groups = {}
    for g, (n, bad) in enumerate([(30, 0), (45, 20), (200, 90), (400, 10), (37, 37)]):
        turn = rnd.normal(0, 1, (quality.DIMS, quality.DIMS))
        v = rnd.normal(0, 1, (n, quality.DIMS)) @ turn
        v[:bad] = v[:bad] * 0.3 + 6
        groups[f"g{g}"] = np.rint(v * quality.UNIT).astype(int)
    rows = spark.createDataFrame([(g, x.tolist()) for g, v in groups.items() for x in v], "gid string, v array<bigint>")
    got = {r.gid: r for r in quality.estimates(rows).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        mu, cov, det = plain_estimate(v)
        assert np.isclose(got[g].det, det) and np.allclose(got[g].mu, mu)


def test_kept_equals_a_plain_version(spark):
    """Every language and source with enough documents has an estimate of its own, and it decides."""
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stats = [(r.row.doc_id, r.lang, r.source, r.base_failed, r.v) for r in quality.statistics(docs).collect()]
    groups, cut = {}, quality.chi2_quantile(1 - 1e-6, quality.DIMS)
    for i, lang, source, failed, v in stats:
        if not failed:
            groups.setdefault((lang, source), []).append(v)
    small = {k for k, v in groups.items() if len(v) < quality.LEAST_GROUP}
    pooled = {}
    for k in small:
        pooled.setdefault(k[0], []).extend(groups[k])
    own = {k: plain_estimate(np.array(v)) for k, v in groups.items() if k not in small}
    of_lang = {k: plain_estimate(np.array(v)) for k, v in pooled.items() if len(v) >= quality.LEAST_GROUP}
    assert len(own) >= 5 and len(of_lang) == 4
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, lang, source, failed, v in stats:
        e = own.get((lang, source)) or of_lang[lang]
        d2 = plain_distance(np.array([v]) / quality.UNIT, *e[:2])[0]
        assert np.isclose(got[i].distance, d2) and got[i].kept == (not failed and d2 <= cut)


def test_chi_square_quantiles():
    assert abs(quality.chi2_quantile(0.95, 6) - 12.5916) < 1e-3 and abs(quality.chi2_quantile(0.5, 6) - 5.3481) < 1e-3


def unique_ids(df):
    return df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])


@pytest.mark.parametrize("small", [False, True])
def test_ngram_classes(spark, odd, none, monkeypatch, small):
    if small:  # blocks and very large cells on a few rows
        monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 2)
        monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 300)
    rows = [(r.doc_id, r.text) for r in unique_ids(odd).select("doc_id", "text").collect()]
    rnd = random.Random(2)
    seed = some_words(rnd, 200).split()
    more = []
    for k in range(30):  # a chain: each differs a little from the one before
        seed[rnd.randrange(200)] = f"new{k}"
        more.append((100 + k, " ".join(seed)))
    df = unique_ids(odd).select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_classes(df, hot_members=3 if small else 20_000).collect()}
    assert got == brute.classes(rows + more)
    assert ngram_join.similar_classes(none).count() == 0


def test_ngram_nulls_and_repeats(odd):
    got = ngram_join.similar_classes(odd).collect()
    assert len(got) == odd.count()
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = ngram_join.one_per_class(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.where("doc_id = 18 or doc_id < 4").collect()) == [1, 18]


def test_ngram_rows_that_share_an_id(spark):
    rnd = random.Random(31)
    texts = [some_words(rnd, 120) for _ in range(12)]
    near = [" ".join([*t.split()[:60], f"changed{k}", *t.split()[61:]]) for k, t in enumerate(texts)]
    rows = [(None, t) for t in texts[:6]] + [(7, t) for t in texts[6:]]  # different texts under one id or none
    rows += [(20 + k, t) for k, t in enumerate(near[:9])] + [(7, near[9]), (None, near[10]), (None, near[10])]
    rows += [(None, ""), (None, None), (7, " \n"), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", F.lit("clash")).repartition(4)
    low = -1  # below all ids
    want = brute.classes(list(enumerate(t for _, t in rows)))
    label = {}
    for k, (_, c) in want.items():
        label[c] = min(label.get(c, 10**9), low if rows[k][0] is None else rows[k][0])
    expected = sorted(str((rows[k][0], n, None if label[c] == low else label[c])) for k, (n, c) in want.items())
    for _ in range(2):
        got = ngram_join.similar_classes(df.repartition(3))
        assert sorted(str(tuple(r)) for r in got.collect()) == expected
    kept = ngram_join.one_per_class(df)
    assert kept.columns == df.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(left) == len(label) and len([t for _, t in left if not (t or "").strip()]) == 4
    place = {t: k for k, (_, t) in enumerate(rows)}
    classes = [want[place[t]][1] for _, t in left if (t or "").strip()]
    assert len(set(classes)) == len(classes) == 12
    assert all((low if i is None else i) == label[want[place[t]][1]] for i, t in left if (t or "").strip())


def test_tree_finds_all_classes():
    rnd = random.Random(4)
    for percent in (60, 85):
        sets = []
        for k in range(120):
            base = set(rnd.sample(range(300), 40)) if k % 4 == 0 or not sets else set(rnd.choice(sets))
            for _ in range(rnd.randrange(6)):
                base.discard(rnd.choice(sorted(base)))
                base.add(rnd.randrange(300))
            sets.append(base)
        tree = ngram_join.Tree(percent)
        for s in sets:
            tree.add(sorted(s))
        root = list(range(120))
        for a in range(120):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = root[a], root[b]
                    root = [min(x, y) if r in (x, y) else r for r in root]
        assert [tree.find(k) for k in range(120)] == root


def test_signatures_fold():
    tokens = np.random.default_rng(0).integers(0, 1 << 62, 3000).astype(np.uint64)
    sig = ngram_join.signature(tokens).view(np.uint64)
    assert len(sig) == 64
    odd = np.bincount((tokens % np.uint64(512)).astype(int), minlength=512) & 1
    assert (ngram_join.folded(sig, 8) == np.packbits(odd.astype(np.uint8)).view(np.uint64)).all()


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(300 + k, 301 + k) for k in range(70)]
    root = {x: x for e in links for x in e}
    for a, b in links:
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = {r.u: r.v for r in graph.roots(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


def test_sentencepiece_equals_the_library(odd, odd_texts, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    key = lambda r: (r[0] is None, r[0], str(r[1]))
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in sentencepiece_codec.encode_decode(odd, MODEL).collect()), key=key)
    assert got == sorted(((i, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in odd_texts), key=key)
    assert sentencepiece_codec.encode_decode(none, MODEL).count() == 0
    table, rnd = sentencepiece_codec.ChunkTable(sp, 50), random.Random(0)
    assert table.by_chunk
    bits = [" ", "  ", "▁", "a", "the", "\n", "\t", "é", "😀", "\x00", "　", " ", "##", "<s>", "​", "ﬁ", "\r\n"]
    for _ in range(5_000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(10)))
        assert table.encode(text) == sp.encode(text)


def test_mixing(odd, odd_texts, none):
    taken = mixing.taken_words(odd).collect()
    assert len(taken) == len(odd_texts)
    assert all(0 <= r.taken <= 2 * r["size"] for r in taken)
    assert sorted_rows(mixing.taken_words(odd)) == sorted_rows(mixing.taken_words(odd.repartition(5)))
    assert mixing.taken_words(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert mixed.agg(F.sum(n_words(F.col("text")))).first()[0] == sum(r.taken for r in taken)


def test_mix_targets(spark):
    rows = [("a", 100), ("b", 1000), ("c", 0), (None, 1000), ("d", 3000)]
    df = spark.createDataFrame(rows, "source string, size long")
    got = {r.source: r for r in mixing.source_targets(df).collect()}
    weights = {"a": 5.0, "b": 2.0, "c": 1.0, "d": 5.0, None: 2.0}
    target, left, open_ = {}, 1.5 * 5100, dict(weights)
    while True:  # the excess of full sources goes to the others
        level = left / sum(open_.values())
        full = [s for s in open_ if 2 * dict(rows)[s] < level * weights[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * dict(rows)[s]
            left -= target[s]
            del open_[s]
    target |= {s: level * w for s, w in open_.items()}
    assert {s: r.weight for s, r in got.items()} == weights
    assert all(abs(got[s].target - t) < 1e-6 for s, t in target.items())


def test_mix_reaches_targets(spark):
    rows = [(r.doc_id, r.source, r["size"], r.target, r.taken) for r in mixing_rows(spark)]
    by = {}
    for _, s, _, target, taken in rows:
        by.setdefault(s, [target, 0])[1] += taken
    assert all(abs(t - n) <= 0.02 * t + 50 for t, n in by.values())


def test_mix_takes_small_sources(spark):
    """Sources of less than a block up to a few hundred blocks of 256 words beside a large one."""
    sizes = {f"s{k:02}": n for k, n in enumerate([3, 7, 20, 31, 90, 250, 256, 600, 1_000, 2_500, 6_000, 14_000, 30_000])} | {"large": 400_000}
    rows = []
    for s, n in sizes.items():
        step = max(1, n // 40)
        rows += [(len(rows) + k, " ".join(f"w{j}" for j in range(min(step, n - a))), "en", s, 1) for k, a in enumerate(range(0, n, step))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    taken = mixing.taken_words(docs, block_words=256).join(docs.select("doc_id", "source"), "doc_id")
    got = {r.source: (r.target, r.taken) for r in taken.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert set(got) == set(sizes)
    for s, (target, n) in got.items():
        assert abs(target - n) <= 0.02 * target + 1, (s, target, n)
    mixed = mixing.mixed_documents(docs, block_words=256)
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("n")).collect()}
    assert words == {s: n for s, (_, n) in got.items()}


def test_running_total_in_levels(spark, odd, monkeypatch):
    """More chunks than fit one window: totals of totals, twice over."""
    rows = [(k % 3, k * 7 % 101, k % 5 + 1) for k in range(2_000)]
    df = spark.createDataFrame([(g, v // 3, v, n, i) for i, (g, v, n) in enumerate(rows)], "g long, chunk long, v long, n long, i long")
    ahead, want = {}, {}
    for i, (g, v, n) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        want[i], ahead[g] = ahead.get(g, 0), ahead.get(g, 0) + n
    whole = sorted_rows(mixing.taken_words(odd))
    monkeypatch.setattr(mixing, "FAN", 4)
    got = mixing.running_total(df, "g", "chunk", 34, ["v", "i"], F.col("n"), "at")
    assert got.columns == [*df.columns, "at"]
    assert {r.i: r["at"] for r in got.collect()} == want
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 2)
    assert sorted_rows(mixing.taken_words(odd)) == whole


def mixing_rows(spark):
    docs = documents(spark, SF)
    taken = mixing.taken_words(docs)
    return taken.join(docs.select("doc_id", "source"), "doc_id").collect()


def test_lines(odd, odd_texts, none):
    got = sorted(((r.row.doc_id, r.kept) for r in line_dedup.dedup_lines(odd).collect()), key=str)
    seen, want = {}, []
    order = sorted(odd_texts, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        out, mine = [], set()
        for n, has_word, body in line_dedup.chunks(t):
            if n >= 2 and has_word:
                if body in mine or seen.setdefault(body, i) != i:
                    continue
                mine.add(body)
            out.append(body)
        want.append((i, b"\n".join(out).decode()))
    assert got == sorted(want, key=str)
    assert line_dedup.dedup_lines(none).count() == 0
    left = line_dedup.without_repeated_lines(odd)
    assert left.columns == odd.columns and {r.n_chars for r in left.where("doc_id = 12").collect()} != {None}


def test_every_repeated_run_of_lines_goes(spark, odd, odd_texts, none):
    rnd = random.Random(12)
    passage = [[some_words(rnd, 6) for _ in range(n)] for n in range(2, 9) for _ in range(6)]
    rows, k = [], 100
    for p in passage:  # planted in random surroundings, twice in other documents and in one of three twice in one
        for times in (1, 1 + (k % 3 == 0)):
            parts = [some_words(rnd, 6) for _ in range(3)]
            for _ in range(times):
                parts += [*p, some_words(rnd, 5), ""]
            rows.append((k, "\n".join(parts)))
            k += 1
    rows += [(k, "a\na\na"), (k + 1, "b b\nb b\nb b\nb b\nc"), (k + 2, "d\n\ne"), (k + 3, "x\n\ne\nd\n\n\nf"), (k + 4, "\n \n\n"), (k + 5, "\n \n\n")]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    df = odd.select("doc_id", "text").unionByName(more).repartition(3)
    key = lambda r: str(r)
    got = sorted(((r.row.doc_id, r.n_lines, r.n_removed, r.kept) for r in line_dedup.dedup_runs(df).collect()), key=key)
    assert got == sorted(brute.line_runs(odd_texts + rows), key=key)
    kept = {r[0]: r[3].split("\n") for r in got if r[0] is not None}
    assert not any(line in kept[101 + 2 * n] for n, p in enumerate(passage) for line in p)
    assert line_dedup.dedup_runs(none).count() == 0
    # rows without an id are held against each other too
    twice = [(None, "p q\nr s\nt u"), (None, "v w\nr s\nt u")]
    left = line_dedup.dedup_runs(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert sum(r.n_removed for r in left) == 2
    assert QUERIES["op9_line_dedup"](spark, SF).agg(F.sum("n_removed")).first()[0] > line_dedup.dedup_lines(documents(spark, SF)).agg(F.sum("n_removed")).first()[0]


def test_chunks_go_first_and_windows_add_the_ends(spark):
    rnd = random.Random(5)
    line = lambda: some_words(rnd, 6)
    passage = [line() for _ in range(40)]
    rows = [(k, "\n".join([*(line() for _ in range(5)), *passage, *(line() for _ in range(4))])) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = {r.d: len(r.gone) for r in line_dedup.repeated_chunks(df).collect()}
    # every later copy loses the same chunks of the passage; at its ends lines remain that only windows reach
    assert set(chunks) == {1, 2, 3, 4, 5} and len(set(chunks.values())) == 1 and chunks[1] >= 3
    coarse = {r.row.doc_id: r.n_removed for r in line_dedup.dedup_lines(df).collect()}
    got = {r.row.doc_id: (r.n_lines, r.n_removed, r.kept) for r in line_dedup.dedup_runs(df).collect()}
    assert got == {r[0]: r[1:] for r in brute.line_runs(rows)}
    assert all(0 < coarse[k] < got[k][1] == 40 for k in range(1, 6)) and got[0][1] == 0
    # of a passage the later copies look at its ends only
    whole = line_dedup._window_rows(line_dedup._texts(df)).where("c IS NOT NULL").groupBy("d").count().collect()
    assert all(r["count"] > 10 for r in whole)


def test_line_chunks_resist_shifts():
    rnd = random.Random(8)
    body = [some_words(rnd, 5).encode() for _ in range(200)]
    a = {c for _, _, c in line_dedup.chunks(b"\n".join(body).decode())}
    b = {c for _, _, c in line_dedup.chunks(b"\n".join([b"new first line", *body]).decode())}
    assert len(a & b) >= len(a) - 2
    text = "\n\na\nb\n\n"
    assert b"\n".join(c for _, _, c in line_dedup.chunks(text)).decode() == text


def pages(spark):
    rows = [
        (1, "http://a/é b\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 300_000),
        (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (None, "u", "<p>é</p>"),
    ]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = min(i for i, _, h in rows if i is not None and (h or "").encode() == data)
        mine = [r for r in got if r.page_id == page_id and r.payload_bytes == len(data)]
        for r in mine:
            assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            assert (r.record_type, r.refers_to) == (("response", None) if page_id == first else ("revisit", first))
            assert r.payload is None or bytes(r.payload) == data
        assert mine
    large = [r for r in warc.round_trip(df, least_bytes=100).collect()]
    assert {r.record_type for r in large} == {"response"}
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_reader_tells_damage():
    ok = warc.record(1, "u", b"payload", None, False, "2024-01-01T00:00:00Z")
    two = ok + warc.record(2, "u", b"other", None, False, "2024-01-01T00:00:00Z")
    assert [r[0] for r in warc.read_records(io.BytesIO(two))] == [1, 2]
    assert [r[7] is None for r in warc.read_records(io.BytesIO(two[:-5]))] == [True, False]
    plain = zlib.decompress(ok, 31)
    again = lambda data: (lambda c: c.compress(data) + c.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    changed = [r for r in warc.read_records(io.BytesIO(again(plain.replace(b"payload\r\n", b"Payload\r\n"))))]
    assert "digest" in changed[0][7]
    longer = [r for r in warc.read_records(io.BytesIO(again(plain + b"x")))]
    assert longer[0][2] == "damaged"


def test_warc_strict_reader_raises(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(b"not gzip")
    paths = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)], "path string")
    assert warc.read_warc(spark, paths, strict=False).first().record_type == "damaged"
    with pytest.raises(Exception, match="x.warc.gz"):
        warc.read_warc(spark, paths).collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) == []


def test_pipeline_stages(spark, odd, none):
    for docs in (odd, none):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == columns
        docs.collect()


def test_pipeline_on_the_table(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = documents(spark, SF)
    good = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    quality_out = corpus_pipeline.quality_stage(spark, docs, SF)
    assert {r.doc_id for r in quality_out.collect()} == good
    lines = corpus_pipeline.line_stage(spark, quality_out, SF)
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    near = corpus_pipeline.near_stage(spark, lines, SF)
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, c in brute.classes(rows).values()})
    mixed = corpus_pipeline.mix_stage(spark, near, SF)
    texts = sorted(r.text for r in mixed.collect())
    out = corpus_pipeline.encode_stage(spark, mixed, SF)
    assert sorted(map(str, (r.ids for r in out.collect()))) == sorted(str(sp.encode(t)) for t in texts)


def test_pipeline_near_stage_takes_five_words_at_80(spark):
    rnd = random.Random(21)
    seed = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    rows = [(1, " ".join(seed))]
    for k, (edits, gap) in enumerate([(5, 60), (6, 50), (7, 40), (9, 30)]):  # scattered
        mine = list(seed)
        for e in range(edits):
            mine[7 + e * gap] = f"new{k}x{e}"
        rows.append((10 + k, " ".join(mine)))
    for k, length in enumerate((20, 26, 34)):  # in one place
        other = [f"v{k}x{rnd.randrange(10**6)}" for _ in range(300)]
        rows.append((20 + 2 * k, " ".join(other)))
        rows.append((21 + 2 * k, " ".join(other[:100] + [f"z{k}x{j}" for j in range(length)] + other[100 + length :])))
    full = [(i, t, "en", "a", len(t)) for i, t in rows]
    near = corpus_pipeline.near_stage(spark, spark.createDataFrame(full, SCHEMA), SF)
    want = {c for _, c in brute.classes(rows, percent=80, n=5).values()}
    assert want != {c for _, c in brute.classes(rows).values()}
    assert sorted(r.doc_id for r in near.collect()) == sorted(want)
    lines = corpus_pipeline.line_stage(spark, documents(spark, SF), SF)
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    near = corpus_pipeline.near_stage(spark, lines, SF)
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, c in brute.classes(rows, percent=80, n=5).values()})
