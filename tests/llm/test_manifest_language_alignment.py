import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from check import compare, duck
from rasterloom.llm import language_id, merkle, token_alignment
from rasterloom.llm.registry import ORACLES, QUERIES
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like those the operators work with.
CLASHING = ["leaf", "idx", "n", "tree", "run", "part", "level", "hashes", "held_out", "lang_pred", "score", "pair", "block", "times", "key", "n_a"]
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def some_words(rnd, n):
    return " ".join(rnd.choice(["Alpha", "beta", "gamma", "delta", "Eps", "zeta"]) + str(rnd.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    texts = [
        None, "", " ", "  ", "a", "A  b\n\nC", "same text", "same text", "\n", "x\ny z", "tab\there", "▁ marker", "it's 'so' “quoted” é ñ 😀 ﬁ",
        "<|endoftext|> <s> <0x41> <unk>", "日本語 の 文", "é combining", "a b c 　d", "\x00\x01 control", "1234 5678  90", " lead", "trail ", "a\r\nb",
        some_words(rnd, 20_000), "y" * 30_000,
    ]
    out = [(i, t, ["en", "de", None][i % 3], "b", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(100 + i, some_words(rnd, 5) + f"\nLine{i}\nnext", "en", "a", i) for i in range(300)]
    out += [(500, "alone", "fr", "lone", 5), (501, "no source", None, None, 9), (501, "no source", None, None, 9), (501, "No Source", None, None, 9)]
    return out + [(None, "No id", "en", "b", 5), (None, "No id either", "en", "b", 5), (600 + (1 << 40), "far", "en", "ä", 1), (5, "MINUS", "en", "Z", -7)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("clash") for c in CLASHING})


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_merkle(rows, tampered):
    def leaf(i, t, lang, source, n):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)])

    def lower(t):
        return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def build(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][s : s + 16]) for s in range(0, len(out[-1]), 16)])
        return out

    def climb(tree, at, digest):
        others = []
        for level in tree[:-1]:
            run = level[at // 16 * 16 : at // 16 * 16 + 16]
            others += run[: at % 16] + run[at % 16 + 1 :]
            run[at % 16] = digest
            digest, at = h(*run), at // 16
        return others, digest

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((leaf(*r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    low = {}
    for s in names:
        groups[s].sort(key=lambda e: (e[1][0] is not None, e[1][0] or 0, e[0]))
        low[s] = build([e[0] for e in groups[s]])
    top = build([low[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, (digest, r) in enumerate(groups[s]):
            start = leaf(r[0], lower(r[1]), *r[2:]) if tampered(r[0]) else digest
            first, folded = climb(low[s], at, start)
            second, folded = climb(top, k, folded)
            root = top[-1][0]
            out.append((r[0], digest, low[s][-1][0], root, h(*first, *second), folded, folded == root))
    return out


def by_text(found):
    return sorted(map(tuple, found), key=str)


def changed(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def verify(df):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.verify(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower)


def test_merkle_against_plain_trees(docs, rows):
    got = by_text(verify(docs).collect())
    assert got == by_text(brute_merkle(rows, changed))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("kept", ["source = 'lone'", "source = 'a'", "source in ('a', 'lone')", "source = 'b' and doc_id < 16"])
def test_merkle_of_few_sources_and_rows(docs, rows, spark, kept):
    small = docs.where(kept)
    want = [tuple(r) for r in small.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert by_text(verify(small).collect()) == by_text(brute_merkle(want, changed))


def test_merkle_of_nothing(docs):
    assert verify(docs.where("false")).count() == 0


def test_merkle_query_equals_its_sql(spark):
    assert compare(QUERIES["op11_merkle_manifest"](spark, SF), duck(SF), ORACLES["op11_merkle_manifest"]) == []


# language identification


def brute_grams(text, n=3):
    text = re.sub(r"[\W\d_]+", " ", " " + (text or "").lower() + " ")
    return Counter(text[i : i + n] for i in range(len(text) - n + 1)) if text.strip() else Counter()


def brute_vector(gram, size):
    out = np.ones(size)
    for turn, letter in enumerate(reversed(gram)):
        out *= np.roll(language_id.letter_vector(ord(letter), size), turn)
    return out


def brute_bundle(counts, size):
    return sum((n * brute_vector(g, size) for g, n in counts.items()), np.zeros(size))


def test_languages_against_plain_vectors(spark):
    size = 256
    known = [("a", "the cat sat on the mat the end"), ("a", "this and that"), ("b", "der hund und die katze"), ("b", "das ist ein haus"), ("c", "ñandú él está aquí")]
    asked = ["the hat", "die maus", "él", "x", "ÜBER", "", None, "12 34 --", "THE\nEND", "the " * 3000 + "der " * 10]
    learned = spark.createDataFrame(known + [(None, "not learned from"), ("d", None), ("e", "123")], "lang string, text string")
    profiles = language_id.learn(learned, size)
    texts = defaultdict(Counter)
    for lang, t in known:
        texts[lang].update(brute_grams(t))
    vectors = {lang: brute_bundle(c, size) for lang, c in texts.items()}
    assert {r.lang: r.vector for r in profiles.collect()} == {lang: v.tolist() for lang, v in vectors.items()}
    df = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in language_id.predict(df, profiles, size).collect()}
    for i, t in enumerate(asked):
        counts = brute_grams(t)
        if not counts:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        v = brute_bundle(counts, size)
        cosines = {lang: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for lang, p in vectors.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert got[i].lang_pred == best and got[i].score == pytest.approx(min(1, max(0, cosines[best])))


def test_prototypes_in_blocks(spark, monkeypatch):
    rnd = random.Random(1)
    known = [(f"l{i:02d}", "".join(rnd.choice(f"{chr(97 + i)}{chr(98 + i)} ") for _ in range(200))) for i in range(12)]
    learned = spark.createDataFrame(known, "lang string, text string")
    profiles = language_id.learn(learned, 512)
    whole = language_id.predict(learned.withColumnRenamed("lang", "truth"), profiles, 512).collect()
    monkeypatch.setattr(language_id, "PROTOTYPES", 5)
    parts = language_id.predict(learned.withColumnRenamed("lang", "truth"), profiles, 512).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))
    assert all(r.truth == r.lang_pred for r in whole)


def test_language_edges(docs, rows):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    found = language_id.identify(docs.withColumn("lang", F.when(F.col("lang") == "en", "en").when(F.col("lang") == "de", "de")), held).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in found} <= {"en", "de", "und"}
    assert language_id.identify(docs.where("false"), held).count() == 0
    unlearned = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), held).collect()
    assert {(r.lang_pred, r.score) for r in unlearned} == {("und", 0.0)}


def test_languages_of_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op12_language_id"](spark, sf).join(truth, "doc_id").where("held_out").collect()
    assert len(found) > 250
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)


# alignment


def brute_alignment(rows):
    a_model = tokenizers.Tokenizer.from_file(PATHS[0])
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = token_alignment.byte_letters()

    def b_bytes(i):
        p = b_model.id_to_piece(i)
        return bytes.fromhex(p[3:5]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()

    def spans(tokens):
        out, at = [], 0
        for i, x in tokens:
            out.append((at, at + len(x), i))
            at += len(x)
        return out

    docs, totals = [], Counter()
    for i, text in rows:
        whole = (" " + (text or "")).encode()
        a = [(t, bytes(letters[c] for c in a_model.id_to_token(t))) for t in a_model.encode(whole.decode(), add_special_tokens=False).ids]
        b = [(t, b_bytes(t)) for t in b_model.encode(text or "")]
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append((i, [], [], [], []))
            continue
        a, b = spans(a), spans(b)
        common = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        links, k = [], 0
        for s, e, t in a:
            while b[k][1] <= s:
                k += 1
            m = k
            while m < len(b) and b[m][0] < e:
                links.append((t, b[m][2]))
                m += 1
        groups = [[[], []] for _ in common]
        for side, tokens in enumerate((a, b)):
            g = 0
            for _, e, t in tokens:
                groups[g][side].append(str(t))
                g += e == common[g]
        totals.update(links)
        docs.append((i, a, b, links, [",".join(x) + "|" + ",".join(y) for x, y in groups]))
    best = Counter()
    for (_, t), n in totals.items():
        best[t] = max(best[t], n)
    return [
        (i, len(a), len(b), len(g), len(links), sum(totals[p] == best[p[1]] for p in links), sum(totals[p] for p in links), h(";".join(g)) if g else "")
        for i, a, b, links, g in docs
    ]


def test_alignment_against_whole_texts(spark, docs, rows):
    got = token_alignment.align(docs, *PATHS)
    assert got.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert by_text(got.collect()) == by_text(brute_alignment([r[:2] for r in rows]))
    assert token_alignment.align(docs.where("false"), *PATHS).count() == 0


def test_alignment_in_small_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 2000)
    assert by_text(token_alignment.align(docs, *PATHS).collect()) == by_text(brute_alignment([r[:2] for r in rows]))


def test_alignment_of_random_strings():
    rnd = random.Random(9)
    letters = ["a", "B", "é", "ß", " ", " ", "  ", "\n", "\n", "\t", "\r", "'s", "▁", "1", "23", ".", "?!", " ", " ", "😀", "中", "ñ", "́", " ", "​", "ﬁ", "<", "s>", "||"]
    coder = token_alignment.Coder(*PATHS)
    assert coder.by_chunk
    for _ in range(4000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 14)))
        parts = coder.encode(coder.chunks(text))
        assert parts[0].flatten().to_pylist() == coder.a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert parts[1].flatten().to_pylist() == coder.b.encode(text), repr(text)


def test_alignment_query_equals_whole_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert by_text(QUERIES["op13_token_alignment"](spark, SF).collect()) == by_text(brute_alignment(rows))
