"""Registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.llm import (
    exact_dedup, language_id, line_dedup, merkle, mixing, ngram_join, pii, quality, sentencepiece_codec, sharding, substring_dedup, token_alignment, warc,
)
from rasterloom.llm.shared import documents, query

#: Bytes of text in one shard: small enough that shards of a few texts stand beside those of a single long one.
SHARD_BYTES = 64 << 10


@query(
    "op1_exact_dedup",
    """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(documents(spark, sf_dir))

    def number(i: int):
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    return found.select(
        "doc_id",
        *[number(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)],
        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
        pii.spans_text(F.col("spans")).alias("spans"),
    )


SHARD_SQL = f"""
WITH RECURSIVE doc AS MATERIALIZED (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes,
         md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), sha256(coalesce(text, '')))) AS h
  FROM documents),
bit AS MATERIALIZED (
  SELECT doc_id, bytes, string_agg(right(bin(('0x' || substr(h, i, 1))::INTEGER + 16), 4), '' ORDER BY i) AS bits
  FROM doc, range(1, 17) t(i) GROUP BY doc_id, bytes, h),
tree AS (
  SELECT '' AS node, 0 AS depth, sum(bytes) AS total, count(*) AS n FROM bit HAVING count(*) > 0
  UNION ALL
  SELECT b.node, b.depth, b.total, b.n FROM (
    SELECT left(bit.bits, t.depth + 1) AS node, t.depth + 1 AS depth, sum(bit.bytes) AS total, count(*) AS n
    FROM tree t JOIN bit ON left(bit.bits, t.depth) = t.node
    WHERE t.total > {SHARD_BYTES} AND t.n > 1 GROUP BY ALL) b)
SELECT b.doc_id, t.node AS shard, CAST(0 AS BIGINT) AS page, CAST(t.depth AS INTEGER) AS depth, b.bytes,
       CAST(t.total AS BIGINT) AS shard_bytes
FROM bit b JOIN tree t ON left(b.bits, t.depth) = t.node AND (t.total <= {SHARD_BYTES} OR t.n = 1)"""


@query("op3_extendible_shards", SHARD_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(documents(spark, sf_dir), SHARD_BYTES)


WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

SUBSTRING_SQL = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS g FROM w, unnest(range(1, len(ws) - 18)) t(s) WHERE len(ws) >= 20),
rep AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + o.range AS p FROM rep CROSS JOIN range(20) o),
one AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


@query("op4_substring_dedup", SUBSTRING_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


CLASS_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, {WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[s:s + 3], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) t(s) WHERE len(ws) > 0),
sz AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT u, v FROM pair JOIN sz x ON x.doc_id = u JOIN sz y ON y.doc_id = v WHERE 100 * pair.n >= 85 * (x.n + y.n - pair.n)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v)
SELECT u AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(v) AS component_id FROM reach LEFT JOIN sz ON doc_id = u GROUP BY u"""


@query("op6_ngram_jaccard", CLASS_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(documents(spark, sf_dir))


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encode_decode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


MIX_SQL = """
WITH RECURSIVE doc AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), '0')), 1, 15))::BIGINT AS row_key
  FROM documents),
src AS MATERIALIZED (
  SELECT source, source_size, rank, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS w, 2.0 * source_size::DOUBLE AS cap
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM doc GROUP BY source)),
share AS (
  SELECT 0 AS step, (SELECT sum(source_size) FROM src) * 1.5 / (SELECT sum(w) FROM src) AS level
  UNION ALL
  SELECT step + 1, ((SELECT sum(source_size) FROM src) * 1.5
                    - (SELECT coalesce(sum(cap), 0) FROM src WHERE cap < level * w))
                   / (SELECT sum(w) FROM src WHERE cap >= level * w)
  FROM share WHERE step < (SELECT count(*) FROM src)
    AND EXISTS (SELECT 1 FROM src WHERE cap < level * w)),
tgt AS MATERIALIZED (
  SELECT src.*, least(cap, (SELECT max(level) FROM share) * w) AS target FROM src),
p AS (SELECT CAST(floor(sum(source_size) * 1.5) AS BIGINT) AS total,
             greatest(1, least(4096, CAST(floor(sum(source_size) * 1.5) AS BIGINT) // 131072)) AS b FROM src),
lim AS (
  SELECT rank, lo, coalesce(lead(lo) OVER (ORDER BY rank), 4294967296) AS hi FROM (
    SELECT rank, target, CAST(floor(coalesce(sum(target) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                        / sum(target) OVER () * 4294967296) AS BIGINT) AS lo FROM tgt) WHERE target > 0),
slot AS (SELECT n, n % 2147483648 * 2654435769 % 4294967296 AS u FROM p, range(0, (total + b - 1) // b) t(n)),
run AS (SELECT rank, count(*) AS slots FROM slot JOIN lim ON u >= lo AND u < hi GROUP BY rank),
placed AS (
  SELECT doc.*, tgt.rank, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY tgt.rank ORDER BY row_key, doc_id NULLS LAST, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM doc JOIN tgt ON doc.source IS NOT DISTINCT FROM tgt.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, coalesce(slots, 0) * b - start))
            + greatest(0, least(size, coalesce(slots, 0) * b - source_size - start)) AS BIGINT) AS taken
FROM placed CROSS JOIN p LEFT JOIN run USING (rank)"""


@query("op8_mix_sources", MIX_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir))


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_runs(documents(spark, sf_dir))
    return left.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


WARC_SQL = """
WITH p AS MATERIALIZED (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""


@query("op10_warc", WARC_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(field_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: Node rows hold a run's digests; trees are sources by their order, the tree over them is -1.
MERKLE_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, s, i + 1, list_reduce([xor(c, CASE WHEN i % 9 = 0 THEN ord(s[i // 9 + 1]) ELSE 0 END), 0],
    lambda x, y: CASE WHEN i % 9 = 0 THEN x WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) FROM crc WHERE i < 9 * length(s)),
changed AS MATERIALIZED (SELECT doc_id FROM crc WHERE i = 9 * length(s) AND xor(c, 4294967295) % 5 = 0),
doc AS MATERIALIZED (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {leaf_sql("text")} AS leaf,
         CASE WHEN doc_id IN (SELECT doc_id FROM changed)
              THEN {leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf_sql("text")} END AS proved
  FROM documents),
leafy AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM doc),
low AS (
  SELECT tree, 0 AS level, idx, n, leaf AS h, '' AS run FROM leafy
  UNION ALL
  SELECT tree, level + 1, idx // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)), string_agg(h, '' ORDER BY idx)
  FROM low WHERE n > 1 GROUP BY tree, level, idx // 16),
sub AS MATERIALIZED (SELECT tree AS idx, h, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT -1 AS tree, 0 AS level, idx, n, h, '' AS run FROM sub
  UNION ALL
  SELECT tree, level + 1, idx // 16, (any_value(n) + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)), string_agg(h, '' ORDER BY idx)
  FROM high WHERE n > 1 GROUP BY tree, level, idx // 16),
node AS MATERIALIZED (
  SELECT tree, level, idx, n, run FROM low WHERE level > 0 UNION ALL SELECT tree, level, idx, n, run FROM high WHERE level > 0),
climb AS (
  SELECT doc_id, leaf, tree AS own, tree, 0 AS level, idx, n, proved AS folded, '' AS others, row_number() OVER () AS i FROM leafy
  UNION ALL
  SELECT c.doc_id, c.leaf, c.own, node.tree, node.level, node.idx, node.n,
         sha256(left(run, c.pos * 64) || c.folded || substr(run, c.pos * 64 + 65)), c.others || left(run, c.pos * 64) || substr(run, c.pos * 64 + 65), c.i
  FROM (SELECT *, CASE WHEN n = 1 THEN own ELSE idx END % 16 AS pos FROM climb WHERE n > 1 OR (tree >= 0 AND (SELECT count(*) FROM sub) > 1)) c
  JOIN node ON node.tree = CASE WHEN c.n > 1 THEN c.tree ELSE -1 END AND node.level = CASE WHEN c.n > 1 THEN c.level + 1 ELSE 1 END
    AND node.idx = CASE WHEN c.n > 1 THEN c.idx ELSE c.own END // 16)
SELECT c.doc_id, c.leaf, s.h AS subroot, r.h AS root, sha256(others) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM climb c JOIN sub s ON s.idx = c.own JOIN (SELECT h FROM high WHERE n = 1) r ON true
WHERE c.n = 1 AND (c.tree = -1 OR s.n = 1)"""


@query("op11_merkle_manifest", MERKLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.verify(docs, tampered, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@query("op12_language_id")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id count as those of an empty one: remainder 0, not held out."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    return language_id.identify(documents(spark, sf_dir), held_out)


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return token_alignment.align(documents(spark, sf_dir), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
