"""Queries over whole tables for the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontam, exact, mixing, neardup, periodic, pii, quality, sharding, substring, tokencount, vectors, wrappers,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_dup_groups(
        _table(spark, sf_dir, "documents"), shingle=3, percent=85,
    ).select("doc_id", "n_shingles", "component_id", "kept")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"),
    ).drop("clean_text")


def op4_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op5_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_text(_table(spark, sf_dir, "pages"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).drop("copies")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_table(spark, sf_dir, "documents")).drop("kept_text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(periodic.planted(_table(spark, sf_dir, "documents"))))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings")).drop("class_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_near_dedup": op2_near_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_find_pii": op4_find_pii,
    "op5_extract_text": op5_extract_text,
    "op6_mix_sources": op6_mix_sources,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_shard": op9_shard,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_near_vectors": op12_near_vectors,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The checksum of an id's digits, bit by bit.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), "
    "lambda k: ascii((doc_id::VARCHAR)[k])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), "
    "lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT)"
)

ORACLE_SQL: dict[str, str] = {
    "op2_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
s AS (SELECT DISTINCT doc_id, g FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id, n""",
    "op3_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b1 AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
b2 AS (SELECT item_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM b1),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1:i + k], ' ') AS g FROM b2),
d1 AS (SELECT doc_id, w, k FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
d2 AS (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d1),
hit AS (SELECT doc_id, item_id, k, i FROM (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS g FROM d2) JOIN win USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op6_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, ('0x' || substr(md5('17:' || doc_id), 1, 8))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM s1),
s3 AS (SELECT source, source_size, CASE WHEN lev * w >= cap THEN cap ELSE (max(lev) FILTER (lev * w < cap) OVER ()) * w END AS target FROM s2),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM s3),
e AS (SELECT d.doc_id, d.size, d.h, s4.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN size > 0 AND 2 * upto - size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e""",
    "op7_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
v AS (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 13], ' ') AS g FROM v),
m AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (g) WHERE doc_id > least)),
p AS (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d),
k AS (SELECT p.doc_id, string_agg(w[p.p + 1], ' ' ORDER BY p.p) AS kept FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.p = c.p GROUP BY p.doc_id),
r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op11_periodic_runs": rf"""
WITH RECURSIVE h AS (SELECT doc_id, {_WORDS} AS w, {_CRC} AS h FROM documents),
v AS (SELECT doc_id, w, h // 10 AS g, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS folded FROM h),
f AS (SELECT doc_id, w, n, folded, CASE WHEN folded THEN g % n END AS a, CASE WHEN folded THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM v),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN folded THEN w[:a] || list_transform(range(a, n), lambda i: w[a + (i - a) % p + 1]) ELSE w END AS w FROM f),
m AS (SELECT doc_id, n, 16 AS m, list_transform(range(1, n - 14), lambda i: hash(w[i:i + 15])) AS hs FROM d WHERE n >= 24
  UNION ALL SELECT doc_id, n, 2 * m, list_transform(range(1, len(hs) - m + 1), lambda i: hash(hs[i], hs[i + m])) FROM m WHERE 3 * m < n),
o AS (SELECT doc_id, n, m, unnest(range(0, len(hs))) AS i, unnest(hs) AS h FROM m),
x AS (SELECT doc_id, m, n, lead(i) OVER (PARTITION BY doc_id, m, h ORDER BY i) - i AS q FROM o),
c AS (SELECT DISTINCT doc_id, q FROM x WHERE q IS NOT NULL AND q <= m AND (q > m // 2 OR m = 16) AND 3 * q <= n),
s AS (SELECT doc_id, q, unnest(list_filter(range(0, n - q), lambda i: w[i + 1] = w[i + q + 1])) AS i FROM c JOIN d USING (doc_id)),
z AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM s),
r0 AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM z GROUP BY doc_id, q, z HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM r0 a WHERE NOT EXISTS (FROM r0 b WHERE b.doc_id = a.doc_id AND b.q < a.q AND a.q % b.q = 0 AND b.s <= a.s AND b.s + b.l >= a.s + a.l)),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY (l // q) DESC, (l % q)::DOUBLE / q DESC, s, q) = 1),
g AS (SELECT doc_id, list_distinct(flatten(list(range(s + q, s + l)))) AS gone FROM r GROUP BY doc_id),
u AS (SELECT doc_id, array_to_string(list_transform(list_filter(range(0, n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]), ' ') AS t FROM g JOIN d USING (doc_id))
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(u.t, array_to_string(d.w, ' '), '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN u USING (doc_id)""",
    "op12_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e,
  coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0, false) AS ok FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, min(root) AS component_id, v.vec_id = min(root) AS kept
FROM v JOIN r USING (vec_id) LEFT JOIN n USING (vec_id) GROUP BY v.vec_id, n""",
}
