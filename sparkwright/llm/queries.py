"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm.common import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.secrets import secret_report

    return secret_report(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.language_id import language_id

    return language_id(read(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.surrogates import surrogated

    return surrogated(read(spark, sf_dir, "documents"), key="a key for tests, not a secret").select("doc_id", "text", "n_replaced")


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.nearest import nearest

    return nearest(read(spark, sf_dir, "embeddings"))


def op5_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.decontaminate import contaminations

    return contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.mixing import mix_plan

    return mix_plan(read(spark, sf_dir, "documents")).drop("copies")


def op7_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.jaccard import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.token_planes import token_planes

    return token_planes(read(spark, sf_dir, "documents"), tokenizer_path()).drop("shard")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.line_dedup import line_report

    return line_report(read(spark, sf_dir, "documents"))


def op11_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.sharding import shard_plan

    return shard_plan(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.filter_audit import filter_audit

    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkwright.llm.hard_negatives import hard_negatives

    return hard_negatives(read(spark, sf_dir, "embeddings"), shifted=F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap,
                 row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sources),
levels AS (SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM named),
water AS (SELECT arg_min(level, cap / weight) AS water FROM levels WHERE cap / weight > level),
targets AS (SELECT source, source_size, CASE WHEN cap / weight <= level OR water IS NULL THEN cap ELSE water * weight END AS target FROM levels, water),
drawn AS (
  SELECT doc_id, sized.source, size, source_size, target, k, target / source_size AS rate,
         CAST('0x' || substr(md5('17:' || k || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source, range(32) r(k)),
plan AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size ELSE 0 END AS BIGINT) AS taken FROM drawn),
best AS (SELECT source, arg_min(k, (off, k)) AS k FROM (SELECT source, k, abs(CAST(sum(taken) AS DOUBLE) - any_value(target)) AS off FROM plan GROUP BY source, k) GROUP BY source)
SELECT doc_id, size, source_size, target, taken FROM plan JOIN best ON plan.k = best.k AND plan.source IS NOT DISTINCT FROM best.source
"""


#: The checksum's table is made by its rule (fixed polynomial); capacity, least ends and cuts are three recursions.
OP11_SQL = r"""
WITH RECURSIVE
crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
sized AS (SELECT doc_id, coalesce(text, '') AS txt, md5(coalesce(text, '')) AS key, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size FROM documents),
texts AS (SELECT key, any_value(txt) AS txt, CAST(sum(size) AS BIGINT) AS size FROM sized GROUP BY key),
checks AS (SELECT key, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(txt)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32 FROM texts, crc_table),
ranked AS (SELECT key, size, row_number() OVER w AS r, sum(size) OVER () - sum(size) OVER w + size AS left_of FROM texts WINDOW w AS (ORDER BY size DESC, key ROWS UNBOUNDED PRECEDING)),
marked AS (SELECT *, bool_and(r <= 15 AND size * (17 - r) >= left_of) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS own FROM ranked),
h AS (SELECT CAST(count(*) FILTER (own) AS INTEGER) AS own, 16 - CAST(count(*) FILTER (own) AS INTEGER) AS n, CAST(coalesce(sum(size) FILTER (NOT own), 0) AS BIGINT) AS total FROM marked),
p AS MATERIALIZED (SELECT key, CAST(sum(size) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM marked WHERE NOT own UNION ALL SELECT NULL, 0),
search(lo, hi, x, step) AS (
  SELECT CAST(ceil(total / n) AS BIGINT), total, CAST(0 AS BIGINT), 0 FROM h
  UNION ALL
  SELECT CASE WHEN upto < total AND step + 1 = n THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN upto = total THEN (lo + hi) // 2 ELSE hi END,
         CASE WHEN upto = total OR step + 1 = n THEN 0 ELSE upto END, CASE WHEN upto = total OR step + 1 = n THEN 0 ELSE step + 1 END
  FROM (SELECT *, (SELECT max(p.upto) FROM p WHERE p.upto <= x + (lo + hi) // 2) AS upto FROM search, h WHERE lo < hi) s),
most AS (SELECT hi AS most, total, n FROM search, h WHERE lo = hi),
least(k, y) AS (
  SELECT 1, total FROM most
  UNION ALL
  SELECT k + 1, (SELECT min(p.upto) FROM p WHERE p.upto >= greatest(0, y - most)) FROM least, most WHERE k < n),
shares(k, x) AS (
  SELECT n, CAST(0 AS BIGINT) FROM most
  UNION ALL
  SELECT k - 1, greatest(least(CASE WHEN a > x AND 2 * (x * k + total - x) <= (a + b) * k THEN a ELSE b END, f), y)
  FROM (SELECT s.k, s.x, total, (SELECT max(p.upto) FROM p WHERE p.upto <= s.x + (total - s.x) // s.k) AS a, (SELECT min(p.upto) FROM p WHERE p.upto >= least(total, s.x + (total - s.x) // s.k + 1)) AS b,
               (SELECT max(p.upto) FROM p WHERE p.upto <= s.x + most) AS f, (SELECT l.y FROM least l WHERE l.k = s.k) AS y FROM shares s, most WHERE s.k > 1) t),
ends AS (SELECT key FROM shares JOIN p ON p.upto = shares.x AND p.key IS NOT NULL WHERE k < (SELECT n FROM h)),
placed AS (SELECT m.key, CAST(CASE WHEN m.own THEN m.r - 1 ELSE (SELECT own FROM h) + (SELECT count(*) FROM ends WHERE ends.key < m.key) END AS INTEGER) AS shard FROM marked m)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, key) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sized JOIN placed USING (key) JOIN checks USING (key)
"""

OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS txt FROM documents),
split AS (SELECT *, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY txt) AS first_id FROM texts),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
rows AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(txt, '[A-Z]')) > 5 * length(txt) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(txt, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM split LEFT JOIN marks USING (doc_id)),
masks AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM rows GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM orders, range(1, 6) r(step)),
counted AS (
  SELECT part, filter_order, step, f,
         sum(n) FILTER (len(list_intersect(string_split(fails, ''), string_split(before || f, ''))) = 0 OR fails = '') AS kept,
         sum(n) FILTER (contains(fails, f) AND (before = '' OR len(list_intersect(string_split(fails, ''), string_split(before, ''))) = 0)) AS removed,
         sum(n) FILTER (contains(fails, f) AND before != '' AND len(list_intersect(string_split(fails, ''), string_split(before, ''))) > 0) AS redundant,
         sum(n) FILTER (fails = f) AS unique_fails,
         sum(good) FILTER (contains(fails, f) AND (before = '' OR len(list_intersect(string_split(fails, ''), string_split(before, ''))) = 0)) AS good_lost,
         sum(toxic) FILTER (contains(fails, f) AND (before = '' OR len(list_intersect(string_split(fails, ''), string_split(before, ''))) = 0)) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""

OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label != s.anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_secret_scan, op2_language_id, op3_pii_surrogates, op4_nearest_vectors, op5_benchmark_hits, op6_mix_sources, op7_jaccard_groups, op8_token_counts, op9_token_planes, op10_line_dedup, op11_minimax_shards, op12_filter_audit, op13_hard_negatives)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op6_mix_sources": OP6_SQL, "op11_minimax_shards": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_hard_negatives": OP13_SQL}
