"""The registered queries of this subpackage, and their DuckDB text where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import conversation_repair, embedding_dedup, exact_dedup, gif, importance, language_id, minhash, mixing, packing, substring_dedup, token_count
from stepweave.llm import url_filter, warc
from stepweave.llm.common import read

WORD_SQL = r"[^\x20\x09-\x0D]+"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.planned(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                       F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_SQL}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source IS NULL, source) AS k,
  sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
  sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den FROM w),
f AS (SELECT *, min(CASE WHEN 3 * source_size * den > weight * num THEN k END) OVER () AS stop FROM o),
r AS (SELECT source, source_size, CASE WHEN stop IS NULL OR k < stop THEN (3 * source_size)::DOUBLE
  ELSE weight::DOUBLE * (max(CASE WHEN k = stop THEN num END) OVER ())::DOUBLE / (max(CASE WHEN k = stop THEN den END) OVER ())::DOUBLE END AS target FROM f),
t AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM r)
SELECT d.doc_id, d.size, t.source_size, t.target,
  (floor(rate) + CASE WHEN ('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0
    < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * d.size AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.span_report(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("_id").alias("doc_id"), F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"),
                       F.size("_starts").cast("long").alias("n_spans"), F.col("_kept_sha256").alias("kept_sha256"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = minhash.near_groups(read(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85)
    return rows.select(F.col("_id").alias("doc_id"), F.col("_n_shingles").alias("n_shingles"), F.col("_component_id").alias("component_id"),
                       F.col("_id").eqNullSafe(F.col("_component_id")).alias("kept"))


OP4_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_SQL}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_n >= 85 * (na.n + nb.n - both_n)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, to_id) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.to_id),
c AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_features(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = language_id.identified(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return docs.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_count.counted(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("_n_tokens").alias("n_tokens"), F.col("_score").alias("score"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.dedup_report(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("_id").alias("doc_id"), F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"),
                       F.col("_kept").alias("kept"), F.col("_digest").alias("text_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY norm) AS group_size FROM d
  WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""

def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = url_filter.judged(read(spark, sf_dir, "pages").select("page_id", "url"))
    return pages.select("page_id", *[F.col(f"_{c}").alias(c) for c in ("host", "path", "rule", "verdict")])


OP9_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(h, p, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY page_id)
SELECT page_id, host, path, rule, CASE WHEN verdict IS NOT NULL THEN verdict WHEN host = '' THEN 'block'
  WHEN regexp_full_match(host || path, '([^/]*\.)?ads\.[^/]*/.*|.*/cgi-bin/.*|.*/wp-login\.php|.*\.exe|.*\.zip', 's') THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN m USING (page_id)
"""

def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select(warc.page_of(F.col("id")).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
                          warc.page_of(F.col("refers")).alias("refers_to"))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
g AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to FROM g
"""


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("text")
    return importance.importance_report(docs, target).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: CRC-32 of the text ``{0}``, byte by byte over the row of ``crc`` (t: list of 256).
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), (2 * i + 1)::INTEGER, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"""
CRC_TABLE_SQL = """crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""
OP11_SQL = rf"""
WITH {CRC_TABLE_SQL},
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
fd AS (SELECT k, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
fb AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
n AS (SELECT k, f, count(*) AS n FROM fd GROUP BY ALL),
h AS MATERIALIZED (SELECT f, {CRC_SQL.format('f')} % 10000 AS bucket FROM (SELECT f FROM fd UNION SELECT f FROM fb), crc),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM n JOIN h USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM fb JOIN h USING (f) GROUP BY bucket),
a AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS total_s, coalesce((SELECT sum(t) FROM t), 0)::DOUBLE AS total_t),
g AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (total_s + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (total_t + 10000))))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM h) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), a),
v AS (SELECT k, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM n JOIN h USING (f) JOIN g USING (bucket) GROUP BY k),
x AS (SELECT k, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE)
  / 4294967296.0::DOUBLE)))::BIGINT AS score, coalesce(weight, 0) AS weight FROM d LEFT JOIN v USING (k)),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * 25 // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (k)
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(conversation_repair.named(read(spark, sf_dir, "conversations")))
    report, _ = conversation_repair.repair(rows, keep=False)
    return report.withColumnRenamed("conv", "conv_id")


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embedding_dedup.near_groups(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


OP13_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS k FROM embeddings),
u AS MATERIALIZED (SELECT * FROM v WHERE len(e) > 0 AND list_count(e) = len(e) AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.k <> b.k AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(k, to_k) AS (SELECT k, k FROM v UNION SELECT r.k, l.b FROM r JOIN l ON l.a = r.to_k),
c AS (SELECT r.k, min(v.vec_id) AS component_id FROM r JOIN v ON v.k = r.to_k GROUP BY r.k),
n AS (SELECT a AS k, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (k) LEFT JOIN n USING (k)
"""

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_source_mix": op2_source_mix,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_gif_media": op5_gif_media,
    "op6_language_id": op6_language_id,
    "op7_token_count": op7_token_count,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_warc": op10_warc,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}
ORACLES = {
    "op2_source_mix": OP2_SQL,
    "op4_near_dedup": OP4_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_url_filter": OP9_SQL,
    "op10_warc": OP10_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op13_embedding_near_dedup": OP13_SQL,
}
