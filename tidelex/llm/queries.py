"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelex.llm.bpe import bpe_round_trip
from tidelex.llm.language_id import language_id
from tidelex.llm.lattice_dedup import embedding_components
from tidelex.llm.licenses import license_scan
from tidelex.llm.ngram_join import ngram_components
from tidelex.llm.packing import pack
from tidelex.llm.quality import quality_scores
from tidelex.llm.quality_rules import quality_rules
from tidelex.llm.substring_dedup import substring_dedup
from tidelex.llm.warc import warc_round_trip


def vocabulary(name: str) -> str:
    """Where a public tokenizer file lies on this machine; any path does in its place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_quality_rules that no model decides, for a check by SQL."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


QUERIES = (op1_quality_classifier, op2_lattice_dedup, op3_substring_dedup, op4_license_scan, op5_language_id, op6_packing, op7_warc, op8_quality_rules, op9_bpe, op10_ngram_join, quality_rules_base)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(ws) - 48)) AS t(i)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
cut AS (SELECT DISTINCT win.doc_id, j FROM win JOIN least USING (h), unnest(range(i, i + 50)) AS t(j) WHERE win.doc_id > m),
pos AS (SELECT doc_id, j, ws[j] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(j)),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY j) AS k, count(*) AS n FROM pos ANTI JOIN cut USING (doc_id, j) GROUP BY pos.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, least(e.vec_id, coalesce(m, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) d ON d.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = e.vec_id
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, n, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, p.n AS payload_bytes, p.d AS payload_digest, CASE WHEN page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < m THEN m END AS refers_to FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM pairs UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = s.doc_id
"""


BASE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
three AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM w, unnest(range(1, len(ws) - 1)) AS r(i)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM three),
marked AS (SELECT doc_id, count(DISTINCT j) AS n FROM again, unnest([i, i + 1, i + 2]) AS r(j) WHERE again.n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(marked.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines USING (doc_id) LEFT JOIN marked ON marked.doc_id = w.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_lattice_dedup": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op7_warc": OP7_SQL, "op10_ngram_join": OP10_SQL, "quality_rules_base": BASE_SQL}
