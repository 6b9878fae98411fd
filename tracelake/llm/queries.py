"""Registered queries of the operators in this folder and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import (byte_bpe, cap_filters, cross_parse, fill_middle, importance_draw, license_scan, maxent_lm, mpeg_audio, ngram_join,
                           nn_descent, pfair_mix, url_digests, weak_quality)
from tracelake.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.quality(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op2_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.lm_scores(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op3_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parse.languages(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query
def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mixed(read(spark, sf_dir, "documents", "doc_id", "source"))


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded_texts(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source / number div 512 / number div 32 / number."""
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    path = F.concat_ws("/", "source", F.expr("doc_id div 512"), F.expr("doc_id div 32"), F.concat("doc_id", F.lit(".txt")))
    return license_scan.licenses(docs.select("doc_id", path.alias("path"), "text"))


@query
def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@query
def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.stored_texts(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(read(spark, sf_dir, "documents", "doc_id", "text"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op10_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_digests.judged(read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
SQL["op10_url_digests"] = f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                                     '{url_digests.UPPER}', '{url_digests.LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE WHEN {_FITS.format('example.net', '/en/')} THEN 'example.net/en/'
                 WHEN {_FITS.format('example.com', '/de/')} THEN 'example.com/de/'
                 WHEN {_FITS.format('org', '/fr/')} THEN 'org/fr/'
                 WHEN {_FITS.format('net', '/')} THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query
def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_draw.resampled(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "text")).select(
        "doc_id", "n_features", "weight", "score", "rank")


SQL["op11_importance_draw"] = f"""
WITH RECURSIVE
bits AS (SELECT b, 0 AS k, b AS c FROM range(256) r(b)
         UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
texts AS (SELECT true AS own, doc_id AS id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
worded AS (
  SELECT row_number() OVER () AS r, own, id,
         regexp_extract_all(translate(coalesce(text, ''), '{url_digests.UPPER}', '{url_digests.LOWER}'),
                            '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM texts),
grams AS (SELECT r, own, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM worded),
bucketed AS (
  SELECT f, xor(list_reduce(list_transform(range(1, octet_length(encode(f)) + 1),
                                           lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT),
                            lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM grams), crcs),
placed AS (SELECT r, own, bucket FROM grams JOIN bucketed USING (f)),
counted AS (
  SELECT b AS bucket, count(bucket) FILTER (own) AS s, count(bucket) FILTER (NOT own) AS t
  FROM range(10000) x(b) LEFT JOIN placed ON bucket = b GROUP BY b),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000)::DOUBLE))) AS gain
  FROM counted),
weighed AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight
  FROM worded LEFT JOIN (SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight
                         FROM placed JOIN gains USING (bucket) WHERE own GROUP BY r) USING (r)
  WHERE own),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM weighed),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
         25 * count(*) FILTER (n_words >= 20) OVER () // 100 AS drawn
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM ranked
"""


@query
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(read(spark, sf_dir, "documents", "doc_id", "text"))


SQL["op12_fill_middle"] = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
drawn AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM texts),
cut AS (
  SELECT *, least(a, b) AS low, greatest(a, b) AS high, substring(text, 1, least(a, b)) AS prefix,
         substring(text, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle, substring(text, greatest(a, b) + 1) AS suffix
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


@query
def op13_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


SQL["op13_cap_filters"] = """
WITH RECURSIVE
able AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM able a JOIN able b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)) >= 0.95),
reached AS (SELECT vec_id AS u, vec_id AS v FROM embeddings
            UNION SELECT r.u, l.v FROM reached r JOIN links l ON l.u = r.v)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT u AS vec_id, min(v) AS component_id FROM reached GROUP BY u) USING (vec_id)
     LEFT JOIN (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u) USING (vec_id)
"""
