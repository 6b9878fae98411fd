"""Queries for similar documents and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import similarity
from tracelake.plans import oracle as o
from tracelake.plans.registry import query
from tracelake.plans.views import AS_OF, Views
from tracelake.session import version

c = F.col
QUERY_DOC, QUERY_IMAGE = 3, 7


INDEXES: dict[tuple[str, str], tuple[str, similarity.TermIndex]] = {}


def index_of(v: Views) -> similarity.TermIndex:
    """The index of a folder's documents, built by the first request of a session and anew when the files change."""
    name, state = (v.spark.sparkContext.applicationId, v.folder), version(v.documents)
    if name not in INDEXES or INDEXES[name][0] != state:
        INDEXES[name] = (state, similarity.TermIndex.of(v.document_texts.select("doc_id", "text")))
    return INDEXES[name][1]


@query("sim1_term_counts", """
    SELECT doc_id, count(*) AS terms, CAST(sum(n) AS BIGINT) AS tokens, max(n) AS top_count, min(term) AS first_term FROM doc_terms GROUP BY doc_id""", ("doc_terms",))
def _(v: Views):
    return similarity.term_counts(v.document_texts).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("n").alias("tokens"), F.max("n").alias("top_count"), F.min("term").alias("first_term"))


@query("sim2_document_frequency", "SELECT term, count(*) AS df FROM doc_terms GROUP BY term", ("doc_terms",))
def _(v: Views):
    return similarity.document_frequency(similarity.term_counts(v.document_texts))


@query("sim3_tf_idf", "SELECT doc_id, round(sum(w), 4) AS weight, round(max(w), 4) AS top_weight FROM doc_weights GROUP BY doc_id", ("doc_weights",))
def _(v: Views):
    weights = similarity.tf_idf(similarity.term_counts(v.document_texts))
    return weights.groupBy("doc_id").agg(F.round(F.sum("w"), 4).alias("weight"), F.round(F.max("w"), 4).alias("top_weight"))


COSINE = f"""(SELECT d.doc_id, sum(d.w * q.w) / (any_value(n.norm) * (SELECT sqrt(sum(w * w)) FROM doc_weights WHERE doc_id = {QUERY_DOC})) AS cosine
    FROM doc_weights d JOIN (SELECT term, w FROM doc_weights WHERE doc_id = {QUERY_DOC}) q USING (term)
    JOIN (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM doc_weights GROUP BY doc_id) n ON n.doc_id = d.doc_id
    WHERE d.doc_id <> {QUERY_DOC} GROUP BY d.doc_id)"""


@query("sim4_similar_documents", f"""
    SELECT doc_id, score FROM (SELECT doc_id, round(least(1, cosine), 3) AS score FROM {COSINE} WHERE cosine >= 0.15) ORDER BY score DESC, doc_id LIMIT 50""", ("doc_weights",))
def _(v: Views):
    return similarity.similar_documents(index_of(v), QUERY_DOC).select("doc_id", "score")


CANDIDATES = f"SELECT ordinal FROM findings WHERE (NOT ignored AND ext IN {o.in_list(o.fixed.PLAIN_TEXT_EXTENSIONS + o.fixed.OFFICE_EXTENSIONS)}) OR ordinal = {QUERY_DOC}"


@query("sim4_similar_findings", f"""
    WITH terms AS (SELECT * FROM doc_terms WHERE doc_id IN ({CANDIDATES})),
    weights AS (SELECT t.*, (0.5 + 0.5 * CAST(t.n AS DOUBLE) / t.total) * (ln((1 + (SELECT count(DISTINCT doc_id) FROM terms)) / CAST(1 + f.df AS DOUBLE)) + 1) AS w
                FROM terms t JOIN (SELECT term, count(*) AS df FROM terms GROUP BY term) f USING (term))
    SELECT doc_id, score FROM (SELECT doc_id, round(least(1, cosine), 3) AS score FROM {COSINE.replace('doc_weights', 'weights')} WHERE cosine >= 0.15)
    ORDER BY score DESC, doc_id LIMIT 50""", ("doc_terms", "findings"))
def _(v: Views):
    """Candidates are the visible findings of a readable type."""
    docs = similarity.candidate_documents(v.findings.withColumn("doc_id", c("ordinal")), v.document_texts.select("doc_id", "text"), QUERY_DOC)
    return similarity.similar_documents(similarity.TermIndex.of(docs), QUERY_DOC).select("doc_id", "score")


def signed(bits: str) -> str:
    return (f"CAST(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN {bits}[i + 1] THEN "
            "(CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE CAST(1 AS HUGEINT) << CAST(i AS INTEGER) END) ELSE 0::HUGEINT END)) AS BIGINT)")


@query("sim6_perceptual_hashes", f"SELECT vec_id, {signed('d_bits')} AS d_hash, {signed('a_bits')} AS a_hash FROM bits", ("bits",))
def _(v: Views):
    return v.hashes_input.select("vec_id", similarity.difference_hash(c("d_grid")).alias("d_hash"), similarity.average_hash(c("a_grid")).alias("a_hash"))


def apart(name: str) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: CASE WHEN b.{name}[i] <> q.{name}[i] THEN 1 ELSE 0 END))"


SCORE = f"((1 - {apart('d_bits')} / CAST(64 AS DOUBLE)) * CAST(0.7 AS DOUBLE) + (1 - {apart('a_bits')} / CAST(64 AS DOUBLE)) * CAST(0.3 AS DOUBLE))"


@query("sim7_similar_images", f"""
    SELECT vec_id, score FROM (SELECT b.vec_id, {SCORE} AS s, round_even(CAST({SCORE} * 1000 AS DOUBLE), 0) / CAST(1000 AS DOUBLE) AS score FROM bits b, bits q WHERE q.vec_id = {QUERY_IMAGE} AND b.vec_id <> {QUERY_IMAGE})
    WHERE s >= 0.7 ORDER BY score DESC, vec_id LIMIT 50""", ("bits",))
def _(v: Views):
    hashes = v.hashes_input.select("vec_id", similarity.difference_hash(c("d_grid")).alias("d_hash"), similarity.average_hash(c("a_grid")).alias("a_hash"))
    return similarity.similar_images(hashes, QUERY_IMAGE)


@query("sim7_nearest_images", f"""
    SELECT vec_id, score FROM (SELECT b.vec_id, {SCORE} AS s, round_even(CAST({SCORE} * 1000 AS DOUBLE), 0) / CAST(1000 AS DOUBLE) AS score FROM bits b, bits q WHERE q.vec_id = {QUERY_IMAGE} AND b.vec_id <> {QUERY_IMAGE})
    WHERE s >= 0.4 ORDER BY score DESC, vec_id LIMIT 50""", ("bits",))
def _(v: Views):
    hashes = v.hashes_input.select("vec_id", similarity.difference_hash(c("d_grid")).alias("d_hash"), similarity.average_hash(c("a_grid")).alias("a_hash"))
    return similarity.similar_images(hashes, QUERY_IMAGE, floor=0.4)


@query("sim8_saved_analysis", f"""
    SELECT f.finding_id, s.doc_id, s.score FROM (SELECT doc_id, round(least(1, cosine), 3) AS score FROM {COSINE} WHERE cosine >= 0.15 ORDER BY 2 DESC, 1 LIMIT 50) s
    JOIN findings f ON f.ordinal = s.doc_id""", ("doc_weights", "findings"))
def _(v: Views):
    """Matches are stored on the query finding, then read back and joined with the findings that still exist."""
    from tracelake.operators import joins
    from tracelake.plans.views import file_path

    found = similarity.similar_documents(index_of(v), QUERY_DOC)
    rows = found.withColumn("path", file_path(c("doc_id")))
    saved = similarity.saved_analysis("Document", rows, F.lit(AS_OF)).withColumn("finding_id", F.lit("f0000000003"))
    back = joins.saved_matches(saved, v.findings)
    return back.select("finding_id", F.substring("finding_id", 2, 10).cast("long").alias("doc_id"), "score")


