"""Queries over the evidence of all detectors: JSON boundary, summaries, ranks and the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.operators import aggregates, evidence, filters, joins, ordering
from tracelake.plans import oracle as o
from tracelake.plans.registry import query
from tracelake.plans.views import Views

c = F.col
SUMMARY = "SELECT finding_id, has_completed_scan, CAST(confirmed_categories AS BIGINT) AS confirmed_categories, CAST(evidence_count AS BIGINT) AS evidence_count FROM ranked"


def summary(rows):
    return evidence.with_summary(rows).select("finding_id", "has_completed_scan", c("confirmed_categories").cast("long").alias("confirmed_categories"),
                                              c("evidence_count").cast("long").alias("evidence_count"))


def reread(v: Views):
    """Findings written to JSON and read back."""
    stored = v.audited.select("finding_id", evidence.to_metadata().alias("metadata"))
    parts = [evidence.parsed(c("metadata"), name).alias(name) for name in evidence.JSON_KEYS if name != "similarity"]
    return stored.select("finding_id", *parts, evidence.parsed_people(c("metadata")).alias("people"),
                         evidence.parsed_status(c("metadata")).alias("scan_status"))


@query("agg14_evidence_summary", SUMMARY, ("ranked",))
def _(v: Views):
    return summary(v.audited)


@query("jsn1_metadata_round_trip", """
    SELECT finding_id, has_completed_scan,
           CAST(confirmed_categories AS BIGINT) AS confirmed_categories, CAST(evidence_count AS BIGINT) AS evidence_count FROM ranked""", ("ranked",))
def _(v: Views):
    return summary(reread(v))


@query("jsn1_merge_keeps_other_keys", """
    SELECT finding_id, CASE WHEN ordinal % 5 = 0 THEN CAST(sec_total AS VARCHAR) END AS secrets, CAST(ordinal AS VARCHAR) AS pii,
           CASE WHEN media THEN ppl_status END AS people FROM audited""", ("audited",))
def _(v: Views):
    new = F.struct(c("ordinal").alias("total_matches"))
    rows = v.audited.select("finding_id", evidence.merged(evidence.to_metadata(), "pii_scan", new).alias("m"))
    return rows.select("finding_id", F.get_json_object("m", "$.secret_scan.total_matches").alias("secrets"),
                       F.get_json_object("m", "$.pii_scan.total_matches").alias("pii"),
                       F.get_json_object("m", "$.people_scan_status").alias("people"))


@query("jsn1_merge_people_at_root", """
    SELECT finding_id, CAST(ordinal % 7 AS VARCHAR) AS faces, CASE WHEN ordinal % 3 = 0 THEN CAST(pii_total AS VARCHAR) END AS pii FROM audited""", ("audited",))
def _(v: Views):
    people = F.struct(F.lit("Completed").alias("people_scan_status"), (c("ordinal") % 7).alias("face_count"))
    rows = v.audited.select("finding_id", evidence.merged_people(evidence.to_metadata(), people).alias("m"))
    return rows.select("finding_id", F.get_json_object("m", "$.face_count").alias("faces"),
                       F.get_json_object("m", "$.pii_scan.total_matches").alias("pii"))


@query("jsn2_tolerant_read", """
    SELECT finding_id, CASE WHEN ordinal % 3 = 0 THEN ordinal % 4 END AS total, ordinal % 3 = 0 AS present FROM findings""", ("findings",))
def _(v: Views):
    n = c("ordinal")
    broken = (F.when(n % 3 == 0, F.concat(F.lit('{"pii_scan":{"total_matches":'), (n % 4).cast("string"), F.lit("}}")))
              .when(n % 3 == 1, F.lit('{"pii_scan":')).otherwise(F.lit('{"other":1}')))
    rows = v.findings.select("finding_id", evidence.parsed(broken, "pii").alias("p"))
    return rows.select("finding_id", c("p.total_matches").cast("long").alias("total"), c("p").isNotNull().alias("present"))


@query("jsn3_mark_completed", " UNION ALL ".join(
    f"SELECT '{k}' AS scanner, count(*) AS done FROM audited WHERE {'true' if k == 'exif' else 'done_' + k}" for k in fixed.SCANNER_KEYS), ("audited",))
def _(v: Views):
    marked = evidence.mark_completed(evidence.to_metadata(), "exif")
    rows = v.audited.select(evidence.parsed_status(marked).alias("scan_status"))
    counts = rows.agg(*[F.count_if(evidence.is_completed(k)).alias(k) for k in fixed.SCANNER_KEYS])
    return counts.unpivot([], fixed.SCANNER_KEYS, "scanner", "done")


SIGNALS = o.positive_terms(o.HITS[:7] + [o.HITS[8]])


@query("agg15_confirmed_signals", f"SELECT finding_id, CAST({SIGNALS} AS BIGINT) AS signals FROM audited", ("audited",))
def _(v: Views):
    return v.audited.select("finding_id", evidence.confirmed_signals().cast("long").alias("signals"))


@query("agg2_enrichment", f"SELECT count(*) FILTER (s > 0) AS enriched, CAST(sum(s) AS BIGINT) AS signals FROM (SELECT {SIGNALS} AS s FROM audited)", ("audited",))
def _(v: Views):
    return aggregates.enrichment(v.audited)


RANKS = ["objective_risk", "combined_score", "privacy_rank", "detection_rank"]


@query("rnk1_to_5_ranks", "SELECT finding_id, " + ", ".join(f"CAST({r} AS BIGINT) AS {r}" for r in RANKS) + " FROM ranked", ("ranked",))
def _(v: Views):
    return evidence.with_ranks(v.audited).select("finding_id", *[c(r).cast("long").alias(r) for r in RANKS])


@query("rnk3_evidence_floor", f"SELECT finding_id, CAST({o.FLOOR} AS BIGINT) AS floor_score FROM audited", ("audited",))
def _(v: Views):
    return v.audited.select("finding_id", evidence.evidence_floor().cast("long").alias("floor_score"))


BADGE = f"""concat_ws('{fixed.BADGE_SEPARATOR}', CASE WHEN {o.HITS[0]} THEN 'PII: ' || pii_total END, CASE WHEN {o.HITS[1]} THEN 'Secrets: ' || sec_total END,
    CASE WHEN {o.HITS[2]} THEN 'Config: High' END, CASE WHEN {o.HITS[3]} THEN 'Identity: ' || idt_total END,
    CASE WHEN {o.HITS[4]} THEN 'Archive: ' || arc_score || ' (' || arc_sensitive || ')' END,
    CASE WHEN exif_gps THEN 'GPS' WHEN exif_model IS NOT NULL THEN 'EXIF: ' || exif_model END,
    CASE WHEN {o.HITS[5]} THEN (CASE WHEN doc_is_id THEN 'ID Document · ' ELSE 'Document · ' END) || {o.even('doc_conf * 100')} || ' %' END,
    CASE WHEN {o.HITS[6]} THEN 'People: ' || ppl_faces END,
    CASE WHEN {o.HITS[7]} THEN saf_class || ' · NSFW Score: ' || {o.even('nsfw * 100')} || ' %' END)"""


@query("scl19_badges", f"""
    SELECT finding_id, CASE WHEN badge <> '' THEN badge WHEN has_completed_scan THEN 'No' ELSE 'Unknown' END AS badge
    FROM (SELECT finding_id, has_completed_scan, {BADGE} AS badge FROM ranked)""", ("ranked",))
def _(v: Views):
    # The coordinate text is checked by the metadata queries; here only its place in the list is.
    return v.audited.select("finding_id", F.regexp_replace(evidence.badge(), r"GPS: -?[0-9.]+, -?[0-9.]+", "GPS").alias("badge"))


@query("srt1_named_sorts", "SELECT sort, finding_id, position FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS sort, finding_id, row_number() OVER (ORDER BY {key} DESC NULLS LAST, ordinal) AS position FROM ranked"
    for name, key in [("RiskLevel", o.order_sql(o.level_sql("exposure_score"))), ("ExposureScore", "combined_score"),
                      ("PersonalAttentionScore", "coalesce(personal_score, -1)"), ("DetectionPriorityRank", "detection_rank"),
                      ("Path", "path"), ("ModifiedAt", "modified_at")]) + ") WHERE position <= 50", ("ranked",))
def _(v: Views):
    ranked = evidence.with_ranks(v.audited)
    tops = []
    for name in ("RiskLevel", "ExposureScore", "PersonalAttentionScore", "DetectionPriorityRank", "Path", "ModifiedAt"):
        order = ordering.finding_order(name, True)
        top = ranked.orderBy(*order).limit(50)
        # Fifty rows are left here, so one small window numbers them.
        tops.append(top.select(F.lit(name).alias("sort"), "finding_id",
                               F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order)).cast("long").alias("position")))
    return reduce(lambda a, b: a.unionByName(b), tops)


@query("srt3_media_order", "SELECT finding_id, CAST(combined_score AS BIGINT) AS combined_score FROM ranked WHERE media", ("ranked",))
def _(v: Views):
    media = evidence.with_ranks(v.audited).filter(filters.media_scope(True, True))
    return media.orderBy(*ordering.media_order()).select("finding_id", c("combined_score").cast("long").alias("combined_score"))


PAGE = """SELECT finding_id, CAST({page} AS BIGINT) AS page, total FROM (SELECT finding_id, count(*) OVER () AS total,
    row_number() OVER (ORDER BY exposure_score DESC, size_bytes DESC, ordinal) - 1 AS position FROM findings) WHERE position // 60 = {page}"""


def page_rows(v: Views, requested: int):
    rows, info = ordering.page(v.findings, ordering.INITIAL, requested, 60)
    return rows.select("finding_id", F.lit(info["page"]).cast("long").alias("page"), F.lit(info["total"]).cast("long").alias("total"))


@query("top1_first_page", PAGE.format(page="0"), ("findings",))
def _(v: Views):
    return page_rows(v, 0)


@query("top1_last_page_by_wrapping", PAGE.format(page="((total - 1) // 60)"), ("findings",))
def _(v: Views):
    return page_rows(v, -1)


REPORT = "SELECT finding_id, CAST(privacy_rank AS BIGINT) AS privacy_rank FROM (SELECT *, (ordinal % 3 = 2 OR ordinal % 2 = 0) AS failed FROM ranked WHERE ordinal % 5 <> 1) WHERE NOT ignored AND {}"


def report(v: Views, sort: str, **view):
    picked = v.audited.filter("ordinal % 5 <> 1").select("finding_id")
    failed = v.route_state.filter("state = 'failed'").select("finding_id").distinct().withColumn("failed", F.lit(True))
    rows = evidence.with_ranks(joins.in_session(v.audited, picked)).join(failed, "finding_id", "left")
    rows = rows.withColumn("failed", F.coalesce("failed", F.lit(False)))
    return rows.filter(filters.report_view(**view)).orderBy(*ordering.report_order(sort)).select(
        "finding_id", c("privacy_rank").cast("long").alias("privacy_rank"))


@query("flt13_priority_report_confirmed", REPORT.format("confirmed_categories > 0 AND category = 'Documents'"), ("ranked",))
def _(v: Views):
    return report(v, "Privacy", status="Confirmed", kind="documents")


@query("flt13_priority_report_clear", REPORT.format("has_completed_scan AND confirmed_categories = 0 AND NOT failed"), ("ranked",))
def _(v: Views):
    return report(v, "Modified", status="Clear")


@query("flt13_priority_report_errors", REPORT.format("failed"), ("ranked",))
def _(v: Views):
    return report(v, "Detection", status="Errors")


def numbered(rows, name: str, order: list, limit: int):
    """The first rows of an order with their positions; only `limit` rows reach the numbering window."""
    place = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order)).cast("long")
    return rows.orderBy(*order).limit(limit).select(F.lit(name).alias("sort"), "finding_id", place.alias("position"))


TOPS = {
    "initial": ("true", "exposure_score DESC, size_bytes DESC, ordinal"),
    "media": ("media", "combined_score DESC, modified_at DESC NULLS LAST, ordinal"),
    "privacy": ("true", "privacy_rank DESC, detection_rank DESC, ordinal"),
    "modified": ("true", "modified_at DESC NULLS LAST, ordinal"),
    "detection": ("true", "detection_rank DESC, ordinal"),
}


@query("srt2_to_4_positions", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS sort, finding_id, row_number() OVER (ORDER BY {order}) AS position FROM ranked WHERE {where}"
    for name, (where, order) in TOPS.items()) + ") WHERE position <= 100", ("ranked",))
def _(v: Views):
    ranked = evidence.with_ranks(v.audited)
    media = ranked.filter(filters.media_scope(True, True))
    tops = [numbered(ranked, "initial", ordering.initial_order(), 100), numbered(media, "media", ordering.media_order(), 100)]
    tops += [numbered(ranked, s.lower(), ordering.report_order(s), 100) for s in ("Privacy", "Modified", "Detection")]
    return reduce(lambda a, b: a.unionByName(b), tops)
