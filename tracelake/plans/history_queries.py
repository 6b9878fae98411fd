"""Queries over the application history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.operators import filters, history, joins
from tracelake.operators.ordering import positions, with_positions
from tracelake.plans import oracle as o
from tracelake.plans.registry import query
from tracelake.plans.views import AS_OF, Views

c = F.col
PRIORITY = "(CASE WHEN exists_now AND pinned THEN 4 WHEN exists_now THEN 3 WHEN pinned THEN 2 ELSE 1 END)"


def long(name: str):
    return c(name).cast("long").alias(name)


@query("src8_container_summary", """
    SELECT count(*) FILTER (s IS NOT NULL) AS containers, CAST(sum(s) AS BIGINT) AS total_bytes, max(ts) FILTER (s IS NOT NULL) AS last_modified,
           count(*) FILTER (s IS NULL) AS warnings
    FROM (SELECT ts, CASE WHEN event_id % 10 <> 0 THEN CAST(floor(value * 1000) AS BIGINT) END AS s FROM events)""")
def _(v: Views):
    rows = v.table("events").select(F.when(c("event_id") % 10 != 0, F.floor(c("value") * 1000)).alias("size_bytes"), c("ts").alias("modified_at"))
    return history.container_summary(rows)


@query("jn2_history_with_findings", """
    SELECT ordinal, related_finding_id, related_risk, CAST(historical_score AS BIGINT) AS historical_score, effective_risk FROM history""", ("history",))
def _(v: Views):
    return v.history.select("ordinal", "related_finding_id", "related_risk", long("historical_score"), "effective_risk")


@query("agg5_merged_entries", """
    SELECT application_key, target_path, last_interaction, CAST(interactions AS BIGINT) AS interactions, pinned, exists_now AS exists, ordinal FROM merged_history""", ("merged_history",))
def _(v: Views):
    return v.merged_history.select("application_key", "target_path", "last_interaction", long("interactions"), "pinned", "exists", "ordinal")


@query("agg5_merged_entries_per_container", """
    SELECT app_id, path_match, max(last_interaction) AS last_interaction, CAST(max(interactions) AS BIGINT) AS interactions, bool_or(pinned) AS pinned
    FROM history GROUP BY app_id, path_match""", ("history",))
def _(v: Views):
    return history.merged(v.dealt_entries, "app_id").select("app_id", "path_match", "last_interaction", long("interactions"), "pinned")


@query("agg6_applications", f"""
    SELECT m.application_key, m.shown_name AS display_name, count(*) AS remembered, count(*) FILTER (NOT exists_now) AS missing,
           count(*) FILTER ({o.order_sql('effective_risk')} >= 3) AS sensitive, max(last_interaction) AS last_interaction,
           any_value(c.containers) AS containers, any_value(c.warnings) AS warnings
    FROM merged_history m JOIN (SELECT application_key, count(DISTINCT app_id) AS containers, count(DISTINCT CASE WHEN user_id % 15 = 3 THEN app_id END) AS warnings
                                FROM history_entries GROUP BY application_key) c USING (application_key)
    GROUP BY m.application_key, m.shown_name""", ("merged_history",))
def _(v: Views):
    return history.applications(v.merged_history, v.containers).select(
        "application_key", "display_name", "remembered", "missing", "sensitive", "last_interaction", "containers", "warnings")


@query("agg7_application_stats", f"""
    SELECT application_key, count(*) AS remembered, count(*) FILTER (NOT exists_now) AS missing,
           count(*) FILTER ({o.order_sql('effective_risk')} >= 3) AS sensitive, max(last_interaction) AS last_interaction
    FROM merged_history GROUP BY application_key""", ("merged_history",))
def _(v: Views):
    return history.stats(v.merged_history).select("application_key", "remembered", "missing", "sensitive", "last_interaction")


@query("agg8_application_scores", """
    SELECT application_key, round(avg(s), 6) AS application_score FROM (
      SELECT application_key, s, row_number() OVER (PARTITION BY application_key ORDER BY s DESC, ordinal) AS n
      FROM (SELECT application_key, ordinal, CASE WHEN ordinal % 3 > 0 THEN ordinal % 101 END AS s FROM history_entries) WHERE s IS NOT NULL)
    WHERE n <= 3 GROUP BY application_key""", ("history_entries",))
def _(v: Views):
    rows = history.identified(v.history_entries).withColumn("personal_score", F.when(c("ordinal") % 3 > 0, c("ordinal") % 101))
    return history.application_scores(rows).select("application_key", F.round("application_score", 6).alias("application_score"))


ORDERED = "(SELECT *, -count(*) OVER (PARTITION BY application_key) AS fewer FROM merged_history)"


@query("agg9_significant_history", f"""
    SELECT lower(path_match) AS path_match, CAST(max(historical_score) AS BIGINT) AS exposure_score, CAST(arg_min(interactions, (-historical_score, fewer, shown_name)) AS BIGINT) AS interactions,
           string_agg(shown_name, ', ' ORDER BY fewer, shown_name) AS applications,
           CASE WHEN arg_min(exists_now, (-historical_score, fewer, shown_name)) THEN 'Remembered path outside the current audit' ELSE 'Historical path to a missing object' END AS subcategory
    FROM {ORDERED} WHERE related_finding_id IS NULL AND historical_score >= 30 GROUP BY path_match""", ("merged_history",))
def _(v: Views):
    return history.significant(v.merged_history).select(
        F.lower("path").alias("path_match"), long("exposure_score"), c("history_interactions").cast("long").alias("interactions"),
        c("history_refs").alias("applications"), "subcategory")


@query("agg10_history_context", f"""
    SELECT related_finding_id AS finding_id, string_agg(shown_name, ', ' ORDER BY fewer, shown_name) AS history_refs, max(last_interaction) AS history_last_seen,
           CAST(max(interactions) AS BIGINT) AS history_interactions
    FROM {ORDERED} WHERE related_finding_id IS NOT NULL GROUP BY related_finding_id""", ("merged_history",))
def _(v: Views):
    return history.finding_context(v.merged_history).select("finding_id", "history_refs", "history_last_seen", long("history_interactions"))


@query("jn12_findings_with_history", """
    SELECT f.finding_id, h.seen AS history_last_seen, h.n AS history_interactions FROM findings f LEFT JOIN (
      SELECT related_finding_id, max(last_interaction) AS seen, CAST(max(interactions) AS BIGINT) AS n FROM merged_history GROUP BY related_finding_id) h
    ON f.finding_id = h.related_finding_id""", ("merged_history", "findings"))
def _(v: Views):
    rows = joins.with_history_context(v.findings, history.finding_context(v.merged_history))
    return rows.select("finding_id", "history_last_seen", long("history_interactions"))


@query("jn5_unknown_history", """
    SELECT DISTINCT path_match FROM merged_history WHERE related_finding_id IS NULL AND historical_score >= 30 AND NOT contains(path_match, 'tax_')""", ("merged_history",))
def _(v: Views):
    significant = history.significant(v.merged_history)
    known = significant.filter(F.contains(c("path"), F.lit("tax_"))).select(F.upper("path").alias("path"), "scanner_id")
    return joins.unknown_history(significant, known).select(F.lower("path").alias("path_match"))


@query("flt15_history_view", f"""
    SELECT ordinal FROM merged_history WHERE exists_now AND NOT pinned AND {o.order_sql('effective_risk')} >= 3 AND NOT is_dir AND size_bytes >= 102400
      AND target_modified_at IS NOT NULL AND date_diff('day', target_modified_at, {o.DAY0}) <= 365.25
      AND (contains(lower(target_path), 'user') OR contains(lower(application_name), 'user'))""", ("merged_history",))
def _(v: Views):
    return v.merged_history.filter(filters.history_view(AS_OF, "Available", "NotPinned", "Important", 1, 3, "USER")).select("ordinal")


@query("flt15_missing_without_risk", f"""
    SELECT ordinal FROM merged_history WHERE NOT exists_now AND {o.order_sql('effective_risk')} > 0 AND pinned IN (true, false)
    UNION ALL SELECT ordinal FROM merged_history WHERE pinned AND {o.order_sql('effective_risk')} = 0""", ("merged_history",))
def _(v: Views):
    """No entry has a risk and none, so both filters are one over a single pass."""
    missing = filters.history_view(AS_OF, "Missing", risk_filter="Finding")
    calm = filters.history_view(AS_OF, pinned="Pinned", risk_filter="None")
    return v.merged_history.filter(missing | calm).select("ordinal")


@query("srt5_history_order", f"""
    SELECT ordinal, row_number() OVER (ORDER BY {PRIORITY} DESC, {o.order_sql('effective_risk')} DESC, last_interaction DESC, path_match, ordinal) AS position
    FROM merged_history QUALIFY position <= 200""", ("merged_history",))
def _(v: Views):
    rows = positions(v.merged_history, "ordinal", *history.entry_order())
    return rows.filter("position < 200").select("ordinal", (c("position") + 1).alias("position"))


@query("srt6_application_order", f"""
    SELECT application_key, row_number() OVER (ORDER BY max({PRIORITY}) DESC, max({o.order_sql('effective_risk')}) DESC, max(last_interaction) DESC, lower(shown_name)) AS position
    FROM merged_history GROUP BY application_key, shown_name""", ("merged_history",))
def _(v: Views):
    rows = with_positions(history.stats(v.merged_history), *history.application_order())
    return rows.select("application_key", (c("position") + 1).alias("position"))


@query("scl24_effective_risk", "SELECT effective_risk, count(*) AS entries FROM history GROUP BY effective_risk", ("history",))
def _(v: Views):
    return v.history.groupBy("effective_risk").agg(F.count(F.lit(1)).alias("entries"))


@query("scl25_history_findings", f"""
    SELECT h.ordinal, coalesce(f.scanner_id, 'application-history') AS scanner_id,
           CASE WHEN f.finding_id IS NOT NULL THEN f.category WHEN h.is_dir THEN 'Directory' ELSE {o.class_sql(o.extension('h.target_path'))} END AS category,
           CASE WHEN f.finding_id IS NOT NULL THEN f.subcategory WHEN h.exists_now THEN 'Remembered by an application' ELSE 'Historical path' END AS subcategory,
           coalesce(f.path, h.target_path) AS path, CASE WHEN f.finding_id IS NOT NULL THEN f.modified_at ELSE coalesce(h.target_modified_at, h.last_interaction) END AS modified_at,
           CAST(coalesce(f.exposure_score, h.historical_score) AS BIGINT) AS exposure_score
    FROM history h LEFT JOIN findings f ON h.related_finding_id = f.finding_id""", ("history", "findings"))
def _(v: Views):
    return history.entry_findings(v.history, v.remembered).select(
        "ordinal", "scanner_id", "category", "subcategory", "path", "modified_at", long("exposure_score"))


@query("set4_flattened_applications", "SELECT application_key, ordinal FROM history_entries", ("history_entries",))
def _(v: Views):
    """Nested a thousand entries at a time: lists stay as short however many entries an application has."""
    rows = history.identified(v.history_entries).withColumn("share", F.expr("ordinal div 1000"))
    nested = rows.groupBy("application_key", "share").agg(F.collect_list(F.struct("ordinal")).alias("entries"))
    return history.flattened(nested).select("application_key", "ordinal")


@query("scl21_history_feedback_keys", """
    SELECT ordinal, 'APPLICATION-HISTORY|' || upper(application_key) || '|' || upper(target_path) AS feedback_key FROM history_entries""", ("history_entries",))
def _(v: Views):
    from tracelake.functions import paths

    rows = history.identified(v.history_entries)
    return rows.select("ordinal", paths.history_feedback_key(c("application_key"), c("target_path")).alias("feedback_key"))
