"""Queries that join, aggregate and deduplicate the audit tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.functions import paths
from tracelake.operators import aggregates, joins, media, ordering
from tracelake.plans import oracle as o
from tracelake.plans.registry import query
from tracelake.plans.views import AS_OF, Views, file_path

c = F.col
LATEST = "(SELECT * FROM feedback QUALIFY row_number() OVER (PARTITION BY path_key ORDER BY updated_at DESC, finding_id) = 1)"


@query("jn1_findings_with_feedback", f"""
    SELECT f.finding_id, r.label AS personal_label FROM findings f LEFT JOIN {LATEST} r ON upper(f.path) = r.path_key""", ("findings", "feedback"))
def _(v: Views):
    return joins.with_feedback(v.findings, v.feedback).select("finding_id", "personal_label")


@query("jn3_results_to_findings", """
    SELECT f.finding_id, CAST(r.faces AS BIGINT) AS face_count FROM (
      SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY ordinal) = 1) f
    JOIN (SELECT lower(path) AS p, ordinal % 4 AS faces FROM inventory WHERE ordinal % 3 <> 0) r ON lower(f.path) = r.p""", ("findings",))
def _(v: Views):
    results = v.inventory.filter("ordinal % 3 <> 0").select(F.upper("path").alias("path"), (c("ordinal") % 4).alias("face_count"))
    return joins.matched_results(v.findings, results).select("finding_id", "face_count")


@query("jn4_session_findings", "SELECT finding_id FROM findings WHERE ordinal % 4 = 1", ("findings",))
def _(v: Views):
    return joins.in_session(v.findings, v.inventory.filter("ordinal % 4 = 1")).select("finding_id")


@query("jn6_reusable_results", """
    SELECT media_id, s.people_detected FROM media m JOIN stored_results s ON lower(m.path) = lower(s.path) AND m.file_size = s.file_size
      AND m.file_modified_at = s.file_modified_at AND m.model_version = s.model_version AND s.status = 'Completed'""", ("media", "stored_results"))
def _(v: Views):
    return media.reusable(v.media, v.stored_results).select("media_id", "people_detected")


@query("jn6_media_to_detect", """
    SELECT media_id FROM media m WHERE NOT EXISTS (SELECT 1 FROM stored_results s WHERE lower(m.path) = lower(s.path) AND m.file_size = s.file_size
      AND m.file_modified_at = s.file_modified_at AND m.model_version = s.model_version AND s.status = 'Completed')""", ("media", "stored_results"))
def _(v: Views):
    return media.to_detect(v.media, v.stored_results).select("media_id")


EVIDENCE_ROWS = "(SELECT 'f' || lpad(CAST(event_id % 300 AS VARCHAR), 10, '0') AS provenance_id, event_id FROM events)"


@query("jn8_orphan_evidence", f"""
    SELECT event_id FROM {EVIDENCE_ROWS} e WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.finding_id = e.provenance_id)""", ("findings",))
def _(v: Views):
    rows = v.table("events").select(F.concat(F.lit("f"), F.lpad((c("event_id") % 300).cast("string"), 10, "0")).alias("provenance_id"), "event_id")
    return joins.orphan_evidence(rows, v.findings).select("event_id")


@query("jn15_without_deleted", "SELECT finding_id FROM findings WHERE ordinal % 6 <> 2", ("findings",))
def _(v: Views):
    return joins.without_deleted(v.findings, v.inventory.filter("ordinal % 6 = 2")).select("finding_id")


@query("jn14_evolution_events", f"""
    SELECT f.finding_id, upper(f.path) AS path_key, r.label FROM findings f JOIN {LATEST.replace('FROM feedback', 'FROM feedback WHERE schema_version = 2')} r
      ON upper(f.path) = r.path_key""", ("findings", "feedback"))
def _(v: Views):
    rows = v.findings.withColumn("feature_json", F.to_json(F.struct("exposure_score")))
    events = joins.evolution_events(rows, v.feedback, "PiiScanCompleted", F.lit(AS_OF), fixed.FEATURE_SCHEMA_VERSION)
    return events.select("finding_id", "path_key", "label")


@query("jn13_training_rows", """
    SELECT r.path_key, f.finding_id IS NOT NULL AS refreshed, CAST(coalesce(f.exposure_score, 7) AS BIGINT) AS exposure
    FROM feedback r LEFT JOIN (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY upper(path) ORDER BY ordinal) = 1) f ON upper(f.path) = r.path_key""",
       ("findings", "feedback"))
def _(v: Views):
    current = joins.first_by_path(v.findings).select("path_key", F.struct(c("exposure_score").cast("long").alias("exposure")).alias("features"))
    rows = joins.training_rows(v.feedback.withColumn("feature_json", F.lit('{"exposure":7}')), current,
                               F.from_json("feature_json", "struct<exposure:bigint>"))
    return rows.select("path_key", "refreshed", c("features.exposure").alias("exposure"))


@query("jn16_saved_similar_matches", """
    SELECT f.finding_id AS query_id, g.finding_id, g.path FROM findings f JOIN findings g ON g.ordinal IN (f.ordinal + 1, f.ordinal + 2)
    WHERE f.ordinal % 3 = 0""", ("findings",))
def _(v: Views):
    n = c("ordinal")
    match = [F.struct(F.upper(file_path(n + i)).alias("path"), F.lit(0.5).alias("score"), F.lit("x").alias("details")) for i in (1, 2)]
    saved = v.findings.filter("ordinal % 3 = 0").select("finding_id", F.struct(F.array(*match).alias("matches")).alias("similarity"))
    return joins.saved_matches(saved, v.findings).select("query_id", "finding_id", "path")


@query("agg1_dashboard", f"""
    SELECT category, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, {o.bytes_sql('sum(size_bytes)')} AS size_text
    FROM findings WHERE NOT ignored GROUP BY category""", ("findings",))
def _(v: Views):
    return aggregates.dashboard(v.findings)


@query("agg3_media_counters", """
    SELECT count(*) FILTER (ppl_status IS NOT NULL) AS records, count(*) FILTER (ppl_status = 'Completed' AND ppl_seen) AS people,
           count(*) FILTER (ppl_status = 'Completed' AND NOT ppl_seen) AS no_people, count(*) FILTER (ppl_status = 'Error') AS errors
    FROM audited WHERE size_bytes >= 102400""", ("audited",))
def _(v: Views):
    from tracelake.operators import filters

    return aggregates.media_counters(v.audited.filter(filters.size_at_least(1)))


@query("agg11_model_stats", """
    SELECT *, total >= 20 AND positive >= 5 AND negative >= 5 AND least(positive, negative) / CAST(greatest(1, total) AS DOUBLE) >= 0.2 AS can_train
    FROM (SELECT count(*) AS total, count(*) FILTER (label) AS positive, count(*) FILTER (NOT label) AS negative FROM feedback WHERE schema_version = 2)""", ("feedback",))
def _(v: Views):
    return aggregates.feedback_stats(v.feedback)


@query("ml7_retrain_rule", """
    SELECT total, can_train, can_train AND total - 15 >= 10 AS retrain FROM (
    SELECT total, total >= 20 AND positive >= 5 AND total - positive >= 5 AND least(positive, total - positive) / CAST(total AS DOUBLE) >= 0.2 AS can_train
    FROM (SELECT count(*) AS total, count(*) FILTER (label) AS positive FROM feedback WHERE schema_version = 2))""", ("feedback",))
def _(v: Views):
    return aggregates.should_retrain(aggregates.feedback_stats(v.feedback), 15, True, False).select("total", "can_train", "retrain")


@query("agg16_category_list", """
    SELECT DISTINCT category FROM findings UNION SELECT 'Archives' FROM findings WHERE ext = '.zip'""", ("findings",))
def _(v: Views):
    return aggregates.category_list(v.findings)


@query("agg17_batch_results", """
    SELECT scanner_id, count(*) AS completed, count(*) FILTER (ordinal % 4 = 0) AS confirmed, count(*) FILTER (state = 'failed') AS errors
    FROM (SELECT ordinal, 'pii' AS scanner_id, ['completed', 'skipped', 'failed'][ordinal % 3 + 1] AS state FROM findings
          UNION ALL SELECT ordinal, 'exif', ['failed', 'completed'][ordinal % 2 + 1] FROM findings) GROUP BY scanner_id""", ("findings",))
def _(v: Views):
    rows = v.route_state.join(v.findings.select("finding_id", (c("ordinal") % 4 == 0).alias("confirmed")), "finding_id")
    return aggregates.batch_results(rows)


@query("win1_latest_feedback", f"SELECT path_key, label, updated_at FROM {LATEST}", ("feedback",))
def _(v: Views):
    return joins.latest_feedback(v.feedback).select("path_key", "label", "updated_at")


@query("win2_first_by_path", """
    SELECT finding_id, path_key FROM (SELECT finding_id, upper(regexp_replace(path, '[0-9]', '', 'g')) AS path_key, ordinal FROM findings)
    QUALIFY row_number() OVER (PARTITION BY path_key ORDER BY ordinal) = 1""", ("findings",))
def _(v: Views):
    return joins.first_by_path(v.findings.withColumn("path", F.regexp_replace("path", "[0-9]", ""))).select("finding_id", "path_key")


@query("win4_newest_events", "SELECT event_id AS id FROM events ORDER BY event_id DESC LIMIT 700")
def _(v: Views):
    return ordering.kept_by_rank(v.feature_events, 700, "id", ordering.By("id", True)).select("id")


@query("win4_oldest_feedback", "SELECT path_key FROM feedback ORDER BY updated_at ASC, path_key LIMIT 60", ("feedback",))
def _(v: Views):
    return ordering.kept_by_rank(v.feedback, 60, "path_key", ordering.By("updated_at"), ordering.By("path_key")).select("path_key")


@query("set2_distinct_paths", "SELECT arg_min(target_path, ordinal) AS target_path FROM history_entries GROUP BY lower(target_path)", ("history_entries",))
def _(v: Views):
    return aggregates.distinct_ignoring_case(v.history_entries, "target_path", "ordinal")


@query("set3_distinct_findings", "SELECT DISTINCT 'f' || lpad(regexp_extract(props, '([0-9]+)', 1), 10, '0') AS finding_id FROM events")
def _(v: Views):
    return v.feature_events.dropDuplicates(["finding_id"]).select("finding_id")


CUTOFF = f"({o.DAY0} - INTERVAL 9000 DAY)"
SCANNED = "(SELECT finding_id, CAST(ordinal * 7 AS VARCHAR) AS scan_id, modified_at FROM findings)"


def retention(v: Views):
    findings = v.findings.withColumn("scan_id", (c("ordinal") * 7).cast("string"))
    provenance = v.findings.select("finding_id", F.coalesce("created_at", F.lit(AS_OF).cast("timestamp_ntz")).alias("analyzed_at"))
    evidence = v.findings.select(c("finding_id").alias("provenance_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("kind"))
    days = 9000
    kept = ordering.retained(v.scans, findings, provenance, evidence, AS_OF, days)
    return kept


@query("ret1_scans_and_findings", f"""
    SELECT (SELECT count(*) FROM scans WHERE finished_at >= {CUTOFF}) AS scans,
           (SELECT count(*) FROM {SCANNED} f WHERE NOT EXISTS (SELECT 1 FROM scans s WHERE s.scan_id = f.scan_id AND s.finished_at < {CUTOFF})) AS findings""",
       ("scans", "findings"))
def _(v: Views):
    kept = retention(v)
    count = F.count(F.lit(1))
    return kept["scans"].agg(count.alias("scans")).withColumn("findings", kept["findings"].agg(count.alias("n")).scalar())


@query("ret1_provenance_and_evidence", f"""
    SELECT finding_id AS provenance_id, unnest(['a', 'b']) AS kind FROM findings WHERE coalesce(created_at, {o.DAY0}) >= ({o.DAY0} - INTERVAL 9000 DAY)""", ("findings",))
def _(v: Views):
    return retention(v)["evidence"].select("provenance_id", "kind")


@query("src11_events_of_path", f"SELECT event_id AS id, event_type FROM keyed_events WHERE upper({o.path_sql('k')}) = upper({o.path_sql('7')})", ("keyed_events",))
def _(v: Views):
    from tracelake.sources import store

    wanted = v.inventory.filter("ordinal = 7").select(paths.path_key("path")).scalar()
    return store.events_of(v.feature_events.filter(c("path_key") == wanted)).select("id", "event_type")
