"""Queries over the inventory, the findings and their scalar columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.functions import paths, scalars
from tracelake.operators import filters, joins, ordering
from tracelake.plans import oracle as o
from tracelake.plans.registry import query
from tracelake.plans.views import AS_OF, Views
from tracelake.sources import inventory as inv

c = F.col
STEP_ROWS = "(SELECT *, ordinal % 12 - 1 AS step FROM findings)"


@query("src2_file_findings", """
    SELECT finding_id, path, category, subcategory, display_name, CAST(exposure_score AS BIGINT) AS exposure_score, reasons
    FROM findings""", ("findings",))
def _(v: Views):
    return v.findings.select("finding_id", "path", "category", "subcategory", "display_name",
                             c("exposure_score").cast("long").alias("exposure_score"),
                             scalars.reason_text("exposure_reasons").alias("reasons"))


@query("src3_development_directories", f"""
    SELECT DISTINCT regexp_extract(path, '^.*\\\\(node_modules|\\.venv)') AS path, regexp_extract(path, '\\\\(node_modules|\\.venv)\\\\', 1) AS display_name,
           CAST(10 AS BIGINT) AS exposure_score
    FROM inventory WHERE regexp_matches(path, '\\\\(node_modules|\\.venv)\\\\')""", ("inventory",))
def _(v: Views):
    return inv.development_directories(v.inventory).select("path", "display_name", c("exposure_score").cast("long").alias("exposure_score"))


SHORTCUTS = f"""(SELECT doc_id, 'C:\\Recent\\link' || doc_id || (CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.lnk' END) AS path,
    CASE WHEN doc_id % 4 <> 3 THEN upper({o.path_sql('(doc_id * 2)')}) END AS target FROM documents)"""


@query("src6_recent_references", f"""
    SELECT s.path, CASE WHEN s.path LIKE '%.txt' THEN 'Reference' WHEN i.path IS NOT NULL THEN 'Shortcut reference'
             ELSE 'Stale shortcut reference' END AS subcategory,
           concat_ws('; ', 'Present in Windows Recent', CASE WHEN s.path LIKE '%.txt' OR s.target IS NULL THEN NULL
             WHEN i.path IS NOT NULL THEN 'Shortcut target is available: ' || s.target
             ELSE 'Shortcut target is no longer available: ' || s.target END) AS reasons
    FROM {SHORTCUTS} s LEFT JOIN inventory i ON lower(s.target) = lower(i.path)""", ("inventory",))
def _(v: Views):
    from tracelake.plans.views import file_path

    n = c("doc_id")
    links = v.documents.select(
        F.concat(F.lit("C:\\Recent\\link"), n.cast("string"),
                 F.when(n % 3 == 0, F.lit(".txt")).otherwise(F.lit(".lnk"))).alias("path"),
        F.when(n % 4 != 3, F.upper(file_path(n * 2))).alias("target"), n.alias("size_bytes"),
        F.lit(AS_OF).alias("modified_at"))
    return inv.recent_references(links, v.inventory).select(
        "path", "subcategory", scalars.reason_text("exposure_reasons").alias("reasons"))


@query("src7_user_profiles", """
    SELECT DISTINCT regexp_extract(path, '^C:\\\\Users\\\\[^\\\\]+') AS path, regexp_extract(path, 'Users\\\\([^\\\\]+)', 1) AS display_name
    FROM inventory""", ("inventory",))
def _(v: Views):
    return inv.user_profiles(v.inventory).select("path", "display_name")


@query("scl1_file_class", f"SELECT finding_id, {o.class_sql(o.extension('path'))} AS file_class FROM inventory", ("inventory",))
def _(v: Views):
    return v.inventory.select("finding_id", paths.file_class("path").alias("file_class"))


MONTHS = f"(epoch_us({o.DAY0}) - epoch_us(modified_at)) / CAST(86400000000 AS DOUBLE) / CAST(30.4375 AS DOUBLE)"


@query("scl2_age_class", f"""
    SELECT finding_id, CASE WHEN modified_at IS NULL THEN 'Unknown' WHEN {MONTHS} < 6 THEN '< 6 months' WHEN {MONTHS} < 12 THEN '6–12 months'
        WHEN {MONTHS} < 24 THEN '1–2 years' WHEN {MONTHS} < 36 THEN '2–3 years' WHEN {MONTHS} < 60 THEN '3–5 years' ELSE '> 5 years' END AS age_class
    FROM inventory""", ("inventory",))
def _(v: Views):
    return v.inventory.select("finding_id", scalars.age_class("modified_at", AS_OF).alias("age_class"))


@query("scl3_human_bytes", f"SELECT finding_id, {o.bytes_sql('size_bytes')} AS size_text FROM inventory", ("inventory",))
def _(v: Views):
    return v.inventory.select("finding_id", scalars.human_bytes("size_bytes").alias("size_text"))


@query("scl4_risk_level", f"SELECT finding_id, {o.level_sql('exposure_score')} AS risk_level FROM findings", ("findings",))
def _(v: Views):
    return v.findings.select("finding_id", scalars.risk_level("exposure_score").alias("risk_level"))


@query("scl5_path_exposure", f"""
    SELECT finding_id, CAST({o.exposure_sql('path')} AS BIGINT) AS exposure_score, {o.reasons_sql('path')} AS reasons FROM inventory""", ("inventory",))
def _(v: Views):
    items = paths.path_exposure_items("path")
    return v.inventory.select("finding_id", paths.exposure_score(items).cast("long").alias("exposure_score"),
                              scalars.reason_text(paths.exposure_reasons(items)).alias("reasons"))


@query("scl6_path_keys", """
    SELECT finding_id, upper(path) AS path_key, lower(path) AS match_key,
           'APPLICATION-HISTORY|WORD|' || upper(path) AS history_key FROM inventory""", ("inventory",))
def _(v: Views):
    slashed = F.concat("path", F.lit("\\"))
    return v.inventory.select("finding_id", paths.path_key(slashed).alias("path_key"),
                              paths.match_key(slashed).alias("match_key"),
                              paths.history_feedback_key(F.lit("Word"), slashed).alias("history_key"))


KIND_WHENS = " ".join(f"WHEN contains(lower(path), '\\{k.lower()}\\') THEN '{k}'" for k in fixed.DIRECTORY_KINDS)


@query("scl8_directory_kind", f"SELECT finding_id, CASE {KIND_WHENS} ELSE 'Other' END AS directory_kind FROM inventory", ("inventory",))
def _(v: Views):
    return v.inventory.select("finding_id", paths.directory_kind("path").alias("directory_kind"))


DEPTH = "(len(string_split(path, '\\')) - 2)"


@query("scl9_path_shape", f"""
    SELECT finding_id, 'USERPROFILE / ' || array_to_string(list_transform(range(0, least(6, {DEPTH})), lambda i: 'directory'), ' / ')
        || (CASE WHEN {DEPTH} > 6 THEN ' / …' ELSE '' END) || ' / file' || {o.extension('path')} AS path_shape
    FROM inventory""", ("inventory",))
def _(v: Views):
    return v.inventory.select("finding_id", paths.path_shape("path", F.lit(False)).alias("path_shape"))


BUCKET = """CASE WHEN size_bytes < 10240 THEN '0–10 KB' WHEN size_bytes < 102400 THEN '10–100 KB' WHEN size_bytes < 1048576 THEN '100 KB–1 MB'
    WHEN size_bytes < 10485760 THEN '1–10 MB' WHEN size_bytes < 104857600 THEN '10–100 MB' WHEN size_bytes < 1073741824 THEN '100 MB–1 GB'
    ELSE '1 GB or larger' END"""
SCORES = """CASE WHEN exposure_score < 20 THEN '0–19' WHEN exposure_score < 40 THEN '20–39' WHEN exposure_score < 60 THEN '40–59'
    WHEN exposure_score < 80 THEN '60–79' ELSE '80–100' END"""


@query("scl10_buckets", f"""
    SELECT finding_id, {BUCKET} AS size_range, {SCORES} AS score_range, {o.extension('path')} AS safe_extension,
           regexp_replace(subcategory || ' / ' || ordinal, '[^A-Za-z0-9 _\\-/.]', '', 'g') AS label
    FROM findings""", ("findings",))
def _(v: Views):
    return v.findings.select(
        "finding_id", scalars.size_bucket("size_bytes").alias("size_range"),
        scalars.score_bucket("exposure_score").alias("score_range"), paths.safe_extension("path").alias("safe_extension"),
        scalars.safe_label(F.concat_ws(" / ", F.concat("subcategory", F.lit("é#")), c("ordinal").cast("string")), "none").alias("label"))


@query("scl14_incorrect_detection_report", f"""
    SELECT finding_id, 'Incorrect detection: ' || regexp_replace(category, '[^A-Za-z0-9 _\\-/.]', '', 'g') AS title,
           category || ' / ' || subcategory AS detected,
           ['Wrong finding', 'Wrong file origin', 'Wrong risk level', 'Other'][ordinal % 4 + 1] AS correction,
           CASE WHEN is_directory THEN '[directory]' ELSE ext END AS extension,
           CASE WHEN is_directory THEN 'not applicable' ELSE {BUCKET} END AS size_range, {SCORES} AS score_range,
           scanner_id AS scanner, 'Windows 10.0' AS os_version,
           'incorrect-detection,' || ['wrong-finding', 'wrong-file-origin', 'wrong-risk-level', 'other-inaccuracy'][ordinal % 4 + 1] AS labels
    FROM findings JOIN documents ON doc_id = ordinal WHERE length(trim(source || ' ' || lang)) BETWEEN 10 AND 1000
       OR length('explained by ' || source) BETWEEN 10 AND 1000 AND ordinal % 2 = 0""", ("findings",))
def _(v: Views):
    n = c("ordinal")
    told = F.when(n % 2 == 0, F.concat(F.lit("explained by "), c("source"))).otherwise(F.concat_ws(" ", "source", "lang"))
    rows = v.findings.join(v.documents.select(c("doc_id").alias("ordinal"), "source", "lang"), "ordinal")
    fix = F.get(F.array(*[F.lit(x) for x in ("Wrong finding", "Wrong file origin", "Wrong risk level", "Other")]), (n % 4).cast("int"))
    report = scalars.report_columns(fix, told, F.lit("1.0.0"), F.lit("Microsoft Windows NT 10.0.22631.0"))
    kept = ["title", "detected", "correction", "extension", "size_range", "score_range", "scanner", "os_version", "labels"]
    return rows.filter(scalars.explanation_is_valid(told)).select("finding_id", *[report[k].alias(k) for k in kept])


@query("scl15_historical_risk", """
    SELECT ordinal, CAST(historical_score AS BIGINT) AS historical_score FROM history WHERE related_finding_id IS NULL""", ("history",))
def _(v: Views):
    return v.history.filter("related_finding_id is null").select("ordinal", paths.historical_risk("target_path").cast("long").alias("historical_score"))


@query("scl16_application_identity", """
    SELECT ordinal, app_id, shown_name AS display_name, known IS NOT NULL AS known FROM history_entries""", ("history_entries",))
def _(v: Views):
    from tracelake.operators import history

    return history.identified(v.history_entries).select("ordinal", "app_id", "display_name", "known")


RES = ["AnyResolution"] + [f"ResolutionGte{n}" for n, _ in fixed.RESOLUTION_STEPS[1:]]
BELOW = ["AnyResolution"] + [f"ResolutionLt{n}" for n, _ in fixed.RESOLUTION_STEPS[1:]]


@query("scl17_step_labels", f"""
    SELECT finding_id, CASE WHEN s BETWEEN 0 AND 9 THEN {o.sql_list([n for n, _ in fixed.SIZE_STEPS])}[s + 1] ELSE 'AnySize' END AS size_key,
           CASE WHEN abs(s) >= 10 THEN 'AnyResolution' WHEN s < 0 THEN {o.sql_list(BELOW)}[abs(s) + 1] ELSE {o.sql_list(RES)}[s + 1] END AS resolution_key,
           CASE WHEN s BETWEEN 0 AND 8 THEN {o.sql_list([r[0] for r in fixed.AGE_STEPS])}[s + 1] ELSE 'AnyAge' END AS age_key
    FROM (SELECT finding_id, ordinal % 25 - 12 AS s FROM inventory)""", ("inventory",))
def _(v: Views):
    step = (c("ordinal") % 25 - 12).cast("int")
    return v.inventory.select("finding_id", scalars.size_step_label(step).alias("size_key"),
                              scalars.resolution_step_label(step).alias("resolution_key"),
                              scalars.age_step_label(step).alias("age_key"))


TICKS = "(epoch_us({}) * 10 + 621355968000000000)"


@query("scl18_audit_identity", f"""
    SELECT scan_id, 'v2:' || {TICKS.format('started_at')} || ':' || {TICKS.format("finished_at + INTERVAL 1 HOUR")} AS identity,
           CAST(scan_id AS BIGINT) % 3 <> 2 AS matched
    FROM scans""", ("scans",))
def _(v: Views):
    n = c("scan_id").cast("long")
    start, end = c("started_at"), c("finished_at") + F.expr("INTERVAL 1 HOUR")
    rows = v.scans.withColumn("identity", scalars.audit_identity(start, end))
    old = F.concat_ws(":", scalars.ticks(start).cast("string"), scalars.ticks(end).cast("string"), F.lit("17"))
    candidate = F.when(n % 3 == 0, c("identity")).when(n % 3 == 1, old).otherwise(F.lit("1:2:3"))
    return rows.select("scan_id", "identity", scalars.audit_identity_matches(candidate, start, end).alias("matched"))


@query("scl20_video_sample_offsets", """
    SELECT ordinal, unnest(CASE WHEN d <= 0 THEN [1000, 3000] WHEN d < 2000 THEN [d // 2] WHEN d <= 5000 THEN [d // 4, d * 3 // 4]
                             ELSE [1000, d // 2] END) AS offset_ms
    FROM (SELECT event_id AS ordinal, CAST(floor(value * 100) AS BIGINT) AS d FROM events)""")
def _(v: Views):
    duration = F.floor(c("value") * 100)
    return v.table("events").select(c("event_id").alias("ordinal"), F.explode(scalars.sample_offsets_ms(duration)).alias("offset_ms"))


@query("scl22_tile_page_size", f"""
    SELECT ordinal, least(600, greatest(72, {o.even('240 * pow(140 / t, 2)')})) AS page_size
    FROM (SELECT event_id AS ordinal, least(260, greatest(80, value * 3)) AS t FROM events)""")
def _(v: Views):
    return v.table("events").select(c("event_id").alias("ordinal"), scalars.tile_page_size(c("value") * 3).cast("long").alias("page_size"))


@query("flt1_size_steps", """
    SELECT s.step, count(*) AS kept FROM findings, (SELECT unnest(range(0, 11)) AS step) s
    WHERE s.step IN (0, 10) OR size_bytes >= [102400, 512000, 1048576, 5242880, 20971520, 104857600, 524288000, 1073741824, 5368709120][s.step]
    GROUP BY s.step""", ("findings",))
def _(v: Views):
    counts = v.findings.agg(*[F.count_if(filters.size_at_least(s)).alias(str(s)) for s in range(11)])
    return (counts.unpivot([], [str(s) for s in range(11)], "step", "kept")
            .select(c("step").cast("long").alias("step"), "kept").filter("kept > 0"))


@query("flt2_resolution_steps", f"""
    SELECT step, count(*) AS kept FROM (SELECT CAST(unnest(range(-10, 11)) AS BIGINT) AS step), image_statistics
    WHERE step IN (0, 10, -10) OR (step > 0 AND width * height * (vec_id % 30) >= [300000, 1000000, 2000000, 5000000, 8000000, 12000000, 20000000, 33000000, 50000000][step] AND vec_id % 30 > 0)
       OR (step < 0 AND vec_id % 30 > 0 AND width * height * (vec_id % 30) < [300000, 1000000, 2000000, 5000000, 8000000, 12000000, 20000000, 33000000, 50000000][-step])
    GROUP BY step""", ("image_statistics",))
def _(v: Views):
    rows = v.image_statistics.withColumn("width", c("width") * (c("vec_id") % 30))
    steps = list(range(-10, 11))
    counts = rows.agg(*[F.count_if(filters.resolution(s)).alias(str(s)) for s in steps])
    return (counts.unpivot([], [str(s) for s in steps], "step", "kept")
            .select(c("step").cast("long").alias("step"), "kept").filter("kept > 0"))


DAYS = f"greatest(0, date_diff('day', coalesce(modified_at, created_at), {o.DAY0}))"


@query("flt3_age_steps", f"""
    SELECT step, count(*) AS kept FROM findings, (SELECT unnest(range(0, 10)) AS step)
    WHERE step = 0 OR (coalesce(modified_at, created_at) IS NOT NULL AND CASE step WHEN 1 THEN {DAYS} <= 30.5 WHEN 2 THEN {DAYS} <= 182.5
      WHEN 3 THEN {DAYS} <= 365.25 WHEN 4 THEN {DAYS} > 182.5 WHEN 5 THEN {DAYS} > 365.25 WHEN 6 THEN {DAYS} > 730.5
      WHEN 7 THEN {DAYS} > 1095.75 WHEN 8 THEN {DAYS} > 1826.25 ELSE true END)
    GROUP BY step""", ("findings",))
def _(v: Views):
    counts = v.findings.agg(*[F.count_if(filters.age(s, AS_OF)).alias(str(s)) for s in range(10)])
    return (counts.unpivot([], [str(s) for s in range(10)], "step", "kept")
            .select(c("step").cast("long").alias("step"), "kept").filter("kept > 0"))


@query("flt4_text_search", "SELECT finding_id, path FROM findings WHERE contains(lower(path), 'passport') OR contains(lower(display_name), 'passport')", ("findings",))
def _(v: Views):
    return v.findings.filter(filters.search("PassPort")).select("finding_id", "path")


@query("flt5_risk_level", f"SELECT finding_id, CAST(exposure_score AS BIGINT) AS exposure_score FROM findings WHERE {o.level_sql('exposure_score')} = 'High'", ("findings",))
def _(v: Views):
    return v.findings.filter(filters.risk("high")).select("finding_id", c("exposure_score").cast("long").alias("exposure_score"))


@query("flt6_virtual_categories", """
    SELECT 'PII' AS category, count(*) AS kept FROM audited WHERE pii_total > 0 UNION ALL
    SELECT 'Secrets', count(*) FROM audited WHERE sec_total > 0 UNION ALL SELECT 'Configs', count(*) FROM audited WHERE cfg_is UNION ALL
    SELECT 'Identity', count(*) FROM audited WHERE idt_total > 0 UNION ALL SELECT 'Archives', count(*) FROM audited WHERE arc_sensitive > 0 UNION ALL
    SELECT 'Images', count(*) FROM audited WHERE category = 'Images'""", ("audited",))
def _(v: Views):
    names = ["PII", "Secrets", "Configs", "Identity", "Archives", "Images"]
    counts = v.audited.agg(*[F.count_if(filters.category(n)).alias(n) for n in names])
    return counts.unpivot([], names, "category", "kept")


@query("flt7_exposure_only", "SELECT finding_id FROM findings WHERE exposure_score >= 40 OR category IN ('Recent', 'Jump Lists')", ("findings",))
def _(v: Views):
    return v.findings.filter(filters.exposure_only()).select("finding_id")


@query("flt8_recommended_only", "SELECT finding_id FROM audited WHERE personal_score >= 60", ("audited",))
def _(v: Views):
    return v.audited.filter(filters.recommended_only()).select("finding_id")


@query("flt9_finding_view", f"""
    SELECT finding_id FROM audited WHERE NOT ignored AND contains(lower(path), 'user') AND exposure_score >= 40 AND size_bytes >= 102400
      AND coalesce(modified_at, created_at) IS NOT NULL AND {DAYS} > 182.5""", ("audited",))
def _(v: Views):
    return v.audited.filter(filters.finding_view(AS_OF, text="USER", exposed=True, size_step=1, age_step=4)).select("finding_id")


NOT_EXCLUDED = "SELECT finding_id FROM inventory i WHERE NOT EXISTS (SELECT 1 FROM exclusions e WHERE starts_with(lower(i.path), lower(e.path)))"


@query("flt10_exclusions", NOT_EXCLUDED, ("inventory", "exclusions"))
def _(v: Views):
    return v.not_excluded.select("finding_id")


@query("jn9_exclusions_by_prefix_join", NOT_EXCLUDED, ("inventory", "exclusions"))
def _(v: Views):
    return joins.not_excluded(v.inventory, v.exclusions).select("finding_id")


@query("flt11_media_scope", "SELECT category, count(*) AS kept FROM findings WHERE category IN ('Images', 'Video') GROUP BY category", ("findings",))
def _(v: Views):
    return v.findings.filter(filters.media_scope(True, True)).groupBy("category").agg(F.count(F.lit(1)).alias("kept"))


MEDIA_VIEWS = {
    "AllMedia": "media", "GeoExif": "exif_fields > 0", "GpsOnly": "exif_gps", "Documents": "doc_is",
    "NSFW": "category = 'Images' AND saf_status = 'Completed' AND nsfw > 0.85", "People": "category = 'Images' AND ppl_seen",
    "NoPeople": "category = 'Images' AND ppl_status = 'Completed' AND NOT ppl_seen", "Errors": "category = 'Images' AND ppl_status = 'Error'",
    "Unscanned": "category = 'Images' AND ppl_status IS NULL",
}


@query("flt12_media_views", " UNION ALL ".join(
    f"SELECT '{k}' AS view_name, count(*) AS kept FROM audited WHERE {w}" for k, w in MEDIA_VIEWS.items()), ("audited",))
def _(v: Views):
    names = list(MEDIA_VIEWS)
    counts = v.audited.agg(*[F.count_if(filters.media_view(n, True, n == "AllMedia")).alias(n) for n in names])
    return counts.unpivot([], names, "view_name", "kept")


@query("flt14_high_confidence_unsafe", "SELECT finding_id FROM audited WHERE saf_status = 'Completed' AND nsfw > 0.85", ("audited",))
def _(v: Views):
    return v.audited.filter(filters.high_confidence_unsafe()).select("finding_id")


@query("flt16_candidates", f"""
    SELECT 'pii' AS detector, count(*) AS kept FROM findings WHERE NOT ignored AND ext IN {o.in_list(fixed.PLAIN_TEXT_EXTENSIONS + fixed.OFFICE_EXTENSIONS)}
    UNION ALL SELECT 'configs', count(*) FROM findings WHERE NOT ignored AND ext IN {o.in_list(sorted(set(fixed.PLAIN_TEXT_EXTENSIONS + fixed.OFFICE_EXTENSIONS + fixed.CONFIG_EXTENSIONS)))}
    UNION ALL SELECT 'archives', count(*) FROM findings WHERE NOT ignored AND ext = '.zip'
    UNION ALL SELECT 'documents', count(*) FROM findings WHERE NOT ignored AND category = 'Images'
    UNION ALL SELECT 'people', count(*) FROM findings WHERE NOT ignored AND category IN ('Images', 'Video')
    UNION ALL SELECT 'exif', count(*) FROM findings WHERE NOT ignored AND ext IN {o.in_list(fixed.METADATA_EXTENSIONS)}""", ("findings",))
def _(v: Views):
    names = ["pii", "configs", "archives", "documents", "people", "exif"]
    counts = v.findings.agg(*[F.count_if(filters.candidates(n)).alias(n) for n in names])
    return counts.unpivot([], names, "detector", "kept")


@query("flt17_not_completed", " UNION ALL ".join(
    f"SELECT '{k}' AS scanner, count(*) AS pending FROM audited WHERE NOT done_{k}" for k in fixed.SCANNER_KEYS), ("audited",))
def _(v: Views):
    counts = v.audited.agg(*[F.count_if(filters.not_completed(k)).alias(k) for k in fixed.SCANNER_KEYS])
    return counts.unpivot([], fixed.SCANNER_KEYS, "scanner", "pending")


@query("srt2_initial_order", """
    SELECT finding_id, CAST(exposure_score AS BIGINT) AS exposure_score, size_bytes, ordinal FROM findings""", ("findings",))
def _(v: Views):
    return v.findings.select("finding_id", c("exposure_score").cast("long").alias("exposure_score"), "size_bytes", "ordinal").orderBy(*ordering.initial_order())
