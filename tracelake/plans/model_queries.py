"""Queries for the learned attention score."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import history, joins, learning
from tracelake.plans import oracle as o
from tracelake.plans.registry import query
from tracelake.plans.store_queries import scratch
from tracelake.plans.views import AS_OF, Views

c = F.col
EVIDENCE = ("pii", "secrets", "config", "identity", "archive", "document", "people", "image_safety", "exif")


def shown(names: list[str]):
    return [F.round(c(f"features.{n}").cast("double"), 3).alias(n) for n in names]


def age_sql(ts: str) -> str:
    return f"least(36500, greatest(0, coalesce(date_diff('day', {ts}, {o.DAY0}), 0)))"


def flag(x: str) -> str:
    return f"(CASE WHEN coalesce({x}, false) THEN 1 ELSE 0 END)"


KIND = " ".join(f"WHEN contains(lower(path), '\\{k.lower()}\\') THEN '{k}'" for k in o.fixed.DIRECTORY_KINDS)
FEATURES = {
    "ExposureScore": "exposure_score", "LogFileSize": "log10(greatest(1, size_bytes))", "FileAgeDays": age_sql("modified_at"),
    "PersonalDataMatches": "coalesce(pii_total, 0)", "SecretMatches": "coalesce(sec_total, 0)", "IdentityMentions": "coalesce(idt_total, 0)",
    "ArchiveSensitiveEntries": "coalesce(arc_sensitive, 0)", "DocumentConfidence": "coalesce(doc_conf, 0)", "FaceCount": "coalesce(ppl_faces, 0)",
    "ExifFieldCount": "coalesce(exif_fields, 0)", "IsSearchIndexed": flag("scanner_id = 'search-index'"), "CredentialConfigDetected": flag("cfg_is"),
    "IdentityTraceDetected": flag("idt_total > 0"), "IsArchive": flag("arc_sensitive >= 0"), "DocumentLike": flag("doc_is"),
    "PeopleDetected": flag("ppl_seen"), "HasGps": flag("exif_gps"), "HasExif": flag("exif_fields > 0"), "HasCameraSerial": flag("exif_serial <> ''"),
    "EntropySecretDetected": flag("sec_entropy"), "ScreenshotLike": flag("contains(lower(display_name), 'screenshot')"),
}
FEATURE_SQL = ", ".join(f"round(CAST(CAST({v} AS FLOAT) AS DOUBLE), 3) AS {k}" for k, v in FEATURES.items())


@query("ml1_finding_features", f"""
    SELECT finding_id, {FEATURE_SQL}, ext AS Extension, class AS FileCategory, CASE {KIND} ELSE 'Other' END AS DirectoryCategory FROM audited""", ("audited",))
def _(v: Views):
    rows = learning.with_features(v.audited, AS_OF)
    return rows.select("finding_id", *shown(list(FEATURES)), "features.Extension", "features.FileCategory", "features.DirectoryCategory")


def history_features(v: Views):
    rows = history.entry_findings(v.history, v.remembered, EVIDENCE)
    return learning.with_history_features(rows, AS_OF)


@query("ml2_history_features", f"""
    SELECT h.ordinal, round(CAST(CAST(log10(greatest(1, h.interactions + 1)) AS FLOAT) AS DOUBLE), 3) AS HistoryInteractionCount,
           round(CAST(CAST((epoch_us({o.DAY0}) - epoch_us(h.last_interaction)) / CAST(86400000000 AS DOUBLE) AS FLOAT) AS DOUBLE), 3) AS HistoryDaysSinceInteraction,
           CAST({flag('h.exists_now')} AS DOUBLE) AS HistoryTargetExists, CAST({flag('h.pinned')} AS DOUBLE) AS HistoryPinned, CAST({flag("starts_with(h.target_path, '\\\\')")} AS DOUBLE) AS HistoryNetworkPath,
           CAST({flag('h.related_finding_id IS NOT NULL')} AS DOUBLE) AS HistoryHasAuditFinding, round(CAST(CAST(CASE WHEN h.size_bytes > 0 THEN log10(h.size_bytes)
             WHEN a.finding_id IS NOT NULL THEN log10(greatest(1, a.size_bytes)) ELSE 0 END AS FLOAT) AS DOUBLE), 3) AS LogFileSize,
           CAST(coalesce(a.pii_total, 0) AS DOUBLE) AS PersonalDataMatches, h.application_name AS ApplicationCategory, h.source_kind AS HistorySourceKind
    FROM history h LEFT JOIN audited a ON h.related_finding_id = a.finding_id""", ("history", "audited"))
def _(v: Views):
    names = ["HistoryInteractionCount", "HistoryDaysSinceInteraction", "HistoryTargetExists", "HistoryPinned", "HistoryNetworkPath",
             "HistoryHasAuditFinding", "LogFileSize", "PersonalDataMatches"]
    return history_features(v).select("ordinal", *shown(names), "features.ApplicationCategory", "features.HistorySourceKind")


FACTORS = ["pii_total > 0", "coalesce(sec_total > 0, false) OR cfg_is", f"{age_sql('modified_at')} >= 730", "coalesce(exif_gps, false) OR exif_serial <> ''",
           "doc_is", "ppl_seen"]


@query("top4_explanations", "SELECT finding_id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {f} THEN '{text}' END" for f, text in zip(FACTORS, o.fixed.EXPLANATION_FACTORS)) +
    "], lambda x: x IS NOT NULL)[1:3], '; ') AS explanation FROM audited", ("audited",))
def _(v: Views):
    return learning.with_features(v.audited, AS_OF).select("finding_id", F.array_join(learning.explanation(), "; ").alias("explanation"))


def training(v: Views):
    current = joins.first_by_path(learning.with_features(v.audited, AS_OF)).select("path_key", "features")
    liked = v.feedback.withColumn("label", c("label") & (c("schema_version") == 2))
    return joins.training_rows(liked, current, learning.stored_features(c("feature_json")))


@query("top3_precision_of_exposure_order", """
    SELECT CAST(count(*) AS BIGINT) AS shown, count(*) FILTER (label) AS positives FROM (
      SELECT r.label FROM feedback r JOIN findings f ON upper(f.path) = r.path_key ORDER BY f.exposure_score DESC, f.ordinal LIMIT 20)""", ("feedback", "findings"))
def _(v: Views):
    rows = joins.with_feedback(v.findings, v.feedback).filter("personal_label is not null")
    scored = rows.select(c("personal_label").cast("double").alias("target"), c("exposure_score").alias("ExposureScore"), (-c("ordinal")).alias("negative"), c("ordinal").alias("row_id"))
    good, shown_rows = learning.precision_at(scored, "ExposureScore")
    return scored.agg(F.lit(shown_rows).cast("long").alias("shown"), F.lit(good).cast("long").alias("positives"))


HELD = "('0x' || substr(md5('1701:' || path_key), 1, 8))::BIGINT % 5 = 0"


@query("ml4_score_metrics", f"""
    WITH scored AS (
      SELECT r.path_key AS row_id, r.label, f.exposure_score / CAST(100 AS DOUBLE) AS score, f.size_bytes AS baseline
      FROM findings f JOIN (SELECT path_key, arg_max(label, updated_at) AS label FROM feedback GROUP BY path_key) r ON upper(f.path) = r.path_key WHERE {HELD}),
    pairs AS (SELECT sum(CASE WHEN p.score > n.score THEN 1 WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END) AS wins FROM scored p JOIN scored n ON p.label AND NOT n.label),
    points AS (SELECT score, count(*) FILTER (label) AS pos, sum(count(*) FILTER (label)) OVER w AS tp, sum(count(*)) OVER w AS seen FROM scored GROUP BY score WINDOW w AS (ORDER BY score DESC)),
    sums AS (SELECT count(*) AS n, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS f, count(*) FILTER (label AND score > 0.5) AS tp, count(*) FILTER (NOT label AND score > 0.5) AS fp FROM scored),
    first AS (SELECT (SELECT count(*) FILTER (label) FROM (SELECT label FROM scored ORDER BY score DESC, row_id LIMIT 20)) AS good,
                     (SELECT count(*) FILTER (label) FROM (SELECT label FROM scored ORDER BY baseline DESC, row_id LIMIT 20)) AS base)
    SELECT CAST(n AS BIGINT) AS validation_samples, round(CASE WHEN n > 0 THEN (tp + f - fp) / CAST(n AS DOUBLE) ELSE 0 END, 9) AS accuracy,
           round(CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END, 9) AS precision, round(CASE WHEN p > 0 THEN tp / CAST(p AS DOUBLE) ELSE 0 END, 9) AS recall,
           round(CASE WHEN tp > 0 THEN 2 * tp / CAST(2 * tp + fp + p - tp AS DOUBLE) ELSE 0 END, 9) AS f1,
           round(CASE WHEN p * f > 0 THEN wins / CAST(p * f AS DOUBLE) ELSE 0 END, 9) AS roc_auc,
           round(CASE WHEN p > 0 THEN (SELECT sum(pos * tp / CAST(seen AS DOUBLE)) FROM points) / CAST(p AS DOUBLE) ELSE 0 END, 9) AS pr_auc,
           round(CASE WHEN n > 0 THEN good / CAST(least(n, 20) AS DOUBLE) ELSE 0 END, 9) AS precision_at_20,
           round(CASE WHEN n > 0 THEN base / CAST(least(n, 20) AS DOUBLE) ELSE 0 END, 9) AS baseline_precision_at_20, CAST(greatest(0, good - base) AS BIGINT) AS lifted_into_top_20
    FROM sums, pairs, first""", ("feedback", "findings"))
def _(v: Views):
    """All metrics over the same fifth of the rated findings that training holds out, with their exposure as the score."""
    rated = joins.with_feedback(v.findings, v.feedback).filter("personal_label is not null").withColumn("row_id", F.upper("path"))
    scored = rated.filter(learning.fold("row_id") == 0).select(
        "row_id", c("personal_label").cast("double").alias("target"), (c("exposure_score") / 100).alias("score"), c("size_bytes").cast("double").alias("baseline"))
    found = learning.score_metrics(scored)
    return found.select(*[F.round(n, 9).alias(n) if t == "double" else c(n).cast("long").alias(n) for n, t in found.dtypes])


@query("ml4_training_metrics")
def _(v: Views):
    _, facts = learning.train(training(v))
    metrics = {**(facts["validation_metrics"] or {}), "trained_samples": facts["trained_samples"], "positive_samples": facts["positive_samples"]}
    values = F.map_from_arrays(F.array(*[F.lit(k) for k in metrics]), F.array(*[F.lit(float(x)) for x in metrics.values()]))
    # One row per metric, next to the number of findings the model will score.
    return v.audited.agg(F.count(F.lit(1)).alias("findings")).select("findings", F.explode(values).alias("metric", "value"))


@query("ml5_batch_scores")
def _(v: Views):
    model, _ = learning.train(training(v))
    scored = learning.with_personal_score(learning.with_features(v.audited, AS_OF), model)
    return scored.select("finding_id", F.round(c("personal_score").cast("double"), 3).alias("personal_score"))


@query("ml3_separable_samples", """
    SELECT CAST(count(*) AS BIGINT) AS findings, CAST(count(*) AS BIGINT) AS apart FROM findings""", ("findings",))
def _(v: Views):
    """Trained on an attribute it can see (a pinned-down exposure score), the model ranks every liked row above the others."""
    rows = learning.with_features(v.audited, AS_OF).select("finding_id", "features", (c("exposure_score") >= 40).alias("label"))
    marked = rows.withColumn("features", c("features").withField("ExposureScore", F.when(c("label"), 90.0).otherwise(5.0)))
    model = learning.pipeline().fit(learning.samples(marked))
    scored = learning.with_personal_score(marked, model)
    return scored.agg(F.count(F.lit(1)).alias("findings"), F.count_if((c("personal_score") > 50) == c("label")).alias("apart"))


@query("ml5_score_properties", """
    SELECT CAST(count(*) AS BIGINT) AS findings, CAST(count(*) AS BIGINT) AS between_0_and_100, CAST(count(*) AS BIGINT) AS null_without_model FROM findings""", ("findings",))
def _(v: Views):
    rows = learning.with_features(v.audited, AS_OF).select("finding_id", "features")
    model, _ = learning.train(training(v))
    scored = learning.with_personal_score(rows, model).join(
        learning.with_personal_score(rows, None).select("finding_id", c("personal_score").alias("none")), "finding_id")
    return scored.agg(F.count(F.lit(1)).alias("findings"), F.count_if(c("personal_score").between(0, 100)).alias("between_0_and_100"),
                      F.count_if(c("none").isNull()).alias("null_without_model"))


@query("ml6_model_round_trip", """
    SELECT CAST(count(*) AS BIGINT) AS findings, CAST(count(*) AS BIGINT) AS equal FROM findings""", ("findings",))
def _(v: Views):
    """A model that is saved and read back gives the same scores; a folder without one gives none."""
    rows = learning.with_features(v.audited, AS_OF).select("finding_id", "features")
    model, facts = learning.train(training(v))
    folder = scratch(v)
    learning.save_model(v.spark, model, facts, folder)
    again, _ = learning.load_model(v.spark, folder)
    assert learning.load_model(v.spark, folder + "-none") is None
    both = learning.with_personal_score(rows, model).join(
        learning.with_personal_score(rows, again).select("finding_id", c("personal_score").alias("again")), "finding_id")
    return both.agg(F.count(F.lit(1)).alias("findings"), F.count_if(c("personal_score") == c("again")).alias("equal"))
