"""Evidence of all detectors on one finding: JSON boundary, summaries and ranks.

A finding row carries one nullable struct per detector: pii, secrets, config, identity, archive, document, people,
image_safety, exif, and `scan_status`, a map of scanner to true.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.operators import archive, config, document, exif, identity, media, pii, secrets

JSON_KEYS = {
    "pii": ("pii_scan", pii.PII_TYPE),
    "secrets": ("secret_scan", secrets.SECRETS_TYPE),
    "config": ("config_scan", config.CONFIG_TYPE),
    "identity": ("identity_trace", "struct<has_identity_trace:boolean,total_mentions:int,"
                                   "matched_terms:map<string,string>,summary:string>"),
    "archive": ("archive_inspection", archive.ARCHIVE_TYPE),
    "document": ("document_scan", document.DOCUMENT_TYPE),
    "image_safety": ("image_safety", media.SAFETY_TYPE),
    "exif": ("exif_metadata", exif.EXIF_TYPE),
    "similarity": ("similarityAnalysis", "struct<kind:string,completed_at:string,"
                                         "matches:array<struct<path:string,score:double,details:string>>>"),
}
PEOPLE_FIELDS = ["people_scan_status", "people_detected", "face_count", "max_confidence", "model_version"]


def c(name: str) -> Column:
    return F.col(name)


def positive(name: str) -> Column:
    """Null-safe test of an evidence field: a missing struct is no evidence."""
    return F.coalesce(c(name) > 0, F.lit(False))


def true(name: str) -> Column:
    return F.coalesce(c(name), F.lit(False))


def has_fields() -> Column:
    return F.coalesce(F.size("exif.disclosed_fields") > 0, F.lit(False))


def unsafe() -> Column:
    return F.coalesce((c("image_safety.status") == "Completed") & (c("image_safety.primary_class") != "SFW"),
                      F.lit(False))


def points(condition: Column, value) -> Column:
    return F.when(condition, value).otherwise(F.lit(0))


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


# --- JSON boundary --------------------------------------------------------------------------------

def to_metadata() -> Column:
    """JSN-1 export: one key per present detector, people at the root, `scan_status` beside them."""
    parts = [c(name).alias(key) for name, (key, _) in JSON_KEYS.items() if name != "similarity"]
    parts += [c(f"people.{f}").alias(f) for f in PEOPLE_FIELDS]
    return F.to_json(F.struct(*parts, c("scan_status").alias("scan_status")))


def merged(existing: Column, key: str, value: Column) -> Column:
    """JSN-1: put one detector object under its key and keep every other key as it was."""
    root = F.from_json(existing, "map<string,variant>")
    kept = F.map_filter(F.coalesce(root, F.create_map().cast("map<string,variant>")), lambda k, _: k != key)
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(key), F.parse_json(F.to_json(value)))))


def merged_people(existing: Column, people: Column) -> Column:
    """JSN-1: people fields live at the root of the document."""
    root = F.coalesce(F.from_json(existing, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    kept = F.map_filter(root, lambda k, _: ~k.isin(PEOPLE_FIELDS))
    return F.to_json(F.map_concat(kept, F.from_json(F.to_json(people), "map<string,variant>")))


def parsed(metadata: Column, name: str) -> Column:
    """JSN-2: a missing key or broken JSON is no evidence."""
    key, kind = JSON_KEYS[name]
    value = F.from_json(metadata, f"struct<`{key}`:{kind}>")[key]
    if name == "image_safety":
        known = value["status"].isin("Completed", "Error") & value["primary_class"].isin("NSFL", "NSFW", "SFW")
        return F.when(known, value)
    return value


def parsed_people(metadata: Column) -> Column:
    value = F.from_json(metadata, media.PEOPLE_TYPE)
    known = value["people_scan_status"].isin("Completed", "Error") & (F.trim(value["model_version"]) != "")
    return F.when(known, value)


def parsed_status(metadata: Column) -> Column:
    """JSN-3: only JSON true counts."""
    raw = F.from_json(metadata, "struct<scan_status:map<string,string>>")["scan_status"]
    return F.transform_values(raw, lambda _, v: v == "true")


def mark_completed(metadata: Column, scanner: str) -> Column:
    """JSN-3: set one flag in the status object."""
    raw = F.coalesce(F.from_json(metadata, "struct<scan_status:map<string,variant>>")["scan_status"],
                     F.create_map().cast("map<string,variant>"))
    others = F.map_filter(raw, lambda k, _: k != scanner)
    flags = F.map_concat(others, F.create_map(F.lit(scanner), F.parse_json(F.lit("true"))))
    return merged(metadata, "scan_status", flags)


def status_with(scanner: str) -> Column:
    """The same on the typed column."""
    others = F.map_filter(F.coalesce("scan_status", F.create_map().cast("map<string,boolean>")),
                          lambda k, _: k != scanner)
    return F.map_concat(others, F.create_map(F.lit(scanner), F.lit(True)))


def is_completed(scanner: str) -> Column:
    """FLT-17."""
    return F.coalesce(F.try_element_at(c("scan_status"), F.lit(scanner)), F.lit(False))


# --- summaries ------------------------------------------------------------------------------------

def detections() -> list[tuple[Column, Column]]:
    """(confirmed, evidence count) per detector, in the order used by AGG-14."""
    return [
        (positive("pii.total_matches"), c("pii.total_matches")),
        (positive("secrets.total_matches"), c("secrets.total_matches")),
        (true("config.is_credential_config"), F.lit(1)),
        (true("identity.has_identity_trace"), F.greatest(F.lit(1), c("identity.total_mentions"))),
        (true("archive.is_archive") & positive("archive.sensitive_entries_count"),
         c("archive.sensitive_entries_count")),
        (true("document.is_document"), F.when(true("document.is_id_document"), 2).otherwise(1)),
        (true("people.people_detected"), F.greatest(F.lit(1), c("people.face_count"))),
        (unsafe(), F.lit(1)),
        (has_fields(), F.size("exif.disclosed_fields")),
    ]


def has_completed_scan() -> Column:
    return reduce(lambda a, b: a | b, [is_completed(key) for key in fixed.SCANNER_KEYS])


def category_count() -> Column:
    return total([points(hit, 1) for hit, _ in detections()])


def evidence_count() -> Column:
    return total([points(hit, n) for hit, n in detections()])


def with_summary(findings: DataFrame) -> DataFrame:
    """AGG-14."""
    return (findings.withColumn("has_completed_scan", has_completed_scan())
            .withColumn("confirmed_categories", category_count()).withColumn("evidence_count", evidence_count()))


def confirmed_signals() -> Column:
    """AGG-15: image safety is not counted, and a listing counts even when it is no archive."""
    return total([points(hit, 1) for hit in (
        positive("pii.total_matches"), positive("secrets.total_matches"), true("config.is_credential_config"),
        true("identity.has_identity_trace"), positive("archive.sensitive_entries_count"),
        true("document.is_document"), true("people.people_detected"), has_fields())])


# --- ranks ----------------------------------------------------------------------------------------

def objective_risk() -> Column:
    """RNK-1."""
    score = c("exposure_score") + total([
        points(positive("pii.total_matches"), 18), points(positive("secrets.total_matches"), 28),
        points(true("config.is_credential_config"), 22), points(true("identity.has_identity_trace"), 14),
        points(positive("archive.sensitive_entries_count"), 24),
        points(true("document.is_document"), F.when(true("document.is_id_document"), 24).otherwise(15)),
        points(true("people.people_detected"), 10), points(has_fields(), 6), points(true("exif.has_geolocation"), 16)])
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def evidence_floor() -> Column:
    """RNK-3."""
    return (F.when(positive("secrets.total_matches"), 90).when(true("config.is_credential_config"), 85)
            .when(true("document.is_id_document"), 80).when(true("exif.has_geolocation"), 75).otherwise(0))


def combined_score(objective: Column) -> Column:
    """RNK-2: half-to-even rounding, never below the evidence floor."""
    blended = F.bround(objective * 0.80 + c("personal_score").cast("double") * 0.20, 0).cast("int")
    held = F.greatest(evidence_floor(), F.least(F.lit(100), F.greatest(F.lit(0), blended)))
    return F.when(c("personal_score").isNull(), objective).otherwise(held)


def privacy_rank(objective: Column, combined: Column) -> Column:
    """RNK-4: half away from zero."""
    return F.round((objective + combined) / 2.0, 0).cast("int")


def detection_rank(rank: Column) -> Column:
    """RNK-5."""
    rank = rank.cast("long")
    proven = (F.lit(2_000_000_000) + c("evidence_count").cast("long") * 10_000
              + c("confirmed_categories").cast("long") * 100 + rank)
    return (F.when(c("confirmed_categories") > 0, proven)
            .when(c("has_completed_scan"), F.lit(1_000_000_000) + rank).otherwise(rank))


def with_ranks(findings: DataFrame) -> DataFrame:
    """All ranks, one projection per dependency level so that nothing is computed twice."""
    return (with_summary(findings).withColumn("objective_risk", objective_risk())
            .withColumn("combined_score", combined_score(c("objective_risk")))
            .withColumn("privacy_rank", privacy_rank(c("objective_risk"), c("combined_score")))
            .withColumn("detection_rank", detection_rank(c("privacy_rank"))))


def badge() -> Column:
    """SCL-19: positive evidence only, else clear or unknown."""
    def labelled(label: str, value: Column) -> Column:
        return F.concat(F.lit(label + ": "), value.cast("string"))

    def percent(value: Column) -> Column:
        return F.concat(F.bround(value * 100, 0).cast("int").cast("string"), F.lit(" %"))

    gps = F.format_string("GPS: %.2f, %.2f", c("exif.latitude"), c("exif.longitude"))
    parts = [
        F.when(positive("pii.total_matches"), labelled("PII", c("pii.total_matches"))),
        F.when(positive("secrets.total_matches"), labelled("Secrets", c("secrets.total_matches"))),
        F.when(true("config.is_credential_config"), labelled("Config", c("config.exposure_level"))),
        F.when(true("identity.has_identity_trace"), labelled("Identity", c("identity.total_mentions"))),
        F.when(true("archive.is_archive") & positive("archive.sensitive_entries_count"),
               F.concat(labelled("Archive", c("archive.privacy_score")), F.lit(" ("),
                        c("archive.sensitive_entries_count").cast("string"), F.lit(")"))),
        F.when(true("exif.has_geolocation"), gps)
        .when(F.trim(c("exif.camera_model")) != "", labelled("EXIF", c("exif.camera_model"))),
        F.when(true("document.is_document"),
               F.concat(F.when(true("document.is_id_document"), F.lit("ID Document · "))
                        .otherwise(F.lit("Document · ")), percent(c("document.confidence")))),
        F.when(true("people.people_detected"), labelled("People", c("people.face_count"))),
        F.when(unsafe(), F.concat(c("image_safety.primary_class"), F.lit(" · NSFW Score: "),
                                  percent(c("image_safety.nsfw_score")))),
    ]
    text = F.concat_ws(fixed.BADGE_SEPARATOR, *parts)
    return (F.when(text != "", text).when(has_completed_scan(), F.lit(fixed.BADGE_CLEAR))
            .otherwise(F.lit(fixed.BADGE_UNKNOWN)))
