"""Scalar expressions: labels, buckets, ages and page sizes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.functions import paths
from tracelake.functions.paths import col

TICKS_AT_EPOCH = 621_355_968_000_000_000


def ladder(value: Column, edges: list[tuple], top: str) -> Column:
    """First label whose edge lies above the value."""
    rest = F.lit(top)
    for edge, label in reversed(edges):
        rest = F.when(value < edge, F.lit(label)).otherwise(rest)
    return rest


def micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def days_since(ts: Column | str, as_of: datetime) -> Column:
    return (micros(F.lit(as_of)) - micros(ts)) / F.lit(86_400_000_000.0)


def age_class(ts: Column | str, as_of: datetime) -> Column:
    """SCL-2."""
    months = days_since(ts, as_of) / F.lit(fixed.DAYS_PER_MONTH)
    return F.when(col(ts).isNull(), F.lit("Unknown")).otherwise(ladder(months, fixed.AGE_EDGES, fixed.AGE_OLDEST))


def human_bytes(size: Column | str) -> Column:
    """SCL-3: two decimals at most, base 1024."""
    n = col(size).cast("double")
    shown = None
    for power in range(len(fixed.BYTE_UNITS) - 1, -1, -1):
        scaled = F.regexp_replace(F.round(n / F.lit(float(1024**power)), 2).cast("string"), r"\.0$", "")
        text = F.concat(scaled, F.lit(" " + fixed.BYTE_UNITS[power]))
        shown = text if shown is None else F.when(n < float(1024 ** (power + 1)), text).otherwise(shown)
    return shown


def risk_level(score: Column | str) -> Column:
    """SCL-4."""
    level = F.lit("None")
    for edge, label in reversed(fixed.RISK_EDGES):
        level = F.when(col(score) >= edge, F.lit(label)).otherwise(level)
    return level


def risk_order(level: Column | str) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in fixed.RISK_LEVELS]), col(level)).cast("int") - 1


def size_bucket(size: Column | str) -> Column:
    """SCL-10."""
    return ladder(col(size), fixed.SIZE_BUCKETS, fixed.SIZE_BUCKET_TOP)


def score_bucket(score: Column | str) -> Column:
    """SCL-11."""
    return ladder(col(score), fixed.SCORE_BUCKETS, fixed.SCORE_BUCKET_TOP)


def safe_label(value: Column | str, fallback: str) -> Column:
    """SCL-13."""
    kept = F.trim(F.substring(F.regexp_replace(col(value), r"[^A-Za-z0-9 _\-/.]", ""), 1, 80))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(fallback))


def os_label(value: Column | str) -> Column:
    numbers = F.filter(F.split(F.regexp_replace(col(value), r"[^0-9.]", ""), r"\."), lambda p: p != "")
    return (F.when(F.size(numbers) >= 2, F.concat_ws(".", F.concat(F.lit("Windows "), numbers[0]), numbers[1]))
            .otherwise(F.lit("Windows (version unavailable)")))


def size_step_label(step: Column) -> Column:
    """SCL-17."""
    labels = F.array(*[F.lit(name) for name, _ in fixed.SIZE_STEPS])
    return F.when((step >= 0) & (step < len(fixed.SIZE_STEPS)), F.get(labels, step)).otherwise(labels[0])


def resolution_step_label(step: Column) -> Column:
    """SCL-17: negative steps mean below the threshold."""
    names = [name for name, _ in fixed.RESOLUTION_STEPS]
    above = F.array(*[F.lit(n if i == 0 else f"ResolutionGte{n}") for i, n in enumerate(names)])
    below = F.array(*[F.lit(n if i == 0 else f"ResolutionLt{n}") for i, n in enumerate(names)])
    return (F.when(F.abs(step) >= len(names), above[0])
            .when(step < 0, F.get(below, F.abs(step))).otherwise(F.get(above, F.abs(step))))


def age_step_label(step: Column) -> Column:
    """SCL-17."""
    labels = F.array(*[F.lit(row[0]) for row in fixed.AGE_STEPS])
    return F.when((step >= 0) & (step < len(fixed.AGE_STEPS)), F.get(labels, step)).otherwise(labels[0])


def ticks(ts: Column | str) -> Column:
    """100 ns units since year 1."""
    return micros(ts) * 10 + F.lit(TICKS_AT_EPOCH)


def audit_identity(started: Column, completed: Column) -> Column:
    """SCL-18."""
    return F.concat_ws(":", F.lit("v2"), ticks(started).cast("string"), ticks(completed).cast("string"))


def audit_identity_matches(candidate: Column, started: Column, completed: Column) -> Column:
    """SCL-18: equal, or an older three-part key with the same two timestamps."""
    parts = F.split(candidate, ":")
    legacy = ((F.size(parts) == 3) & parts[0].try_cast("long").eqNullSafe(ticks(started))
              & F.get(parts, F.lit(1)).try_cast("long").eqNullSafe(ticks(completed)))
    return F.coalesce((candidate == audit_identity(started, completed)) | legacy, F.lit(False))


def sample_offsets_ms(duration_ms: Column) -> Column:
    """SCL-20: at most two offsets per video."""
    unknown = F.array(F.lit(1000).cast("long"), F.lit(3000).cast("long"))
    half = F.floor(duration_ms / 2)
    return (F.when(duration_ms.isNull() | (duration_ms <= 0), unknown)
            .when(duration_ms < 2000, F.array(half))
            .when(duration_ms <= 5000, F.array(F.floor(duration_ms / 4), F.floor(duration_ms * 3 / 4)))
            .otherwise(F.array(F.lit(1000).cast("long"), half)))


def tile_page_size(tile: Column) -> Column:
    """SCL-22."""
    t = F.least(F.lit(260.0), F.greatest(F.lit(80.0), F.when(F.isnan(tile), F.lit(140.0)).otherwise(tile)))
    rows = F.bround(240.0 * F.pow(140.0 / t, F.lit(2.0)), 0).cast("int")
    return F.least(F.lit(600), F.greatest(F.lit(72), rows))


def reason_text(reasons: Column | str) -> Column:
    """SCL-23."""
    return F.concat_ws("; ", col(reasons))


def effective_risk(related_level: Column, historical_score: Column) -> Column:
    """SCL-24."""
    return (F.when(related_level.isNotNull() & (related_level != "None"), related_level)
            .otherwise(risk_level(historical_score)))


def report_columns(correction: Column, explanation: Column, version: Column, os_version: Column) -> dict[str, Column]:
    """SCL-14: anonymised report fields of one finding row."""
    directory = F.col("is_directory")
    subcategory = safe_label("subcategory", "none")
    return {
        "title": F.concat(F.lit("Incorrect detection: "), safe_label("category", "Other")),
        "explanation": F.trim(explanation),
        "version": version,
        "finding_type": safe_label("category", "Other"),
        "detected": F.concat_ws(" / ", safe_label("category", "Other"), subcategory),
        "correction": safe_label(correction, "Unspecified"),
        "path_shape": paths.path_shape("path", directory),
        "extension": F.when(directory, F.lit("[directory]")).otherwise(paths.safe_extension("path")),
        "size_range": F.when(directory, F.lit("not applicable")).otherwise(size_bucket("size_bytes")),
        "scanner": safe_label("scanner_id", "unknown"),
        "score_range": score_bucket("exposure_score"),
        "provenance": F.when(F.length("subcategory") > 0, subcategory).otherwise(F.lit("not available")),
        "os_version": os_label(os_version),
        "labels": F.concat_ws(
            ",", F.lit("incorrect-detection"),
            F.when(correction == "Wrong finding", "wrong-finding")
            .when(correction == "Wrong file origin", "wrong-file-origin")
            .when(correction == "Wrong risk level", "wrong-risk-level")
            .otherwise("other-inaccuracy")),
    }


def explanation_is_valid(explanation: Column) -> Column:
    return F.length(F.trim(explanation)).between(10, 1000)
