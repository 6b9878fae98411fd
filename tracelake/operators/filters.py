"""Predicates over finding and history rows, as Columns that push down where the source allows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.functions import paths, scalars
from tracelake.operators import evidence as ev


def everything() -> Column:
    return F.lit(True)


def size_at_least(step: int, column: str = "size_bytes") -> Column:
    """FLT-1."""
    if not 0 < step < len(fixed.SIZE_STEPS):
        return everything()
    return F.col(column) >= fixed.SIZE_STEPS[step][1]


def resolution(step: int, width: str = "width", height: str = "height") -> Column:
    """FLT-2: negative steps mean below; unknown dimensions fail every real step."""
    if step == 0 or abs(step) >= len(fixed.RESOLUTION_STEPS):
        return everything() if step == 0 else F.col(width).isNotNull()
    edge = fixed.RESOLUTION_STEPS[abs(step)][1]
    pixels = F.col(width).cast("long") * F.col(height)
    known = (F.col(width) > 0) & (F.col(height) > 0)
    return F.coalesce(known & (pixels >= edge if step > 0 else pixels < edge), F.lit(False))


def age(step: int, as_of: datetime, modified: str = "modified_at", created: str | None = "created_at") -> Column:
    """FLT-3: missing dates fail, future dates count as today."""
    if step <= 0:
        return everything()
    date = F.coalesce(F.col(modified), F.col(created)) if created else F.col(modified)
    if step >= len(fixed.AGE_STEPS):
        return date.isNotNull()
    _, kind, days = fixed.AGE_STEPS[step]
    # greatest() skips nulls, so a missing date has to be ruled out first
    old = F.greatest(F.lit(0.0), scalars.days_since(date, as_of))
    return date.isNotNull() & (old <= days if kind == "at most" else old > days)


def search(text: str, columns: tuple[str, ...] = ("path", "display_name")) -> Column:
    """FLT-4."""
    if not text:
        return everything()
    return paths.any_of([F.lower(F.col(c)).contains(text.lower()) for c in columns])


def risk(level: str | None) -> Column:
    """FLT-5."""
    if level in (None, "All"):
        return everything()
    return F.lower(scalars.risk_level("exposure_score")) == level.lower()


def category(name: str | None) -> Column:
    """FLT-6: five virtual categories ask for positive evidence, the rest for equality."""
    virtual = {
        "PII": lambda: ev.positive("pii.total_matches"),
        "Secrets": lambda: ev.positive("secrets.total_matches"),
        "Configs": lambda: ev.true("config.is_credential_config"),
        "Identity": lambda: ev.true("identity.has_identity_trace"),
        "Archives": lambda: ev.true("archive.is_archive") & ev.positive("archive.sensitive_entries_count"),
    }
    if name in (None, "All"):
        return everything()
    return virtual[name]() if name in virtual else F.col("category") == name


def exposure_only() -> Column:
    """FLT-7."""
    return (F.col("exposure_score") >= 40) | F.col("category").isin("Recent", "Jump Lists")


def recommended_only() -> Column:
    """FLT-8."""
    return F.coalesce(F.col("personal_score") >= 60, F.lit(False))


def visible() -> Column:
    """FLT-9."""
    return ~F.col("ignored")


def finding_view(as_of: datetime, text: str = "", level: str | None = None, kind: str | None = None,
                 exposed: bool = False, recommended: bool = False, size_step: int = 0, age_step: int = 0) -> Column:
    """The list view: all finding filters together."""
    result = (visible() & search(text) & risk(level) & category(kind) & size_at_least(size_step) & age(age_step, as_of))
    if exposed:
        result = result & exposure_only()
    return result & recommended_only() if recommended else result


def media_scope(images: bool, videos: bool) -> Column:
    """FLT-11."""
    wanted = [name for name, on in (("Images", images), ("Video", videos)) if on]
    return F.col("category").isin(wanted) if wanted else F.lit(False)


SCOPED_VIEWS = ("AllMedia", "People", "NSFW", "NoPeople", "Errors", "Unscanned")


def media_view(view: str, images: bool = True, videos: bool = True) -> Column:
    """FLT-12."""
    done = F.col("people.people_scan_status") == "Completed"
    conditions = {
        "AllMedia": lambda: F.col("category").isin("Images", "Video"),
        "GeoExif": ev.has_fields,
        "GpsOnly": lambda: ev.true("exif.has_geolocation"),
        "Documents": lambda: ev.true("document.is_document"),
        "NSFW": high_confidence_unsafe,
        "People": lambda: done & F.col("people.people_detected"),
        "NoPeople": lambda: done & ~F.col("people.people_detected"),
        "Errors": lambda: F.col("people.people_scan_status") == "Error",
        "Unscanned": lambda: F.col("people").isNull(),
    }
    condition = F.coalesce(conditions[view](), F.lit(False)) if view in conditions else everything()
    return condition & media_scope(images, videos) if view in SCOPED_VIEWS else condition


def report_view(status: str = "Confirmed", level: str = "All", kind: str = "All", text: str = "") -> Column:
    """FLT-13: needs the summary columns and the flag `failed`."""
    confirmed = F.col("confirmed_categories") > 0
    by_status = {
        "Confirmed": confirmed,
        "Clear": F.col("has_completed_scan") & ~confirmed & ~F.col("failed"),
        "Errors": F.col("failed"),
    }.get(status, everything())
    by_kind = everything() if kind == "All" else F.lower("category") == kind.lower()
    return visible() & risk(level) & by_kind & search(text.strip()) & by_status


def high_confidence_unsafe() -> Column:
    """FLT-14."""
    return F.coalesce((F.col("image_safety.status") == "Completed")
                      & (F.col("image_safety.nsfw_score") > fixed.UNSAFE_FRAME_THRESHOLD), F.lit(False))


def history_view(as_of: datetime, availability: str = "All", pinned: str = "All", risk_filter: str = "All",
                 size_step: int = 0, age_step: int = 0, text: str = "") -> Column:
    """FLT-15 over history entries (effective_risk, exists, pinned, is_directory, size_bytes, target_modified_at)."""
    exists, is_pinned = F.col("exists"), F.col("pinned")
    order = scalars.risk_order("effective_risk")
    result = {"Available": exists, "Missing": ~exists}.get(availability, everything())
    result = result & {"Pinned": is_pinned, "NotPinned": ~is_pinned}.get(pinned, everything())
    result = result & {"Finding": order > 0, "Important": order >= 3, "None": order == 0}.get(risk_filter, everything())
    if size_step > 0:
        result = result & exists & ~F.col("is_directory") & size_at_least(size_step)
    if age_step > 0:
        result = result & exists & age(age_step, as_of, "target_modified_at", None)
    return result & search(text, ("target_path", "application_name"))


def candidates(detector: str) -> Column:
    """FLT-16: visible findings of a type the detector can read."""
    types = {
        "pii": paths.is_text("path"), "secrets": paths.is_text("path"), "identity": paths.is_text("path"),
        "configs": paths.is_text("path") | paths.extension("path").isin(fixed.CONFIG_EXTENSIONS),
        "archives": paths.is_openable_archive("path"),
        "documents": F.col("category") == "Images", "people": F.col("category").isin("Images", "Video"),
        "image_safety": F.col("category").isin("Images", "Video"),
        "exif": paths.extension("path").isin(fixed.METADATA_EXTENSIONS),
    }
    return visible() & types[detector]


def not_completed(scanner: str) -> Column:
    """FLT-17."""
    return ~ev.is_completed(scanner)
