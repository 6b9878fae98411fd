"""Lookups between audit tables.

Every lookup has a unique right side, so a hot key on the left only ever meets one row: AQE splits such a
partition. Keys are lowered once on both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import paths
from tracelake.operators.ordering import first_per_group

#: Excluded prefixes that are put into the plan.
FEW_PREFIXES = 10_000


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """WIN-1: the newest row per path key."""
    return first_per_group(feedback.withColumn("path_key", F.upper("path_key")), ["path_key"],
                           F.desc("updated_at"), F.asc("finding_id"))


def first_by_path(findings: DataFrame) -> DataFrame:
    """WIN-2: the first finding per path key in input order."""
    return first_per_group(findings.withColumn("path_key", paths.path_key("path")), ["path_key"], F.asc("ordinal"))


def with_feedback(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """JN-1."""
    rated = latest_feedback(feedback).select("path_key", F.col("label").alias("personal_label"))
    return (findings.drop("personal_label").withColumn("path_key", paths.path_key("path"))
            .join(rated, "path_key", "left").drop("path_key"))


def matched_results(findings: DataFrame, results: DataFrame) -> DataFrame:
    """JN-3: the first finding of each path receives the detector result of that path."""
    owners = first_per_group(findings.withColumn("path_lower", F.lower("path")), ["path_lower"], F.asc("ordinal"))
    return owners.join(results.withColumn("path_lower", F.lower("path")).drop("path"), "path_lower").drop("path_lower")


def in_session(findings: DataFrame, selected: DataFrame) -> DataFrame:
    """JN-4."""
    return findings.join(selected.select("finding_id"), "finding_id", "left_semi")


def unknown_history(significant: DataFrame, known: DataFrame) -> DataFrame:
    """JN-5: significant history paths not yet among the findings, one per path."""
    seen = known.filter("scanner_id = 'application-history'").select(F.lower("path").alias("path_lower"))
    fresh = significant.withColumn("path_lower", F.lower("path")).join(seen, "path_lower", "left_anti")
    return fresh.dropDuplicates(["path_lower"]).drop("path_lower")


def pending_routes(routes: DataFrame, state: DataFrame) -> DataFrame:
    """JN-7: neither completed nor skipped."""
    done = state.filter(F.col("state").isin("completed", "skipped")).select("finding_id", "scanner_id")
    return routes.join(done, ["finding_id", "scanner_id"], "left_anti")


def orphan_evidence(evidence: DataFrame, provenance: DataFrame) -> DataFrame:
    """JN-8."""
    return evidence.join(provenance.select(F.col("finding_id").alias("provenance_id")), "provenance_id", "left_anti")


def not_excluded(inventory: DataFrame, exclusions: DataFrame, few: int = FEW_PREFIXES) -> DataFrame:
    """FLT-10, JN-9: drop paths that start with an excluded prefix, ignoring case, at any character.

    Up to `few` prefixes become hash sets in the plan, one for each length that occurs, and the inventory is filtered
    where it lies, without a shuffle. More are met in joins (`beyond_exclusions`). A null path is never excluded.
    """
    known = exclusions.select(F.lower("path").alias("prefix")).filter("prefix <> ''").distinct()
    prefixes = sorted(r["prefix"] for r in known.limit(few + 1).collect())
    if len(prefixes) > few:
        return beyond_exclusions(inventory, known)
    by_length: dict[int, list[str]] = {}
    last = None
    for prefix in prefixes:  # one that continues another excludes nothing more
        if last is None or not prefix.startswith(last):
            last = prefix
            by_length.setdefault(len(prefix.encode("utf-16-le")) // 2, []).append(prefix)
    path = F.lower("path")
    met = [F.substring(path, 1, n).isin(some) for n, some in sorted(by_length.items())]
    return inventory.filter(~F.coalesce(reduce(Column.__or__, met), F.lit(False))) if met else inventory


def beyond_exclusions(inventory: DataFrame, known: DataFrame) -> DataFrame:
    """`not_excluded` for any number of prefixes (lower-case, distinct, not empty).

    A path can only be excluded by a prefix of one of the lengths that occur, so it meets the prefixes in an equi
    join, once per length. Prefixes that end inside a directory's path exclude the whole directory: distinct
    directories are tested first, and files only against the longer prefixes.
    """
    # Distinct lengths are bounded by the longest path a file system allows.
    sizes = F.lit(sorted(r.n for r in known.select(F.length("prefix").alias("n")).distinct().collect())).cast("array<int>")

    def heads(text: Column, beyond: Column) -> Column:
        fits = F.filter(sizes, lambda n: (n > beyond) & (n <= F.length(text)))
        return F.explode(F.transform(fits, lambda n: F.substring(text, F.lit(1), n)))

    lowered = F.lower("path")
    rows = inventory.withColumn("__folder", F.regexp_replace(lowered, r"[^\\/]*$", ""))
    folders = (rows.select("__folder").distinct().select("__folder", heads(F.col("__folder"), F.lit(0)).alias("prefix"))
               .join(known, "prefix", "left_semi").select("__folder").distinct())
    rest = rows.join(folders, "__folder", "left_anti")
    files = (rest.filter("path is not null").select("path", "__folder").select("path", heads(lowered, F.length("__folder")).alias("prefix"))
             .join(known, "prefix", "left_semi").select("path").distinct())
    return rest.drop("__folder").join(files, "path", "left_anti").select(*inventory.columns)


def without_deleted(findings: DataFrame, deleted: DataFrame) -> DataFrame:
    """JN-15."""
    return findings.join(deleted.select("finding_id"), "finding_id", "left_anti")


def saved_matches(saved: DataFrame, findings: DataFrame) -> DataFrame:
    """JN-16: stored similarity matches that still exist, with their findings."""
    rows = saved.select(F.col("finding_id").alias("query_id"), F.explode("similarity.matches").alias("m"))
    current = first_per_group(findings.withColumn("path_lower", F.lower("path")), ["path_lower"], F.asc("ordinal"))
    return (rows.select("query_id", F.lower("m.path").alias("path_lower"), "m.score", "m.details")
            .join(current.select("path_lower", "finding_id", "path"), "path_lower").drop("path_lower"))


def training_rows(feedback: DataFrame, current: DataFrame, stored: Column) -> DataFrame:
    """JN-13: fresh features where the path is still found, else the stored ones; unreadable rows drop out.

    `current` carries (path_key, features); `stored` parses the stored feature document.
    """
    joined = feedback.join(current.withColumnRenamed("features", "fresh"), "path_key", "left")
    return (joined.withColumn("features", F.coalesce("fresh", stored)).filter("features is not null")
            .withColumn("refreshed", F.col("fresh").isNotNull()).drop("fresh"))


def evolution_events(findings: DataFrame, feedback: DataFrame, event_type: str, at: Column, version: int) -> DataFrame:
    """JN-14: one event per rated finding, with its current features (column `feature_json`)."""
    rated = latest_feedback(feedback.filter(F.col("schema_version") == version)).select("path_key", "label")
    return (findings.withColumn("path_key", paths.path_key("path")).join(rated, "path_key")
            .select("finding_id", "path_key", F.lit(event_type).alias("event_type"), at.alias("created_at"),
                    F.lit(version).alias("schema_version"), "label", "feature_json"))


def with_history_context(findings: DataFrame, context: DataFrame) -> DataFrame:
    """JN-12: `context` is unique per finding."""
    return findings.drop("history_refs", "history_last_seen", "history_interactions").join(context, "finding_id", "left")
