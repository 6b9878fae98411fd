"""Application history: remembered paths per application, matched with the findings.

Entry columns: ordinal, container, target_path, last_interaction, interactions, pinned, exists, is_directory,
size_bytes, target_modified_at, source_kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.functions import paths, scalars
from tracelake.operators.ordering import first_per_group
from tracelake.session import discard, stored

#: Application names that a path's row lists.
NAMES = 1000
ENTRY_FIELDS = [
    "target_path", "last_interaction", "exists", "is_directory", "size_bytes", "target_modified_at", "source_kind", "ordinal",
]


def container_summary(containers: DataFrame) -> DataFrame:
    """SRC-8: a container without a size could not be read."""
    read = F.col("size_bytes").isNotNull()
    return containers.agg(
        F.count_if(read).alias("containers"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
        F.max(F.when(read, F.col("modified_at"))).alias("last_modified"), F.count_if(~read).alias("warnings"))


def identified(entries: DataFrame) -> DataFrame:
    """SCL-16: id, known flag, key and names of the application behind each container."""
    known = paths.application_name("container")
    app = paths.application_id("container")
    return (entries.withColumn("app_id", app).withColumn("known", known.isNotNull())
            .withColumn("application_key", F.coalesce(known, app))
            .withColumn("application_name", F.coalesce(known, F.lit(fixed.UNKNOWN_APPLICATION)))
            .withColumn("display_name", F.coalesce(known, F.concat(
                F.lit(fixed.UNKNOWN_APPLICATION + " · "), app))))


def remembered(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """The findings at paths that any entry holds, stored. A few paths may hold most of the entries: this table is then
    small, and Spark knows it before it plans the joins with the entries, so that no entry is moved or sorted for them."""
    held = stored(entries.select(paths.match_key("target_path").alias("path_match")).distinct())
    rows = stored(findings.withColumn("path_match", paths.match_key("path")).join(held, "path_match", "left_semi").drop("path_match"))
    discard(held)
    return rows


def related(entries: DataFrame, findings: DataFrame) -> DataFrame:
    """JN-2: each entry meets the most exposed finding of its path; the rest get a score of their own. Entries that are
    not merged should meet `remembered` findings."""
    best = first_per_group(
        findings.withColumn("path_match", paths.match_key("path")).filter("path_match <> ''"), ["path_match"],
        F.desc("exposure_score"), F.asc("ordinal"))
    right = best.select("path_match", F.col("finding_id").alias("related_finding_id"),
                        scalars.risk_level("exposure_score").alias("related_risk"))
    joined = entries.withColumn("path_match", paths.match_key("target_path")).join(right, "path_match", "left")
    lonely = F.col("related_finding_id").isNull()
    return with_effective_risk(
        joined.withColumn("related_risk", F.coalesce("related_risk", F.lit("None")))
        .withColumn("historical_score", F.when(lonely, paths.historical_risk("target_path")).otherwise(0)))


def with_effective_risk(entries: DataFrame) -> DataFrame:
    return entries.withColumn("effective_risk", scalars.effective_risk(F.col("related_risk"), F.col("historical_score")))


def merged(entries: DataFrame, *application: str) -> DataFrame:
    """AGG-5, AGG-6: one entry per application and path: the latest row, the highest count, any pin.

    Group by `app_id` for single containers' applications, by the application key for merged ones. Merge first and let
    the result meet the findings (`related`): what an entry gets there depends on its path only, and a path that holds
    a large share of the entries is by then a row per application.
    """
    latest = F.max_by(F.struct(*ENTRY_FIELDS), F.struct(F.col("last_interaction"), -F.col("ordinal")))
    return (entries.groupBy(*application, paths.match_key("target_path").alias("path_match"))
            .agg(latest.alias("e"), F.max("interactions").alias("interactions"), F.bool_or("pinned").alias("pinned"))
            .select(*application, "path_match", "e.*", "interactions", "pinned"))


APPLICATION = ("application_key", "application_name", "display_name", "known")


def applications(merged_entries: DataFrame, containers: DataFrame) -> DataFrame:
    """AGG-6: entries of known applications meet under their name, unknown ones under their id; containers and
    warnings add up; applications without entries drop out. `containers`: container, warning (boolean)."""
    held = (identified(first_per_group(containers.withColumn("key", F.lower("container")), ["key"], F.asc("container")))
            .groupBy("application_key").agg(F.count(F.lit(1)).alias("containers"), F.count_if("warning").alias("warnings")))
    return stats(merged_entries).join(held, "application_key", "left")


def stats(merged_entries: DataFrame) -> DataFrame:
    """AGG-7: remembered, missing, sensitive and last interaction per application."""
    return merged_entries.groupBy(*APPLICATION).agg(
        F.count(F.lit(1)).alias("remembered"), F.count_if(~F.col("exists")).alias("missing"),
        F.count_if(scalars.risk_order("effective_risk") >= 3).alias("sensitive"),
        F.max("last_interaction").alias("last_interaction"),
        F.max(priority()).alias("top_priority"), F.max(scalars.risk_order("effective_risk")).alias("top_risk"))


def application_scores(scored: DataFrame) -> DataFrame:
    """AGG-8: mean of the three best known scores; only three rows per application and task are shuffled."""
    rank = F.row_number().over(Window.partitionBy("application_key").orderBy(F.desc("personal_score"), F.asc("ordinal")))
    top = scored.filter("personal_score is not null").withColumn("n", rank).filter("n <= 3")
    return top.groupBy("application_key").agg(F.avg("personal_score").alias("application_score"))


def priority() -> Column:
    """SRT-5: available and pinned 4, available 3, pinned 2, else 1."""
    return (F.when(F.col("exists") & F.col("pinned"), 4).when(F.col("exists"), 3)
            .when(F.col("pinned"), 2).otherwise(1))


def entry_order() -> list[Column]:
    """SRT-5."""
    return [priority().desc(), scalars.risk_order("effective_risk").desc(), F.desc_nulls_last("last_interaction"),
            F.lower("target_path").asc(), F.asc("ordinal")]


def application_order(by_score: bool = False) -> list[Column]:
    """SRT-6."""
    if by_score:
        return [F.coalesce("application_score", F.lit(-1.0)).desc(), F.desc("remembered"), F.asc("application_key")]
    return [F.desc("top_priority"), F.desc("top_risk"), F.desc_nulls_last("last_interaction"),
            F.lower("display_name").asc(), F.asc("application_key")]


def path_applications(entries: DataFrame, path: str) -> DataFrame:
    """The table behind the lists of names: (path, fewer, display_name), a row per path and application, in list order by
    `fewer` and name."""
    return entries.select(path, "application_key", "fewer", "display_name").distinct()


def listed_names(entries: DataFrame, path: str, out: str) -> DataFrame:
    """(path, out): names of the applications of each path in list order, NAMES at most; tasks trim to that before the shuffle.
    `path_applications` has them all."""
    place = F.row_number().over(Window.partitionBy(path).orderBy("fewer", "display_name"))
    first = entries.withColumn("place", place).filter(F.col("place") <= NAMES)
    names = F.array_sort(F.collect_list(F.struct("place", F.col("display_name").alias("n"))))
    return first.groupBy(path).agg(F.array_join(F.transform(names, lambda s: s["n"]), ", ").alias(out))


def with_application_size(merged_entries: DataFrame) -> DataFrame:
    """Applications are listed by number of entries, then name. One row per application: Spark broadcasts it when
    it is small and shuffles it otherwise."""
    sizes = merged_entries.groupBy("application_key").agg((-F.count(F.lit(1))).alias("fewer"))
    return merged_entries.join(sizes, "application_key")


def significant(merged_entries: DataFrame) -> DataFrame:
    """AGG-9: unmatched paths with a score of 30 or more, one finding row per path."""
    lone = with_application_size(merged_entries).filter("related_finding_id is null and historical_score >= 30")
    best = F.min_by(F.struct("target_path", "exists", "last_interaction", "historical_score", "interactions"),
                    F.struct(-F.col("historical_score"), F.col("fewer"), F.col("display_name")))
    rows = lone.groupBy("path_match").agg(best.alias("b")).join(listed_names(lone, "path_match", "applications"), "path_match")
    retained = F.concat(F.lit("Windows application history retains this path through "), F.col("applications"))
    gone = F.concat(F.lit("The object no longer exists, but Windows application history retains its path through "),
                    F.col("applications"))
    return rows.select(
        F.lit("application-history").alias("scanner_id"), F.lit("Application history").alias("category"),
        F.when(F.col("b.exists"), F.lit("Remembered path outside the current audit"))
        .otherwise(F.lit("Historical path to a missing object")).alias("subcategory"),
        F.col("b.target_path").alias("path"),
        paths.base_name(paths.trim_separators("b.target_path")).alias("display_name"),
        F.col("b.last_interaction").alias("modified_at"), F.col("b.historical_score").alias("exposure_score"),
        F.array(F.when(F.col("b.exists"), retained).otherwise(gone)).alias("exposure_reasons"),
        F.col("applications").alias("history_refs"), F.col("b.last_interaction").alias("history_last_seen"),
        F.col("b.interactions").alias("history_interactions"))


def finding_context(merged_entries: DataFrame) -> DataFrame:
    """AGG-10: distinct applications, last seen and highest count per related finding."""
    known = with_application_size(merged_entries).filter("related_finding_id is not null")
    known = known.withColumnRenamed("related_finding_id", "finding_id")
    return known.groupBy("finding_id").agg(
        F.max("last_interaction").alias("history_last_seen"), F.max("interactions").alias("history_interactions")).join(
        listed_names(known, "finding_id", "history_refs"), "finding_id")


def entry_findings(entries: DataFrame, findings: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """SCL-25: the related finding of an entry, else a finding row built from the entry. `carried` columns come
    from the related finding only; the entry itself stays in the struct `entry`."""
    fields = ["scanner_id", "category", "subcategory", "path", "display_name", "is_directory", "size_bytes",
              "modified_at", "exposure_score", "exposure_reasons"]
    known = findings.select(F.col("finding_id").alias("__finding"), F.struct(*fields, *carried).alias("f"))
    entry = F.struct(*[n for n in entries.columns if n not in ("ordinal", "path_match")]).alias("entry")
    # entries without a finding would meet in one task if Spark has to shuffle them by a null
    lone = F.concat(F.lit("\0"), F.col("ordinal").cast("string"))
    joined = entries.join(known, F.coalesce("related_finding_id", lone) == F.col("__finding"), "left")
    own = {
        "scanner_id": F.lit("application-history"),
        "category": F.when(F.col("is_directory"), F.lit("Directory")).otherwise(paths.file_class("target_path")),
        "subcategory": F.when(F.col("exists"), F.lit("Remembered by an application"))
        .otherwise(F.lit("Historical path")),
        "path": F.col("target_path"),
        "display_name": paths.base_name(paths.trim_separators("target_path")),
        "is_directory": F.col("is_directory"), "size_bytes": F.col("size_bytes"),
        "modified_at": F.coalesce("target_modified_at", "last_interaction"),
        "exposure_score": F.col("historical_score"),
        "exposure_reasons": F.array(F.when(
            F.col("exists"), F.lit("Windows remembers this object in application history"))
            .otherwise(F.lit("Windows retains a historical path to an object that is no longer available"))),
    }
    return joined.select("ordinal", entry, *[F.col(f"f.{n}").alias(n) for n in carried], *[
        F.when(F.col("f").isNotNull(), F.col(f"f.{n}")).otherwise(own[n]).alias(n) for n in fields])


def flattened(grouped: DataFrame) -> DataFrame:
    """SET-4: applications with nested `entries` back to one row per entry."""
    return grouped.select("application_key", F.explode("entries").alias("e")).select("application_key", "e.*")
