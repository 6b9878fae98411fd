"""Counts and sums for dashboards, reports and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.functions import paths, scalars
from tracelake.operators import evidence as ev


def dashboard(findings: DataFrame) -> DataFrame:
    """AGG-1: largest category first."""
    return (findings.filter(~F.col("ignored")).groupBy("category")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("total_bytes"))
            .withColumn("size_text", scalars.human_bytes("total_bytes"))
            .orderBy(F.desc("total_bytes"), F.asc("category")))


def enrichment(findings: DataFrame) -> DataFrame:
    """AGG-2."""
    signals = findings.select(ev.confirmed_signals().alias("signals"))
    return signals.agg(F.count_if(F.col("signals") > 0).alias("enriched"),
                       F.coalesce(F.sum("signals"), F.lit(0)).alias("signals"))


def media_counters(media: DataFrame) -> DataFrame:
    """AGG-3: counted before the view filter."""
    status, seen = F.col("people.people_scan_status"), F.col("people.people_detected")
    return media.agg(
        F.count_if(F.col("people").isNotNull()).alias("records"),
        F.count_if((status == "Completed") & seen).alias("people"),
        F.count_if((status == "Completed") & ~seen).alias("no_people"),
        F.count_if(status == "Error").alias("errors"))


def feedback_stats(feedback: DataFrame, version: int = fixed.FEATURE_SCHEMA_VERSION) -> DataFrame:
    """AGG-11."""
    counted = feedback.filter(F.col("schema_version") == version).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("label").alias("positive"),
        F.count_if(~F.col("label")).alias("negative"))
    return counted.withColumn("can_train", can_train(F.col("total"), F.col("positive"), F.col("negative")))


def can_train(total: Column, positive: Column, negative: Column) -> Column:
    minority = F.least(positive, negative) / F.greatest(F.lit(1), total)
    return ((total >= fixed.TRAIN_MINIMUM) & (positive >= fixed.TRAIN_MINIMUM_PER_CLASS)
            & (negative >= fixed.TRAIN_MINIMUM_PER_CLASS) & (minority >= fixed.TRAIN_MINORITY_FRACTION))


def should_retrain(stats: DataFrame, trained_samples: int, model_ready: bool, features_changed: bool) -> DataFrame:
    """ML-7."""
    due = F.col("total") - trained_samples >= fixed.RETRAIN_INTERVAL
    return stats.withColumn("retrain", F.col("can_train") & (F.lit(features_changed or not model_ready) | due))


def session_progress(routes: DataFrame, state: DataFrame) -> DataFrame:
    """AGG-13: `state` holds one row per touched route."""
    planned = routes.agg(F.count(F.lit(1)).alias("total_routes"))
    done = state.filter(F.col("state").isin("completed", "skipped"))
    finished = done.groupBy("finding_id", "scanner_id").agg(F.first("state").alias("state")).agg(
        F.count(F.lit(1)).alias("n")).scalar()
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("finished_routes") / F.col("total_routes")))
    return (planned.withColumn("finished_routes", finished)
            .withColumn("progress", F.when(F.col("total_routes") == 0, F.lit(0.0)).otherwise(share)))


def category_list(findings: DataFrame) -> DataFrame:
    """AGG-16: distinct ignoring case (first spelling), plus Archives once any archive can be opened."""
    spelled = findings.groupBy(F.lower("category").alias("key")).agg(F.min_by("category", "ordinal").alias("category"))
    archives = (findings.filter(paths.is_openable_archive("path")).limit(1)
                .select(F.lit("archives").alias("key"), F.lit("Archives").alias("category")))
    return (spelled.unionByName(archives).groupBy("key").agg(F.min("category").alias("category"))
            .select("category").orderBy("category"))


def batch_results(results: DataFrame) -> DataFrame:
    """AGG-17 over rows (scanner_id, finding_id, state, confirmed)."""
    return results.groupBy("scanner_id").agg(
        F.count(F.lit(1)).alias("completed"), F.count_if("confirmed").alias("confirmed"),
        F.count_if(F.col("state") == "failed").alias("errors"))


def distinct_ignoring_case(df: DataFrame, column: str, order: str) -> DataFrame:
    """SET-2: the first spelling stands for all."""
    return df.groupBy(F.lower(column).alias("key")).agg(F.min_by(column, order).alias(column)).drop("key")
