"""Learned attention score: features, training gate, model, batch scoring and explanations."""

from __future__ import annotations

import json
import logging
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake import fixed
from tracelake.functions import paths, scalars
from tracelake.operators import evidence as ev
from tracelake.session import discard, stored

# Feature names in the stored feature document.
NUMERIC = [
    "ExposureScore", "LogFileSize", "FileAgeDays", "PersonalDataMatches", "SecretMatches", "IdentityMentions",
    "ArchiveSensitiveEntries", "DocumentConfidence", "FaceCount", "ExifFieldCount", "HistoryInteractionCount",
    "HistoryDaysSinceInteraction",
]
BOOLEAN = [
    "IsRecent", "IsJumpList", "IsSearchIndexed", "CredentialConfigDetected", "IdentityTraceDetected", "IsArchive",
    "DocumentLike", "PeopleDetected", "HasGps", "HasExif", "HasCameraSerial", "EntropySecretDetected",
    "ScreenshotLike", "IsApplicationHistory", "HistoryTargetExists", "HistoryPinned", "HistoryNetworkPath",
    "HistoryHasAuditFinding",
]
CATEGORICAL = [
    "Extension", "FileCategory", "DirectoryCategory", "ScannerCategory", "ItemSource", "ApplicationCategory",
    "HistorySourceKind",
]
CATEGORY_DEFAULTS = {
    "Extension": "(none)", "FileCategory": "Other", "DirectoryCategory": "Other", "ScannerCategory": "Other",
    "ItemSource": "Finding", "ApplicationCategory": "(none)", "HistorySourceKind": "(none)",
}
FEATURE_TYPE = T.StructType([T.StructField(n, T.FloatType()) for n in NUMERIC + BOOLEAN]
                            + [T.StructField(n, T.StringType()) for n in CATEGORICAL])
SPLIT_SEED = 1701
TOP = 20


def flag(condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0)


def number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def log_size(size: Column) -> Column:
    return F.log10(F.greatest(F.lit(1), size).cast("double"))


def capped_age(ts: Column | str, as_of: datetime) -> Column:
    old = F.greatest(F.lit(0.0), scalars.days_since(ts, as_of))
    return F.least(F.lit(float(fixed.FEATURE_AGE_CAP_DAYS)), F.coalesce(old, F.lit(0.0)))


def finding_features(as_of: datetime) -> dict[str, Column]:
    """ML-1: one column per feature of a finding row with its evidence structs."""
    c = F.col
    name = F.lower("display_name")
    entropy = F.exists(c("secrets.categories"), lambda k: F.lower(k).contains("entropy"))
    values = {n: F.lit(0) for n in NUMERIC + BOOLEAN}
    values |= {
        "ExposureScore": c("exposure_score"), "LogFileSize": log_size(c("size_bytes")),
        "FileAgeDays": capped_age("modified_at", as_of), "PersonalDataMatches": number("pii.total_matches"),
        "SecretMatches": number("secrets.total_matches"), "IdentityMentions": number("identity.total_mentions"),
        "ArchiveSensitiveEntries": number("archive.sensitive_entries_count"),
        "DocumentConfidence": number("document.confidence"), "FaceCount": number("people.face_count"),
        "ExifFieldCount": F.when(c("exif.disclosed_fields").isNotNull(), F.size("exif.disclosed_fields")).otherwise(0),
        "IsRecent": flag(F.lower("category") == "recent"), "IsJumpList": flag(F.lower("category") == "jump lists"),
        "IsSearchIndexed": flag(F.lower("scanner_id").contains("search")),
        "CredentialConfigDetected": flag(ev.true("config.is_credential_config")),
        "IdentityTraceDetected": flag(ev.true("identity.has_identity_trace")),
        "IsArchive": flag(ev.true("archive.is_archive")), "DocumentLike": flag(ev.true("document.is_document")),
        "PeopleDetected": flag(ev.true("people.people_detected")), "HasGps": flag(ev.true("exif.has_geolocation")),
        "HasExif": flag(ev.has_fields()), "HasCameraSerial": flag(F.trim("exif.camera_serial_number") != ""),
        "EntropySecretDetected": flag(entropy),
        "ScreenshotLike": flag(name.contains("screenshot") | name.contains("скриншот")),
        "Extension": F.coalesce(F.nullif(paths.extension("path"), F.lit("")), F.lit("(none)")),
        "FileCategory": paths.file_class("path"), "DirectoryCategory": paths.directory_kind("path"),
        "ScannerCategory": c("scanner_id"), "ItemSource": F.lit("Finding"), "ApplicationCategory": F.lit("(none)"),
        "HistorySourceKind": F.lit("(none)"),
    }
    return values


def packed(values: dict[str, Column]) -> Column:
    return F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in FEATURE_TYPE.fields])


def with_features(findings: DataFrame, as_of: datetime, out: str = "features") -> DataFrame:
    return findings.withColumn(out, packed(finding_features(as_of)))


def with_history_features(rows: DataFrame, as_of: datetime, out: str = "features") -> DataFrame:
    """ML-2: rows of `history.entry_findings` joined to their entry (prefix `entry.`) and evidence."""
    e = {n: F.col(f"entry.{n}") for n in ("last_interaction", "interactions", "pinned", "exists", "size_bytes",
                                          "target_path", "target_modified_at", "related_finding_id",
                                          "application_name", "source_kind")}
    values = finding_features(as_of)

    def named(value: Column, fallback: str) -> Column:
        return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(fallback))

    values |= {
        "ItemSource": F.lit("ApplicationHistory"),
        "ApplicationCategory": named(e["application_name"], fixed.UNKNOWN_APPLICATION),
        "HistorySourceKind": named(e["source_kind"], "Unknown"), "IsApplicationHistory": F.lit(1), "IsJumpList": F.lit(1),
        "HistoryTargetExists": flag(e["exists"]), "HistoryPinned": flag(e["pinned"]),
        "HistoryNetworkPath": flag(e["target_path"].startswith("\\\\")),
        "HistoryHasAuditFinding": flag(e["related_finding_id"].isNotNull()),
        "HistoryInteractionCount": F.log10(F.greatest(F.lit(1), e["interactions"] + 1).cast("double")),
        "HistoryDaysSinceInteraction": capped_age(e["last_interaction"], as_of),
        "LogFileSize": F.when(e["size_bytes"] > 0, log_size(e["size_bytes"])).otherwise(values["LogFileSize"]),
        "FileAgeDays": F.when(e["target_modified_at"].isNotNull(), capped_age(e["target_modified_at"], as_of))
        .otherwise(values["FileAgeDays"]),
    }
    return rows.withColumn(out, packed(values))


def stored_features(document: Column) -> Column:
    """Features out of a stored JSON document; missing ones get their defaults, a broken document gives null."""
    raw = F.from_json(document, FEATURE_TYPE)
    defaults = {**{n: F.lit(0.0) for n in NUMERIC + BOOLEAN}, **{n: F.lit(d) for n, d in CATEGORY_DEFAULTS.items()}}
    filled = packed({n: F.coalesce(raw[n], default) for n, default in defaults.items()})
    return F.when(F.try_parse_json(document).isNotNull(), filled)


def explanation() -> Column:
    """TOP-4: the first three factors that apply, in fixed order, over a `features` struct."""
    f = {n: F.col(f"features.{n}") for n in NUMERIC + BOOLEAN}
    hits = [
        f["PersonalDataMatches"] > 0, (f["SecretMatches"] > 0) | (f["CredentialConfigDetected"] > 0),
        f["FileAgeDays"] >= 730, (f["HasGps"] > 0) | (f["HasCameraSerial"] > 0), f["DocumentLike"] > 0,
        f["PeopleDetected"] > 0,
    ]
    factors = F.array(*[F.when(hit, F.lit(text)) for hit, text in zip(hits, fixed.EXPLANATION_FACTORS)])
    return F.slice(F.array_compact(factors), 1, 3)


def pipeline() -> Pipeline:
    """ML-3: one-hot categories, scaled numbers, elastic-net logistic regression (L1 0.001, L2 0.01)."""
    indexed, encoded = [f"{n}Index" for n in CATEGORICAL], [f"{n}Encoded" for n in CATEGORICAL]
    return Pipeline(stages=[
        StringIndexer(inputCols=CATEGORICAL, outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep", dropLast=False),
        VectorAssembler(inputCols=NUMERIC + BOOLEAN + encoded, outputCol="assembled"),
        StandardScaler(inputCol="assembled", outputCol="scaled", withMean=False, withStd=True),
        LogisticRegression(featuresCol="scaled", labelCol="target", maxIter=30, tol=1e-4, regParam=0.011,
                           elasticNetParam=1 / 11, standardization=False),
    ])


def samples(rows: DataFrame) -> DataFrame:
    """Training rows (label, features, perhaps path_key) as flat columns, with a key of their own."""
    key = F.col("path_key") if "path_key" in rows.columns else F.to_json("features")
    return rows.select("features.*", F.col("label").cast("double").alias("target"), key.alias("row_id"))


def fold(key: str, folds: int = 5) -> Column:
    """A number below `folds` from the md5 of the key, which any database can repeat."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SPLIT_SEED}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % folds


def precision_at(scored: DataFrame, order: str, top: int = TOP) -> tuple[int, int]:
    """TOP-3: positives among the first `top` rows, and how many rows there were."""
    row = (scored.orderBy(F.desc(order), F.asc("row_id")).limit(top)
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("target") > 0).alias("good")).first())
    return row["good"], row["n"]


def score_metrics(scored: DataFrame) -> DataFrame:
    """ML-4 of stored scores (row_id, target 0 or 1, score 0 to 1, baseline), one row: accuracy, precision, recall and F1 at one
    half, the area under the receiver curve by rank sums (ties count half), average precision, and the positives among
    the first 20 by score and by baseline. Counts are gathered by distinct score first; without positives or
    negatives the figures that need them are 0.
    """
    positive, liked = F.col("target") > 0, F.col("score") > 0.5
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    by = scored.groupBy("score").agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    falling = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = by.select("score", "pos", "neg", F.sum("pos").over(falling).alias("tp"), F.sum("neg").over(falling).alias("fp"))
    sums = run.agg(
        F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).alias("n"), F.coalesce(F.sum("pos"), F.lit(0)).alias("p"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("f"),
        F.coalesce(F.sum(F.when(liked, F.col("pos")).otherwise(0)), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(liked, F.col("neg")).otherwise(0)), F.lit(0)).alias("fp"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("wins"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precisions"))
    top = lambda order: (scored.orderBy(F.desc(order), F.asc("row_id")).limit(TOP)
                         .agg(F.count("*").alias(f"shown_{order}"), F.count_if(positive).alias(f"good_{order}")))
    row = sums.crossJoin(top("score")).crossJoin(top("baseline"))  # one row each
    c = F.col
    precision, recall = share(c("tp"), c("tp") + c("fp")), share(c("tp"), c("p"))
    return row.select(
        c("n").alias("validation_samples"), share(c("tp") + c("f") - c("fp"), c("n")).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"), share(2 * precision * recall, precision + recall).alias("f1"),
        share(c("wins"), c("p") * c("f")).alias("roc_auc"), share(c("precisions"), c("p")).alias("pr_auc"),
        share(c("good_score"), c("shown_score")).alias("precision_at_20"),
        share(c("good_baseline"), c("shown_baseline")).alias("baseline_precision_at_20"),
        F.greatest(F.lit(0).cast("long"), c("good_score") - c("good_baseline")).alias("lifted_into_top_20"))


def validation_metrics(rows: DataFrame) -> dict:
    """ML-4: metrics on a held-out fifth, chosen by a hash of the row's key, so that training and test never share one.
    Scores are stored once for all metrics."""
    held = fold("row_id") == 0
    scored = pipeline().fit(rows.filter(~held)).transform(rows.filter(held))
    scored = stored(scored.select("row_id", "target", vector_to_array("probability")[1].alias("score"), F.col("ExposureScore").alias("baseline")))
    metrics = score_metrics(scored).first().asDict()
    discard(scored)
    return metrics


def train(rows: DataFrame) -> tuple[PipelineModel, dict]:
    """ML-4: gate, metrics from 25 samples on, final fit on everything. Feedback is kept to 100,000 rows, so the
    training set is bounded."""
    ready = stored(samples(rows))
    stats = ready.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("target") > 0).alias("positive")).first()
    total, positive = stats["total"], stats["positive"]
    negative = total - positive
    enough = total >= fixed.TRAIN_MINIMUM and min(positive, negative) >= fixed.TRAIN_MINIMUM_PER_CLASS
    if not enough or min(positive, negative) / total < fixed.TRAIN_MINORITY_FRACTION:
        raise ValueError("training sample requirements are not met")
    metrics = validation_metrics(ready) if total >= 25 else None
    model = pipeline().fit(ready)
    return model, {"model_type": "LogisticRegression", "positive_samples": positive, "negative_samples": negative,
                   "trained_samples": total, "feature_schema_version": fixed.FEATURE_SCHEMA_VERSION,
                   "validation_metrics": metrics}


def with_personal_score(findings: DataFrame, model: PipelineModel | None) -> DataFrame:
    """ML-5: rows need a `features` struct; without a model the score is null."""
    if model is None:
        return findings.withColumn("personal_score", F.lit(None).cast("float"))
    flat = findings.drop("personal_score").select("*", *[F.col(f"features.{f.name}").alias(f.name) for f in FEATURE_TYPE.fields])
    share = vector_to_array(F.col("probability"))[1] * 100
    kept = [c for c in findings.columns if c != "personal_score"]
    return (model.transform(flat)
            .withColumn("personal_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)).cast("float"))
            .select(*kept, "personal_score"))


def save_model(spark: SparkSession, model: PipelineModel, metadata: dict, folder: str) -> None:
    """ML-6: the model and, beside it, its metadata."""
    model.write().overwrite().save(f"{folder}/model")
    row = spark.createDataFrame([(json.dumps(metadata),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")


def load_model(spark: SparkSession, folder: str) -> tuple[PipelineModel, dict] | None:
    """ML-6: nothing when the files are missing or were written for another feature schema."""
    try:
        metadata = json.loads(spark.read.text(f"{folder}/metadata").first()["value"])
        if metadata.get("feature_schema_version") != fixed.FEATURE_SCHEMA_VERSION:
            return None
        return PipelineModel.load(f"{folder}/model"), metadata
    except AnalysisException:  # nothing has been saved there
        return None
    except Exception as problem:  # a broken model counts as not trained
        logging.getLogger(__name__).warning("the model in %s cannot be read: %s", folder, problem)
        return None
