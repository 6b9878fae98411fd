"""Stored audit tables: explicit schemas, keyed reads, appends and upserts.

A table is a folder of Parquet. Upserts are written as DataFrame-to-DataFrame functions; `replace` publishes the new
content as the next generation, so a reader or a failed job never sees half a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake import fixed
from tracelake.operators.ordering import first_per_group
from tracelake.session import stored

FINDINGS = (
    "finding_id string, ordinal long, scanner_id string, category string, subcategory string, path string, "
    "display_name string, is_directory boolean, size_bytes long, created_at timestamp, modified_at timestamp, "
    "last_access_at timestamp, exposure_score int, exposure_reasons array<string>, metadata string, ignored boolean")
TABLES = {
    "scans": "scan_id string, started_at timestamp, finished_at timestamp, host string, os_version string, "
             "app_version string",
    "findings": FINDINGS + ", scan_id string",
    "exclusions": "path string",
    "feedback": "finding_id string, path_key string, label boolean, created_at timestamp, updated_at timestamp, "
                "schema_version int, feature_json string",
    "feature_events": "id long, finding_id string, path_key string, event_type string, created_at timestamp, "
                      "schema_version int, feature_json string",
    "provenance": "finding_id string, path string, size_bytes long, modified_at timestamp, engine_version int, "
                  "analyzed_at timestamp, result string",
    "provenance_evidence": "provenance_id string, evidence_type string, description string, weight int, source string",
    "people_results": "path string, file_size long, file_modified_at timestamp, model_version string, status string, "
                      "people_detected boolean, face_count int, max_confidence double, scanned_at timestamp, error string",
    "image_safety_results": "path string, file_size long, file_modified_at timestamp, model_version string, "
                            "status string, primary_class string, nsfl_score double, nsfw_score double, "
                            "sfw_score double, scanned_at timestamp, error string",
}
AUDIT_TABLES = ["provenance_evidence", "provenance", "findings", "scans"]
EVENT_NAMES = {True: "FeedbackLiked", False: "FeedbackDisliked", None: "FeedbackCleared"}


class Tables:
    """Folders of Parquet below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folders(self, name: str) -> list[int]:
        """Published generations: Spark writes _SUCCESS only after the job committed."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = place.getFileSystem(conf)
        if not files.exists(place):
            return []
        found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/generation=*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def read(self, name: str) -> DataFrame:
        """SRC-11: explicit schema, never inferred; an unwritten table is empty."""
        schema = T.StructType.fromDDL(TABLES[name])
        folders = self._folders(name)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/generation={folders[-1]}")

    def _write(self, name: str, df: DataFrame, generation: int, mode: str) -> None:
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(TABLES[name]).fields])
        writer = rows.write.mode(mode)
        if name == "findings":
            writer = writer.partitionBy("scan_id")
        writer.parquet(f"{self.root}/{name}/generation={generation}")

    def append(self, name: str, df: DataFrame) -> None:
        """SNK-1, SNK-4."""
        folders = self._folders(name)
        self._write(name, df, folders[-1] if folders else 1, "append")

    def replace(self, name: str, df: DataFrame) -> None:
        """Publish new content that may be derived from the current one."""
        folders = self._folders(name)
        self._write(name, df, folders[-1] + 1 if folders else 1, "overwrite")

    def clear(self, *names: str) -> None:
        for name in names:
            self.replace(name, self.spark.createDataFrame([], T.StructType.fromDDL(TABLES[name])))

    def save_scan(self, scan: DataFrame, findings: DataFrame) -> None:
        """SNK-1: one scan row and its findings, partitioned by scan."""
        self.append("findings", findings)
        self.append("scans", scan)

    def delete_audit_results(self) -> None:
        """SNK-8: feedback, events and exclusions stay."""
        self.clear(*AUDIT_TABLES)

    def delete_feedback(self) -> None:
        """SNK-10."""
        self.clear("feedback", "feature_events")

    def delete_provenance(self) -> None:
        """SNK-10."""
        self.clear("provenance_evidence", "provenance")


# --- keyed reads ----------------------------------------------------------------------------------

def events_of(events: DataFrame, path_key: str | None = None) -> DataFrame:
    """SRC-11: in id order."""
    rows = events if path_key is None else events.filter(F.col("path_key") == path_key)
    return rows.orderBy("id")


def feedback_of(feedback: DataFrame, version: int | None = None) -> DataFrame:
    return feedback if version is None else feedback.filter(F.col("schema_version") == version)


def provenance_of(provenance: DataFrame, findings: DataFrame) -> DataFrame:
    return provenance.join(findings.select("finding_id", "path"), ["finding_id", "path"])


# --- upserts --------------------------------------------------------------------------------------

def feedback_after(current: DataFrame, changes: DataFrame) -> DataFrame:
    """SNK-3: one row per path key. The latest change wins, a null label deletes, and the creation time is the
    first change since the last clear. `changes` has the feedback columns but created_at; labels may be null.

    Two partial aggregates and one key lookup: no key is ever gathered in one task.
    """
    fields = ["finding_id", "label", "updated_at", "schema_version", "feature_json"]
    stored = current.select("path_key", *fields, F.col("created_at").alias("since"))
    new = changes.select("path_key", *fields, F.col("updated_at").alias("since"))
    rows = stored.unionByName(new).withColumn("path_key", F.upper("path_key"))
    cleared = rows.filter("label is null").groupBy("path_key").agg(F.max("updated_at").alias("cleared_at"))
    alive = (rows.join(cleared, "path_key", "left")
             .filter(F.col("cleared_at").isNull() | (F.col("updated_at") > F.col("cleared_at"))))
    latest = F.max_by(F.struct(*fields), F.struct("updated_at", "finding_id"))
    return (alive.groupBy("path_key").agg(latest.alias("r"), F.min("since").alias("created_at"))
            .select("r.finding_id", "path_key", "r.label", "created_at", "r.updated_at", "r.schema_version",
                    "r.feature_json"))


def change_events(changes: DataFrame, next_id: Column) -> DataFrame:
    """SNK-3: every change is also an event."""
    kind = (F.when(F.col("label").isNull(), F.lit(EVENT_NAMES[None]))
            .when(F.col("label"), F.lit(EVENT_NAMES[True])).otherwise(F.lit(EVENT_NAMES[False])))
    return changes.select(next_id.alias("id"), "finding_id", F.upper("path_key").alias("path_key"),
                          kind.alias("event_type"), F.col("updated_at").alias("created_at"), "schema_version",
                          "feature_json")


def results_after(current: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-5: the newest detector result per path; a new row wins a tie."""
    rows = current.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
    return first_per_group(rows, ["path"], F.desc("scanned_at"), F.desc("fresh")).drop("fresh")


def provenance_after(current: DataFrame, evidence: DataFrame, analyzed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-6: replace the rows of the analysed findings and all their evidence. `analyzed` carries `evidence`."""
    keys = analyzed.select("finding_id").distinct()
    result = F.to_json(F.struct(*[c for c in analyzed.columns]))
    new = analyzed.select("finding_id", "path", "size_bytes", "modified_at", "engine_version", "analyzed_at",
                          result.alias("result"))
    children = (analyzed.select(F.col("finding_id").alias("provenance_id"), F.inline("evidence")))
    kept = evidence.join(keys.withColumnRenamed("finding_id", "provenance_id"), "provenance_id", "left_anti")
    return current.join(keys, "finding_id", "left_anti").unionByName(new), kept.unionByName(children)


def exclusions_after(current: DataFrame, added: DataFrame) -> DataFrame:
    """SNK-7."""
    return current.select("path").unionByName(added.select("path")).dropDuplicates(["path"])


def feedback_refreshed(feedback: DataFrame, fresh: DataFrame, at: Column) -> DataFrame:
    """SNK-9: new feature documents by path key; untouched rows keep theirs."""
    new = fresh.select("path_key", F.col("feature_json").alias("fresh_json"))
    hit = F.col("fresh_json").isNotNull()
    return (feedback.join(new, "path_key", "left")
            .withColumn("feature_json", F.coalesce("fresh_json", "feature_json"))
            .withColumn("schema_version", F.when(hit, F.lit(fixed.FEATURE_SCHEMA_VERSION)).otherwise(F.col("schema_version")))
            .withColumn("updated_at", F.when(hit, at).otherwise(F.col("updated_at"))).drop("fresh_json"))


# --- snapshots ------------------------------------------------------------------------------------

NOT_IN_SNAPSHOT = ("ordinal", "is_directory")


def snapshot_schema() -> T.StructType:
    return T.StructType([f for f in T.StructType.fromDDL(FINDINGS).fields if f.name not in NOT_IN_SNAPSHOT])


def write_snapshot(findings: DataFrame, folder: str, ceiling: int | None = None) -> None:
    """SNK-2: directory flags, history and personal fields are not kept. With a ceiling, more rows are refused; they are
    then stored once for counting and writing."""
    rows = findings.select(*snapshot_schema().names)
    if ceiling is not None:
        rows = stored(rows)
        if rows.count() > ceiling:
            raise ValueError(f"snapshot exceeds the limit of {ceiling} findings")
    rows.write.mode("overwrite").json(folder)


def read_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """SNK-2: missing values get their defaults."""
    texts = {"scanner_id": "", "category": "Other", "subcategory": "", "path": "", "display_name": "", "metadata": "{}"}
    rows = spark.read.schema(snapshot_schema()).json(folder)
    for name, default in texts.items():
        rows = rows.withColumn(name, F.coalesce(name, F.lit(default)))
    return (rows.withColumn("exposure_reasons", F.coalesce("exposure_reasons", F.array().cast("array<string>")))
            .withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0)))
            .withColumn("exposure_score", F.coalesce("exposure_score", F.lit(0)))
            .withColumn("ignored", F.coalesce("ignored", F.lit(False))).withColumn("is_directory", F.lit(False)))
