"""Queries over files, stored tables and the scanner runner."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import functions as F

from tracelake.operators import archive, exif
from tracelake.plans import oracle as o
from tracelake.plans.packing import pack
from tracelake.plans.registry import query
from tracelake.plans.views import AS_OF, Views, file_path
from tracelake.session import ensure_checkpoint_dir, stored
from tracelake.sources import inventory as inv
from tracelake.sources import scanners, store, text

c = F.col
LAST_CLEAR = "(SELECT path_key, max(updated_at) AS cleared_at FROM feedback_changes WHERE label IS NULL GROUP BY path_key)"


def scratch(v: Views) -> str:
    """A fresh folder beside the checkpoints, in the place all executors share."""
    ensure_checkpoint_dir(v.spark)
    return f"{v.spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


@query("src1_files_below_roots", """
    SELECT path, size_bytes FROM inventory WHERE NOT is_directory AND (starts_with(lower(path), 'c:\\users\\user1\\desktop\\') OR starts_with(lower(path), 'c:\\users\\user1\\pictures\\'))""", ("inventory",))
def _(v: Views):
    roots = v.spark.createDataFrame([("C:/Users/user1/Desktop/",), ("c:\\users\\USER1\\pictures",)], "path string")
    return inv.files_below(v.inventory, roots).select("path", "size_bytes")


def unpacked(root: str):
    """Writes (name, text) as files below a folder that all tasks see, and gives back the names."""
    def run(batches):
        for batch in batches:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                path = f"{root}/{name}"
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as out:
                    out.write((body or "").encode())
            yield batch.select(["name"])

    return run


@query("src1_walked_folders", """
    SELECT name, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size_bytes FROM (
      SELECT coalesce(lang, 'none') || '/' || (doc_id % 7) || '/' || (doc_id % 3) || '/' || doc_id || '.txt' AS name, text FROM documents)""")
def _(v: Views):
    """The documents as files of a tree, found again by walking it."""
    root = re.sub(r"^file:/*", "/", scratch(v))
    number = lambda n: (c("doc_id") % n).cast("string")
    name = F.concat_ws("/", F.coalesce("lang", F.lit("none")), number(7), number(3), F.concat(c("doc_id").cast("string"), F.lit(".txt")))
    v.documents.select(name.alias("name"), "text").mapInArrow(unpacked(root), "name string").write.format("noop").mode("overwrite").save()
    files = inv.walked(v.spark, [root]).filter("NOT is_directory")
    return files.select(F.expr(f"substring(path, {len(root) + 2})").alias("name"), "size_bytes")


@query("src4_plain_text", f"""
    SELECT finding_id, length(text) AS chars, md5(text) AS digest FROM documents JOIN inventory ON ordinal = doc_id
    WHERE {o.extension('path')} IN {o.in_list(o.fixed.PLAIN_TEXT_EXTENSIONS)}""", ("inventory",))
def _(v: Views):
    """The path is a function of the number beside the text, so no text is moved."""
    files = v.documents.select(file_path(c("doc_id")).alias("path"), F.concat(F.lit("f"), F.lpad(c("doc_id").cast("string"), 10, "0")).alias("finding_id"),
                               c("text").cast("binary").alias("content"))
    return text.plain_files(files).select("finding_id", F.length("text").cast("long").alias("chars"), F.md5(c("text").cast("binary")).alias("digest"))


def office_files(v: Views):
    return pack(v.documents.select(F.concat(F.lit("C:\\office\\d"), c("doc_id").cast("string"), F.lit(".docx")).alias("path"), "text", c("source").alias("author")))


LINES = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: x), lambda x: trim(x) <> ''), ' ')"


@query("src5_office_text", f"""
    SELECT 'C:\\office\\d' || doc_id || '.docx' AS path, length({LINES} || ' note') AS chars, md5({LINES} || ' note') AS digest FROM documents""")
def _(v: Views):
    read = text.office_text(text.office_members(office_files(v)))
    return read.select("path", F.length("text").cast("long").alias("chars"), F.md5(c("text").cast("binary")).alias("digest"))


DAMAGE = ["", "malformed", "marked", "torn", "none"]


@query("src5_damaged_files", f"""
    SELECT 'C:\\office\\d' || doc_id || '.docx' AS path, nullif(CASE doc_id % 5 WHEN 0 THEN b || ' note' WHEN 1 THEN b WHEN 2 THEN b || ' note' WHEN 3 THEN 'note' END, '') AS text,
           CASE WHEN doc_id % 5 IN (1, 3, 4) THEN CAST(1 AS BIGINT) ELSE 0 END AS errors
    FROM (SELECT doc_id, {LINES} AS b FROM documents)""")
def _(v: Views):
    """Malformed, marked and damaged members and files that are no zip: the rest is read, each bad one is reported."""
    damage = F.element_at(F.array(*map(F.lit, DAMAGE)), (c("doc_id") % 5 + 1).cast("int"))
    files = pack(v.documents.select(F.concat(F.lit("C:\\office\\d"), c("doc_id").cast("string"), F.lit(".docx")).alias("path"), "text",
                                    c("source").alias("author"), damage.alias("damage")))
    members = stored(text.office_members(files))
    errors = text.reading_errors(members).groupBy("path").agg(F.count(F.lit(1)).alias("errors"))
    return (text.office_text(members).join(errors, "path", "full")
            .select("path", "text", F.coalesce("errors", F.lit(0).cast("long")).alias("errors")))


@query("src5_vast_members", f"""
    SELECT 'C:\\office\\d' || doc_id || '.docx' AS path, nullif({LINES} || (CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' note' END), '') AS text,
           CASE WHEN doc_id % 3 = 0 THEN 'word/footnotes.xml' END AS member, CASE WHEN doc_id % 3 = 0 THEN 'ValueError: more than 1000000 bytes unpacked' END AS error
    FROM documents""")
def _(v: Views):
    """A member that unpacks to far more than its file is given up at a bound and reported; the rest is read."""
    damage = F.when(c("doc_id") % 3 == 0, F.lit("vast")).otherwise(F.lit(""))
    files = pack(v.documents.select(F.concat(F.lit("C:\\office\\d"), c("doc_id").cast("string"), F.lit(".docx")).alias("path"), "text",
                                    c("source").alias("author"), damage.alias("damage")))
    members = stored(text.office_members(files, 1_000_000))
    return text.office_text(members).join(text.reading_errors(members), "path", "full")


@query("src5_sheets_and_slides", f"""
    SELECT 'C:\\office\\d' || doc_id || (CASE WHEN doc_id % 2 = 0 THEN '.xlsx' ELSE '.pptx' END) AS path, length({LINES}) AS chars, md5({LINES}) AS digest FROM documents""")
def _(v: Views):
    kind = F.when(c("doc_id") % 2 == 0, F.lit(".xlsx")).otherwise(F.lit(".pptx"))
    files = pack(v.documents.select(F.concat(F.lit("C:\\office\\d"), c("doc_id").cast("string"), kind).alias("path"), "text", c("source").alias("author")))
    return text.office_text(text.office_members(files)).select("path", F.length("text").cast("long").alias("chars"), F.md5(c("text").cast("binary")).alias("digest"))


@query("exf2_office_properties", """
    SELECT 'C:\\office\\d' || doc_id || '.docx' AS path, source AS author, '2020-01-01' AS taken, 'Author,DateTaken' AS fields, 'High' AS exposure_level FROM documents""")
def _(v: Views):
    read = exif.office_disclosure(text.office_members(office_files(v)))
    return read.select("path", "exif.author", c("exif.date_taken").alias("taken"), F.array_join("exif.disclosed_fields", ",").alias("fields"), "exif.exposure_level")


@query("arc1_archive_listing", """
    SELECT 'C:\\zips\\z' || doc_id || '.zip' AS archive, CAST(5 AS BIGINT) AS entries, CAST(1 AS BIGINT) AS sensitive, 'docs/passport_scan.jpg' AS first_hit,
           strlen(text) AS readme_bytes FROM documents""")
def _(v: Views):
    zips = pack(v.documents.select(F.concat(F.lit("C:\\zips\\z"), c("doc_id").cast("string"), F.lit(".zip")).alias("path"), "text", c("source").alias("author")))
    rows = archive.classified(text.archive_entries(zips))
    return rows.groupBy("archive").agg(
        F.count(F.lit(1)).alias("entries"), F.count("rule").alias("sensitive"),
        F.min(F.when(c("rule").isNotNull(), c("entry_name"))).alias("first_hit"),
        F.max(F.when(c("entry_name") == "README.md", c("size_bytes"))).alias("readme_bytes"))


class Files:
    name = "filesystem"

    def scan(self, spark, context):
        return inv.file_findings(context["views"].inventory).select("scanner_id", "category", "path")


class Development:
    name = "development"

    def scan(self, spark, context):
        return inv.development_directories(context["views"].inventory).select("scanner_id", "category", "path")


class Profiles:
    name = "profiles"

    def scan(self, spark, context):
        return inv.user_profiles(context["views"].inventory).select("scanner_id", "category", "path")


class Broken:
    name = "broken"

    def scan(self, spark, context):
        raise RuntimeError("no access")


UNION = """SELECT category, count(*) AS rows_found FROM findings GROUP BY category {system}"""
SYSTEM = """UNION ALL SELECT 'Development', count(DISTINCT regexp_extract(path, '^.*\\\\(node_modules|\\.venv)')) FROM inventory
    WHERE regexp_matches(path, '\\\\(node_modules|\\.venv)\\\\') UNION ALL SELECT 'User profile', count(DISTINCT regexp_extract(path, '^C:\\\\Users\\\\[^\\\\]+')) FROM inventory"""


def scan(v: Views, preset: str):
    chosen = scanners.scanners_for(preset, [Files()], [Broken(), Development(), Profiles()])
    return scanners.run_scanners(v.spark, chosen, {"views": v})


@query("src9_full_scan", UNION.format(system=SYSTEM), ("findings", "inventory"))
def _(v: Views):
    return scan(v, "Full")[0].groupBy("category").agg(F.count(F.lit(1)).alias("rows_found"))


@query("src10_quick_scan", UNION.format(system=""), ("findings",))
def _(v: Views):
    return scan(v, "Quick")[0].groupBy("category").agg(F.count(F.lit(1)).alias("rows_found"))


@query("src9_run_rows", """
    SELECT 'filesystem' AS scanner_id, (SELECT count(*) FROM findings) AS findings, 0 AS errors UNION ALL SELECT 'broken', 0, 1
    UNION ALL SELECT 'development', (SELECT count(DISTINCT regexp_extract(path, '^.*\\\\(node_modules|\\.venv)')) FROM inventory
      WHERE regexp_matches(path, '\\\\(node_modules|\\.venv)\\\\')), 0
    UNION ALL SELECT 'profiles', (SELECT count(DISTINCT regexp_extract(path, '^C:\\\\Users\\\\[^\\\\]+')) FROM inventory), 0""", ("findings", "inventory"))
def _(v: Views):
    return scan(v, "Full")[1].select("scanner_id", "findings", "errors")


@query("snk1_saved_scan", "SELECT CAST(ordinal % 3 AS VARCHAR) AS scan_id, count(*) AS findings, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM findings GROUP BY ordinal % 3", ("findings",))
def _(v: Views):
    tables = store.Tables(v.spark, scratch(v))
    rows = v.findings.select(
        "finding_id", "ordinal", "scanner_id", "category", "subcategory", "path", "display_name", "is_directory", "size_bytes", "created_at", "modified_at",
        F.lit(None).cast("timestamp").alias("last_access_at"), "exposure_score", "exposure_reasons", F.lit("{}").alias("metadata"), "ignored",
        (c("ordinal") % 3).cast("string").alias("scan_id"))
    scans = v.scans.select("scan_id", "started_at", "finished_at", *[F.lit("").alias(n) for n in ("host", "os_version", "app_version")])
    tables.save_scan(scans.limit(0), rows.filter("ordinal % 3 = 0"))
    tables.save_scan(scans, rows.filter("ordinal % 3 <> 0"))
    return tables.read("findings").groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings"), F.sum("size_bytes").alias("bytes"))


@query("snk2_snapshot_round_trip", """
    SELECT finding_id, coalesce(CASE WHEN ordinal % 5 <> 0 THEN category END, 'Other') AS category, size_bytes, false AS is_directory, reasons, modified_at FROM findings""", ("findings",))
def _(v: Views):
    folder = scratch(v)
    rows = v.findings.withColumn("last_access_at", F.lit(None).cast("timestamp")).withColumn("metadata", F.lit(None).cast("string"))
    store.write_snapshot(rows.withColumn("category", F.when(c("ordinal") % 5 != 0, c("category"))), folder)
    return store.read_snapshot(v.spark, folder).select("finding_id", "category", "size_bytes", "is_directory",
                                                       F.concat_ws("; ", "exposure_reasons").alias("reasons"), c("modified_at").cast("timestamp_ntz").alias("modified_at"))


@query("snk8_reset_keeps_feedback", "SELECT CAST(0 AS BIGINT) AS scans, count(*) AS feedback FROM feedback", ("feedback",))
def _(v: Views):
    tables = store.Tables(v.spark, scratch(v))
    tables.append("scans", v.scans.select("*", *[F.lit("").alias(n) for n in ("host", "os_version", "app_version")]))
    tables.append("feedback", v.feedback)
    tables.delete_audit_results()
    kept = tables.read("scans").agg(F.count(F.lit(1)).alias("n")).scalar()
    return tables.read("feedback").agg(F.count(F.lit(1)).alias("feedback")).withColumn("scans", kept)


@query("snk10_feedback_cleared", "SELECT CAST(0 AS BIGINT) AS feedback, count(*) AS exclusions FROM exclusions", ("exclusions",))
def _(v: Views):
    tables = store.Tables(v.spark, scratch(v))
    tables.append("feedback", v.feedback)
    tables.append("exclusions", v.exclusions)
    tables.delete_feedback()
    kept = tables.read("feedback").agg(F.count(F.lit(1)).alias("n")).scalar()
    return tables.read("exclusions").agg(F.count(F.lit(1)).alias("exclusions")).withColumn("feedback", kept)


@query("snk3_feedback_upsert", f"""
    SELECT path_key, arg_max(label, (updated_at, finding_id)) AS label, min(since) AS created_at, max(updated_at) AS updated_at
    FROM (SELECT path_key, finding_id, label, updated_at, created_at AS since FROM feedback
          UNION ALL SELECT path_key, finding_id, label, updated_at, updated_at FROM feedback_changes) r
    LEFT JOIN {LAST_CLEAR} l USING (path_key) WHERE cleared_at IS NULL OR updated_at > cleared_at GROUP BY path_key""", ("feedback", "feedback_changes"))
def _(v: Views):
    return store.feedback_after(v.feedback, v.feedback_changes).select("path_key", "label", "created_at", "updated_at")


@query("snk4_change_events", """
    SELECT path_key, CASE WHEN label IS NULL THEN 'FeedbackCleared' WHEN label THEN 'FeedbackLiked' ELSE 'FeedbackDisliked' END AS event_type, updated_at AS created_at FROM feedback_changes""", ("feedback_changes",))
def _(v: Views):
    return store.change_events(v.feedback_changes, F.monotonically_increasing_id()).select("path_key", "event_type", "created_at")


@query("snk5_result_cache_upsert", f"""
    SELECT path, model_version, scanned_at FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, fresh DESC) AS n FROM (
      SELECT path, model_version, 0 AS fresh, {o.before('vec % 13')} AS scanned_at FROM (SELECT *, CAST(regexp_extract(path, 'M([0-9]+)', 1) AS BIGINT) AS vec FROM stored_results)
      UNION ALL SELECT path, 'v3', 1, {o.before('vec % 7')} FROM (SELECT *, CAST(regexp_extract(path, 'M([0-9]+)', 1) AS BIGINT) AS vec FROM stored_results) WHERE vec % 3 = 0)) WHERE n = 1""", ("stored_results",))
def _(v: Views):
    from tracelake.plans.views import days_before

    n = F.regexp_extract("path", "M([0-9]+)", 1).cast("long")
    new = v.stored_results.filter(n % 3 == 0).withColumn("scanned_at", days_before(n % 7)).withColumn("model_version", F.lit("v3"))
    return store.results_after(v.stored_results, new).select("path", "model_version", "scanned_at")


def replaced(v: Views):
    n = c("ordinal")
    stamp = F.lit(AS_OF).cast("timestamp_ntz")
    current = v.findings.filter(n % 2 == 0).select("finding_id", "path", "size_bytes", "modified_at", F.lit(0).alias("engine_version"), stamp.alias("analyzed_at"), F.lit("old").alias("result"))
    children = v.findings.filter(n % 2 == 0).select(c("finding_id").alias("provenance_id"), F.lit("OLD").alias("evidence_type"), F.lit("d").alias("description"), F.lit(1).alias("weight"), F.lit("s").alias("source"))
    piece = F.struct(F.lit("NEW").alias("evidence_type"), F.lit("d").alias("description"), F.lit(2).alias("weight"), F.lit("s").alias("source"))
    analyzed = v.findings.filter(n % 3 == 0).select("finding_id", "path", "size_bytes", "modified_at", F.lit(1).alias("engine_version"), stamp.alias("analyzed_at"), F.array(piece, piece).alias("evidence"))
    return store.provenance_after(current, children, analyzed)


@query("snk6_provenance_replaced", """
    SELECT finding_id, CASE WHEN ordinal % 3 = 0 THEN 1 ELSE 0 END AS engine_version FROM findings WHERE ordinal % 2 = 0 OR ordinal % 3 = 0""", ("findings",))
def _(v: Views):
    return replaced(v)[0].select("finding_id", "engine_version")


@query("snk6_evidence_replaced", """
    SELECT finding_id AS provenance_id, unnest(CASE WHEN ordinal % 3 = 0 THEN ['NEW', 'NEW'] ELSE ['OLD'] END) AS evidence_type FROM findings WHERE ordinal % 2 = 0 OR ordinal % 3 = 0""", ("findings",))
def _(v: Views):
    return replaced(v)[1].select("provenance_id", "evidence_type")


@query("snk7_exclusions_added", "SELECT path FROM exclusions UNION SELECT DISTINCT regexp_extract(path, '^C:\\\\Users\\\\[^\\\\]+') FROM inventory", ("exclusions", "inventory"))
def _(v: Views):
    return store.exclusions_after(v.exclusions, inv.user_profiles(v.inventory))


@query("snk9_features_refreshed", f"""
    SELECT r.path_key, CASE WHEN f.path IS NOT NULL THEN 2 ELSE schema_version END AS schema_version, CASE WHEN f.path IS NOT NULL THEN {o.DAY0} ELSE updated_at END AS updated_at
    FROM feedback r LEFT JOIN (SELECT path FROM findings WHERE ordinal % 2 = 0) f ON upper(f.path) = r.path_key""", ("feedback", "findings"))
def _(v: Views):
    fresh = v.findings.filter("ordinal % 2 = 0").select(F.upper("path").alias("path_key"), F.lit('{"a":1}').alias("feature_json"))
    return store.feedback_refreshed(v.feedback, fresh, F.lit(AS_OF).cast("timestamp_ntz")).select("path_key", "schema_version", "updated_at")


@query("src11_feedback_of_version", "SELECT path_key, label FROM feedback WHERE schema_version = 2", ("feedback",))
def _(v: Views):
    tables = store.Tables(v.spark, scratch(v))
    tables.append("feedback", v.feedback)
    return store.feedback_of(tables.read("feedback"), 2).select("path_key", "label")


@query("src11_provenance_of_findings", """
    SELECT finding_id, CASE WHEN ordinal % 3 = 0 THEN 1 ELSE 0 END AS engine_version FROM findings WHERE ordinal % 6 IN (0, 2)""", ("findings",))
def _(v: Views):
    """The stored analysis of a finding is read by id and path: one that has moved has none."""
    tables = store.Tables(v.spark, scratch(v))
    tables.append("provenance", replaced(v)[0])
    n = c("ordinal")
    asked = v.findings.filter(n % 6 != 4).withColumn("path", F.when(n % 6 == 3, F.concat("path", F.lit(".moved"))).otherwise(c("path")))
    return store.provenance_of(tables.read("provenance"), asked).select("finding_id", "engine_version")


@query("snk10_provenance_cleared", "SELECT CAST(0 AS BIGINT) AS provenance, CAST(0 AS BIGINT) AS evidence, count(*) AS feedback FROM feedback", ("feedback",))
def _(v: Views):
    tables = store.Tables(v.spark, scratch(v))
    rows, evidence = replaced(v)
    tables.append("feedback", v.feedback)
    tables.append("provenance", rows)
    tables.append("provenance_evidence", evidence)
    tables.delete_provenance()

    def left(name: str):
        return tables.read(name).agg(F.count(F.lit(1)).alias("n")).scalar()

    return (tables.read("feedback").agg(F.count(F.lit(1)).alias("feedback")).withColumn("provenance", left("provenance"))
            .withColumn("evidence", left("provenance_evidence")))
