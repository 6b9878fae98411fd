"""Queries over archives, metadata tags, photographed documents, media scores and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import archive, document, exif, media, provenance
from tracelake.plans import oracle as o
from tracelake.plans.registry import query
from tracelake.plans.views import AS_OF, Views

c = F.col


def long(name: str):
    return c(name).cast("long").alias(name)


@query("arc2_entry_rules", "SELECT position, rule_category AS category, rule_level AS level FROM rated_entries", ("rated_entries",))
def _(v: Views):
    return archive.classified(v.archive_entries).select("position", "rule.category", "rule.level")


SIZE = """(CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' ELSE CAST(round(size_bytes / CAST(1024 AS DOUBLE), 1) AS VARCHAR) || ' KB' END)"""


@query("arc3_archive_summary", """
    SELECT archive, count(*) AS total_entries, count(rule_level) AS sensitive_entries_count,
           CASE max(CASE rule_level WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 0 END)
             WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Safe' END AS privacy_score, least(count(rule_level), 1000) AS listed
    FROM rated_entries GROUP BY archive""", ("rated_entries",))
def _(v: Views):
    return archive.inspected(v.archive_entries).select(
        "archive", c("archive_inspection.total_entries").cast("long").alias("total_entries"),
        c("archive_inspection.sensitive_entries_count").cast("long").alias("sensitive_entries_count"),
        "archive_inspection.privacy_score", F.size("archive_inspection.entries").cast("long").alias("listed"))


@query("arc3_entry_blocks", """
    SELECT archive, block, count(*) AS entries, string_agg(entry_name, '|' ORDER BY n) AS names, string_agg(DISTINCT rule_level, ',' ORDER BY rule_level) AS levels
    FROM (SELECT *, (row_number() OVER (PARTITION BY archive ORDER BY position, entry_name) - 1) AS n, n // 7 AS block FROM rated_entries WHERE rule_level IS NOT NULL)
    GROUP BY archive, block""", ("rated_entries",))
def _(v: Views):
    """All sensitive entries, seven in a row."""
    rows = archive.entry_blocks(v.archive_entries, 7)
    return rows.select("archive", "block", F.size("entries").cast("long").alias("entries"), F.array_join("entries.entry_name", "|").alias("names"),
                       F.array_join(F.array_sort(F.array_distinct("entries.level")), ",").alias("levels"))


@query("arc4_tree_view", f"""
    SELECT archive, regexp_extract(archive, '[^\\\\]*$') || ' (' || total || ' files, ' || sensitive || ' sensitive):' || coalesce(chr(10) ||
           string_agg(CASE WHEN n BETWEEN 1 AND 1000 THEN (CASE WHEN n = least(sensitive, 1000) THEN '    └─ ' ELSE '    ├─ ' END) || entry_name || ' [' || rule_category || '] (' || {SIZE} || ')' END,
                      chr(10) ORDER BY n), '') || CASE WHEN sensitive > 1000 THEN chr(10) || '    ... and ' || (sensitive - 1000) || ' more sensitive files inside.' ELSE '' END AS tree
    FROM (SELECT *, count(*) OVER (PARTITION BY archive) AS total, count(rule_level) OVER (PARTITION BY archive) AS sensitive,
                 CASE WHEN rule_level IS NOT NULL THEN row_number() OVER (PARTITION BY archive, rule_level IS NULL ORDER BY position) END AS n FROM rated_entries)
    GROUP BY archive, total, sensitive""", ("rated_entries",))
def _(v: Views):
    return archive.inspected(v.archive_entries).select("archive", c("archive_inspection.tree_view").alias("tree"))


TAG_SQL = """(SELECT path, n, CASE WHEN n % 3 = 0 THEN (CASE WHEN n % 2 = 0 THEN -1 ELSE 1 END) * ((n % 95) + 30 / 60.0 + (n % 60) / CAST(3600 AS DOUBLE)) END AS lat,
    CASE WHEN n % 3 = 0 THEN (CASE WHEN n % 5 = 0 THEN -1 ELSE 1 END) * ((n % 180) + 15 / CAST(60 AS DOUBLE)) END AS lon,
    CASE WHEN n % 2 = 0 THEN 'Canon' ELSE 'Nikon' END AS make, CASE WHEN n % 5 = 0 THEN 'Canon EOS' WHEN n % 5 = 1 THEN 'D' || n END AS model,
    CASE WHEN n % 7 = 0 AND length('SN' || (n * 1000)) >= 4 THEN 'SN' || (n * 1000) WHEN n % 7 = 1 THEN 'LS' || (n + 1000) END AS serial,
    CASE WHEN n % 6 = 0 THEN 'Editor' END AS software, CASE WHEN n % 8 = 0 THEN 'Ann' WHEN n % 8 = 1 THEN NULL WHEN n % 8 = 2 THEN 'Bob' END AS author,
    CASE WHEN n % 9 = 1 THEN 'hello' END AS comment,
    CASE WHEN n % 10 = 0 THEN '2020:01:01 00:00:00' WHEN n % 10 = 1 THEN '2021:01:01 00:00:00' END AS taken
    FROM (SELECT path, ordinal AS n FROM inventory))"""


@query("exf1_image_disclosure", f"""
    SELECT path, round(CASE WHEN gps THEN lat END, 4) AS latitude, round(CASE WHEN gps THEN lon END, 4) AS longitude,
           CASE WHEN n % 4 = 0 THEN round(n * 3 / CAST(7 AS DOUBLE), 1) END AS altitude, make AS camera_make,
           CASE WHEN model IS NULL THEN NULL WHEN starts_with(lower(model), lower(make)) THEN model ELSE make || ' ' || model END AS camera_model,
           serial, author, comment, taken,
           concat_ws(',', CASE WHEN gps THEN 'GPS' END, CASE WHEN model IS NOT NULL THEN 'Device' END, CASE WHEN serial IS NOT NULL THEN 'Serial' END,
             CASE WHEN software IS NOT NULL THEN 'Software' END, CASE WHEN author IS NOT NULL THEN 'Author' END, CASE WHEN taken IS NOT NULL THEN 'DateTaken' END) AS fields
    FROM (SELECT *, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) AS gps FROM {TAG_SQL})""", ("inventory",))
def _(v: Views):
    e = exif.image_disclosure(v.tags).select("path", "exif.*")
    return e.select("path", F.round("latitude", 4).alias("latitude"), F.round("longitude", 4).alias("longitude"), "altitude",
                    "camera_make", "camera_model", c("camera_serial_number").alias("serial"), "author", c("user_comment").alias("comment"),
                    c("date_taken").alias("taken"), F.array_join("disclosed_fields", ",").alias("fields"))


@query("exf3_exposure_level", f"""
    SELECT level AS exposure_level, count(*) AS files FROM (SELECT CASE WHEN coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) THEN 'Critical'
      WHEN serial IS NOT NULL OR author IS NOT NULL THEN 'High' WHEN model IS NOT NULL OR software IS NOT NULL THEN 'Medium' ELSE 'Low' END AS level FROM {TAG_SQL})
    GROUP BY level""", ("inventory",))
def _(v: Views):
    return exif.image_disclosure(v.tags).groupBy(c("exif.exposure_level").alias("exposure_level")).agg(F.count(F.lit(1)).alias("files"))


DOC = """(SELECT *, points >= 65 AND NOT colorful AND moderate AND ink AND bands AND (aspect OR (paper_ratio >= 0.60 AND text_bands >= 6) OR has_word) AS accepted
  FROM (SELECT *, (CASE WHEN strong THEN 30 WHEN moderate THEN 15 ELSE 0 END) + (CASE WHEN ink THEN 25 ELSE 0 END) + (CASE WHEN bands THEN 15 ELSE 0 END)
      + (CASE WHEN aspect THEN 15 ELSE 0 END) + (CASE WHEN has_word THEN 15 ELSE 0 END) + (CASE WHEN faced THEN 20 ELSE 0 END) AS points
  FROM (SELECT *, face AND faces BETWEEN 1 AND 2 AND aspect AND strong AND ink AND bands AS faced
  FROM (SELECT *, dark_ratio BETWEEN 0.04 AND 0.35 AND moderate AND text_bands >= 3 AS ink, text_bands >= 4 AND horizontal + vertical > 40 AS bands,
               abs(ratio - 1.414) < 0.10 OR abs(ratio - 1.586) < 0.10 AS aspect, avg_saturation > 0.32 OR high_saturation_ratio > 0.30 AS colorful
  FROM (SELECT *, paper_ratio >= 0.45 AND mean_luminance BETWEEN 140 AND 250 AS strong, paper_ratio >= 0.35 AND mean_luminance BETWEEN 125 AND 250 AS moderate,
               greatest(width, height) / CAST(least(width, height) AS DOUBLE) AS ratio FROM image_statistics)))))"""


@query("doc1_document_decision", f"""
    SELECT vec_id, accepted AS is_document, accepted AND faced AS is_id_document,
           round(CASE WHEN colorful THEN 0.15 WHEN accepted THEN least(98, points) / CAST(100 AS DOUBLE) ELSE least(45, points) / CAST(100 AS DOUBLE) END, 2) AS confidence,
           round(ratio, 3) AS aspect_ratio FROM {DOC}""", ("image_statistics",))
def _(v: Views):
    return document.with_document(v.image_statistics).select(
        "vec_id", "document.is_document", "document.is_id_document", "document.confidence", "document.aspect_ratio")


@query("doc2_name_keywords", "SELECT vec_id, has_word FROM image_statistics", ("image_statistics",))
def _(v: Views):
    return v.image_statistics.select("vec_id", document.name_has_keyword("path").alias("has_word"))


@query("doc3_face_reasons", f"""
    SELECT vec_id, CASE WHEN faced THEN 'corroborated' WHEN face AND faces > 0 THEN 'insufficient' ELSE 'none' END AS face_note FROM {DOC} WHERE NOT colorful""", ("image_statistics",))
def _(v: Views):
    rows = document.with_document(v.image_statistics).withColumn("last", F.element_at(F.array_append("document.reasons", F.lit("")), -2))
    reasons = c("document.reasons")
    note = (F.when(F.array_contains(reasons, "Face detected on identity document surface"), F.lit("corroborated"))
            .when(F.array_contains(reasons, "Face found, but document surface/text/geometry evidence is insufficient"), F.lit("insufficient"))
            .otherwise(F.lit("none")))
    return rows.filter((c("avg_saturation") <= 0.32) & (c("high_saturation_ratio") <= 0.30)).select("vec_id", note.alias("face_note"))


SAFETY = "CASE WHEN nsfl >= nsfw AND nsfl >= sfw THEN 'NSFL' WHEN nsfw >= sfw THEN 'NSFW' ELSE 'SFW' END"


@query("saf1_image_class", f"SELECT video, frame, {SAFETY} AS primary_class FROM frames", ("frames",))
def _(v: Views):
    return v.frames.select("video", c("frame").cast("long").alias("frame"), media.safety_class(c("nsfl"), c("nsfw"), c("sfw")).alias("primary_class"))


@query("saf2_video_verdict", f"""
    SELECT video, frame, nsfw, {SAFETY} AS primary_class FROM (
      SELECT *, row_number() OVER (PARTITION BY video ORDER BY nsfw DESC, frame) AS best FROM (
        SELECT *, min(CASE WHEN nsfw > 0.85 THEN frame END) OVER (PARTITION BY video) AS stop FROM frames) WHERE stop IS NULL OR frame <= stop)
    WHERE best = 1""", ("frames",))
def _(v: Views):
    return media.video_safety(v.frames).select("video", c("frame").cast("long").alias("frame"), "nsfw", "primary_class")


@query("ppl1_video_faces", "SELECT video, CAST(max(face_count) AS BIGINT) AS face_count, max(confidence) AS max_confidence FROM frames GROUP BY video", ("frames",))
def _(v: Views):
    return media.video_people(v.frames).select("video", long("face_count"), "max_confidence")


@query("ppl2_people_results", """
    SELECT finding_id, ppl_status AS status, ppl_seen AS people_detected, CAST(ppl_faces AS BIGINT) AS face_count,
           CASE WHEN ppl_status = 'Completed' THEN (ordinal % 50) / CAST(100 AS DOUBLE) ELSE 0 END AS max_confidence FROM audited WHERE media""", ("audited",))
def _(v: Views):
    return v.audited.filter("people is not null").select(
        "finding_id", c("people.people_scan_status").alias("status"), "people.people_detected",
        c("people.face_count").cast("long").alias("face_count"), "people.max_confidence")


@query("agg4_run_counters", """
    SELECT count(*) FILTER (saf_status = 'Completed' AND saf_class = 'NSFW') AS nsfw, count(*) FILTER (saf_status = 'Completed' AND saf_class = 'NSFL') AS nsfl,
           count(*) FILTER (saf_status = 'Completed' AND ppl_seen) AS people, count(*) FILTER (saf_status = 'Completed' AND NOT ppl_seen) AS no_people,
           count(*) FILTER (saf_status = 'Error') AS errors FROM audited WHERE media""", ("audited",))
def _(v: Views):
    rows = v.audited.filter("image_safety is not null").select("image_safety.status", "image_safety.primary_class", "people.people_detected")
    return media.run_counters(rows)


LOWER = "lower(path)"
USER = f"regexp_matches({LOWER}, 'documents|desktop|pictures|downloads')"
CACHE = f"regexp_matches({LOWER}, 'cache|temp|thumbnail')"
ROLE = f"""(CASE WHEN contains({LOWER}, 'session') THEN 'SESSION' WHEN contains({LOWER}, 'history') THEN 'HISTORY'
    WHEN contains({LOWER}, 'config') OR ext IN ('.ini', '.json') THEN 'CONFIGURATION' WHEN {CACHE} THEN 'CACHE'
    WHEN contains({LOWER}, 'profile') OR ends_with({LOWER}, '.db') THEN 'APPLICATION_STATE' WHEN {USER} THEN 'USER_CONTENT' ELSE 'UNKNOWN' END)"""


@query("prv2_roles", f"""
    SELECT finding_id, {ROLE} AS file_role, {CACHE} AS possible_cache, {USER} AS possible_user_data,
           CASE WHEN contains({LOWER}, '\\packages\\') THEN 'APPLICATION_DATA' WHEN contains({LOWER}, '\\program files') THEN 'APPLICATION_RESOURCE'
                WHEN {USER} THEN 'USER_CONTENT' ELSE 'UNKNOWN' END AS owner_type FROM findings""", ("findings",))
def _(v: Views):
    return v.findings.select("finding_id", provenance.role("path", "display_name").alias("file_role"),
                             provenance.possible_cache("path").alias("possible_cache"), provenance.possible_user_data("path").alias("possible_user_data"),
                             provenance.owner_type("path").alias("owner_type"))


@query("prv1_path_evidence", f"""
    SELECT finding_id, CAST((CASE WHEN contains({LOWER}, '\\appdata\\roaming\\') THEN 15 WHEN contains({LOWER}, '\\appdata\\local\\') THEN 12 ELSE 0 END)
        + (CASE WHEN contains({LOWER}, '\\downloads\\') THEN 8 ELSE 0 END) AS BIGINT) AS weight FROM findings""", ("findings",))
def _(v: Views):
    weight = F.aggregate(provenance.path_evidence("path"), F.lit(0), lambda a, e: a + e["weight"])
    return v.findings.select("finding_id", weight.cast("long").alias("weight"))


FORMAT = "(CASE ordinal % 7 WHEN 0 THEN 'SQLite' WHEN 1 THEN 'ZIP' WHEN 2 THEN 'PDF' WHEN 3 THEN 'PE' WHEN 4 THEN 'JPEG' WHEN 5 THEN upper(ext[2:]) ELSE 'Unknown' END)"


@query("prv3_detected_format", f"SELECT finding_id, {FORMAT} AS detected_format FROM findings", ("findings",))
def _(v: Views):
    return v.provenance_input.select("finding_id", provenance.detected_format(c("header"), "path").alias("detected_format"))


@query("prv4_package_name", "SELECT finding_id, CASE WHEN ordinal % 20 = 2 THEN 'Vendor.App' || (ordinal // 20 % 4) END AS package FROM findings", ("findings",))
def _(v: Views):
    return v.findings.select("finding_id", provenance.package_name("path").alias("package"))


INSTALLED = "(SELECT s_suppkey AS position, 'suite ' || (CASE WHEN s_suppkey % 4 = 3 THEN 'other' ELSE 'vendor.app' || (s_suppkey % 4) END) || ' ' || s_suppkey AS hay FROM supplier)"
MATCHED = f"SELECT 'app' || (doc_id % 40) AS application, min(position) AS position FROM documents JOIN {INSTALLED} ON contains(hay, 'app' || (doc_id % 40)) GROUP BY doc_id % 40"


def matched(v: Views):
    names = v.documents.select(F.concat(F.lit("APP"), (c("doc_id") % 40).cast("string")).alias("application"))
    rows = provenance.installed_match(names, v.installed)
    return rows.select(F.lower("application").alias("application"), F.regexp_extract("product.publisher", "([0-9]+)", 1).cast("long").alias("position"))


@query("jn10_installed_products", MATCHED)
def _(v: Views):
    return matched(v)


@query("jn10_installed_products_by_substring_join", MATCHED)
def _(v: Views):
    return matched(v)


NEAR = """(SELECT finding_id, list_distinct(list_transform(flatten(list(names ORDER BY depth)), lambda x: lower(x)))[1:24] AS kept FROM (
    SELECT f.finding_id, a.depth, d.names FROM findings f, LATERAL (SELECT unnest([1, 2, 3]) AS depth) a
    LEFT JOIN (SELECT directory, list(name ORDER BY name) FILTER (n <= 40) AS names FROM (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY name) AS n FROM (
        SELECT DISTINCT array_to_string(p[1:i], '\\') AS directory, p[i + 1] AS name FROM (SELECT string_split(path, '\\') AS p, unnest(range(1, len(string_split(path, '\\')))) AS i FROM inventory))) GROUP BY directory) d
    ON d.directory = array_to_string(string_split(f.path, '\\')[1:len(string_split(f.path, '\\')) - a.depth], '\\')) GROUP BY finding_id)"""


@query("prv6_neighbors", f"SELECT finding_id, CAST(len(kept) AS BIGINT) AS n, array_to_string(list_sort(kept), '|') AS names FROM {NEAR}".replace(
    "list_distinct(list_transform(flatten(list(names ORDER BY depth)), lambda x: lower(x)))[1:24]",
    "list_filter(list_transform(flatten(list(names ORDER BY depth)), lambda x: lower(x)), lambda x, i: list_position(list_transform(flatten(list(names ORDER BY depth)), lambda y: lower(y)), x) = i)[1:24]"),
       ("findings", "inventory"))
def _(v: Views):
    near = provenance.with_neighbors(v.findings, provenance.directory_listing(v.inventory, names=40), shown=24)
    names = F.transform("neighbors", F.lower)
    return near.select("finding_id", F.size("neighbors").cast("long").alias("n"), F.array_join(F.array_sort(names), "|").alias("names"))


# Every 50th file is a manifest; its directory and those below it are marked, wherever it comes in name order.
MANIFESTS = """(SELECT array_to_string(p[1:len(p) - 1], '\\') AS directory, bool_or(ordinal % 50 = 0) AS has FROM
    (SELECT ordinal, string_split(path, '\\') AS p FROM inventory) GROUP BY 1)"""


@query("prv6_manifest_nearby", f"""
    SELECT finding_id, CAST((CASE WHEN h1 THEN 1 ELSE 0 END) + (CASE WHEN h1 OR h2 THEN 1 ELSE 0 END) + (CASE WHEN h1 OR h2 OR h3 THEN 1 ELSE 0 END) AS BIGINT) AS marks FROM (
      SELECT finding_id, bool_or(d = 1 AND coalesce(has, false)) AS h1, bool_or(d = 2 AND coalesce(has, false)) AS h2, bool_or(d = 3 AND coalesce(has, false)) AS h3 FROM (
        SELECT finding_id, a.d, m.has FROM (SELECT finding_id, string_split(path, '\\') AS p FROM findings) f, LATERAL (SELECT unnest([1, 2, 3]) AS d) a
        LEFT JOIN {MANIFESTS} m ON m.directory = array_to_string(p[1:len(p) - a.d], '\\')) GROUP BY finding_id)""", ("findings", "inventory"))
def _(v: Views):
    folder = F.regexp_replace("path", r"[^\\]*$", "")
    named = v.inventory.withColumn("path", F.when(c("ordinal") % 50 == 0, F.concat(folder, F.lit("package.json"))).otherwise(c("path")))
    near = provenance.with_neighbors(v.findings, provenance.directory_listing(named))
    return near.select("finding_id", F.size("directory_evidence").cast("long").alias("marks"))


SLOT = "(CASE WHEN ordinal % 20 = 2 THEN ordinal // 20 % 4 WHEN ordinal % 6 = 0 THEN ordinal // 6 % 4 END)"
APP = f"(CASE WHEN ordinal % 20 = 2 THEN 'Vendor.App' || {SLOT} WHEN ordinal % 6 = 0 THEN 'vendor.app' || {SLOT} END)"
WEIGHT = f"""((CASE WHEN contains({LOWER}, '\\appdata\\roaming\\') THEN 15 WHEN contains({LOWER}, '\\appdata\\local\\') THEN 12 ELSE 0 END)
    + (CASE WHEN contains({LOWER}, '\\downloads\\') THEN 8 ELSE 0 END) + (CASE WHEN ordinal % 20 = 2 THEN 35 ELSE 0 END)
    + (CASE WHEN ordinal % 6 = 0 THEN 20 ELSE 0 END) + (CASE WHEN app IS NULL THEN 0 WHEN {SLOT} = 3 THEN 12 ELSE 20 END)
    + (CASE WHEN ordinal % 7 < 6 THEN 8 ELSE 0 END) + (CASE WHEN ordinal % 7 = 0 THEN 25 ELSE 0 END) + (CASE WHEN ordinal % 5 = 0 THEN 10 ELSE 0 END)
    + 15 * ({o.positive_terms(o.HITS[:3])}))"""


@query("prv8_provenance", f"""
    SELECT finding_id, app AS application, CAST(score AS BIGINT) AS confidence_score, CASE WHEN score >= 80 THEN 'HIGH' WHEN score >= 55 THEN 'MEDIUM' WHEN score >= 25 THEN 'LOW' ELSE 'UNKNOWN' END AS confidence_level,
           app IS NOT NULL AND {SLOT} = 3 AS possible_orphan, CASE WHEN app IS NULL AND ordinal % 7 = 0 THEN 'ACCOUNT_PROFILE' ELSE {ROLE} END AS file_role,
           CAST(weight + (CASE WHEN app IS NOT NULL AND {SLOT} = 3 THEN 20 ELSE 0 END) AS BIGINT) AS evidence_weight
    FROM (SELECT *, least(100, weight) AS score FROM (SELECT *, {WEIGHT} AS weight FROM (SELECT *, {APP} AS app FROM audited)))""", ("audited",))
def _(v: Views):
    rows = provenance.analyzed(v.provenance_input, v.inventory, v.installed, F.lit(AS_OF))
    weight = F.aggregate("evidence", F.lit(0), lambda a, e: a + e["weight"])
    return rows.select("finding_id", "application", long("confidence_score"), "confidence_level", "possible_orphan", "file_role",
                       weight.cast("long").alias("evidence_weight"))


@query("prv9_still_current", """
    SELECT finding_id, ordinal % 3 <> 0 AND ordinal % 4 <> 0 AS is_current FROM findings""", ("findings",))
def _(v: Views):
    n = c("ordinal")
    stored = v.findings.select("finding_id", F.upper("path").alias("path"), F.when(n % 3 == 0, c("size_bytes") + 1).otherwise(c("size_bytes")).alias("size_bytes"),
                               "modified_at", F.when(n % 4 == 0, 0).otherwise(1).alias("engine_version"))
    both = v.findings.alias("f").join(stored.alias("p"), "finding_id")
    return both.select("finding_id", provenance.is_current().alias("is_current"))
