"""Where a file came from: weighted evidence from its path, neighbours, format and existing detections.

Optional finding columns: header (first bytes), schema_names, zone_marker, related_executable
(struct name, product, company).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.functions import paths
from tracelake.operators import evidence as ev

EVIDENCE_TYPE = "array<struct<evidence_type:string,description:string,weight:int,source:string>>"
NEIGHBOR_FILES = ["package.json", "manifest"]
ANCESTORS = 3


def item(kind: str, description: Column | str, weight: Column | int, source: Column | str) -> Column:
    def lit(value):
        return F.lit(value) if isinstance(value, (str, int)) else value

    return F.struct(F.lit(kind).alias("evidence_type"), lit(description).alias("description"),
                    lit(weight).cast("int").alias("weight"), lit(source).alias("source"))


def lowered(path: Column | str) -> Column:
    return F.lower(paths.backslashed(path))


def path_evidence(path: Column | str) -> Column:
    """PRV-1."""
    p = lowered(path)
    roaming, local = p.contains("\\appdata\\roaming\\"), p.contains("\\appdata\\local\\")
    return F.array_compact(F.array(
        F.when(roaming, item("PATH", "Path is under AppData\\Roaming", 15, "path"))
        .when(local, item("PATH", "Path is under AppData\\Local", 12, "path")),
        F.when(p.contains("\\downloads\\"), item("PATH", "Path is under Downloads", 8, "path"))))


def possible_cache(path: Column | str) -> Column:
    return paths.any_of([lowered(path).contains(w) for w in ("cache", "temp", "thumbnail")])


def possible_user_data(path: Column | str) -> Column:
    return paths.any_of([lowered(path).contains(w) for w in ("documents", "desktop", "pictures", "downloads")])


def role(path: Column | str, name: Column | str) -> Column:
    """PRV-2."""
    p, n = lowered(path), F.lower(paths.col(name))
    return (F.when(p.contains("session") | n.contains("session"), F.lit("SESSION"))
            .when(p.contains("history"), F.lit("HISTORY"))
            .when(p.contains("config") | paths.extension(name).isin(".ini", ".json"), F.lit("CONFIGURATION"))
            .when(possible_cache(path), F.lit("CACHE"))
            .when(p.contains("profile") | p.endswith(".db"), F.lit("APPLICATION_STATE"))
            .when(possible_user_data(path), F.lit("USER_CONTENT")).otherwise(F.lit("UNKNOWN")))


def owner_type(path: Column | str) -> Column:
    p = lowered(path)
    return (F.when(p.contains("\\packages\\"), F.lit("APPLICATION_DATA"))
            .when(p.contains("\\program files"), F.lit("APPLICATION_RESOURCE"))
            .when(possible_user_data(path), F.lit("USER_CONTENT")).otherwise(F.lit("UNKNOWN")))


def detected_format(header: Column, path: Column | str) -> Column:
    """PRV-3 from the first 16 bytes; an unreadable file (null header) falls back to its extension."""
    magic = F.hex(F.substring(header, 1, 16))
    by_name = F.upper(F.ltrim(paths.extension(path), F.lit(".")))
    readable = (F.when(magic.startswith("53514C69746520666F726D61742033"), F.lit("SQLite"))
                .when(magic.startswith("504B") & (F.length(magic) >= 8), F.lit("ZIP"))
                .when(magic.startswith("25504446"), F.lit("PDF"))
                .when(magic.startswith("4D5A"), F.lit("PE"))
                .when(magic.startswith("FFD8") & (F.length(magic) >= 6), F.lit("JPEG")).otherwise(by_name))
    fallback = F.when(paths.extension(path).isin(".db", ".sqlite"), F.lit("SQLite")).otherwise(F.lit("Unknown"))
    return F.when(header.isNull(), fallback).otherwise(readable)


def package_name(path: Column | str) -> Column:
    """PRV-4: the part after `Packages`."""
    parts = F.filter(F.split(paths.backslashed(path), r"\\"), lambda p: p != "")
    place = F.array_position(parts, "Packages").cast("int")
    any_case = F.exists(parts, lambda p: F.lower(p) == "packages")
    return F.when(any_case, F.get(parts, place))


def installed_match(names: DataFrame, installed: DataFrame) -> DataFrame:
    """PRV-5, JN-10: for each distinct application name the first installed product (by position) whose name
    contains it. Products meet names in an equi join on their substrings of the lengths that names have; an empty
    name matches nothing."""
    wanted = names.select("application").filter("application <> ''").distinct()
    wanted = wanted.withColumn("needle", F.lower("application"))
    # Distinct lengths are bounded by the longest application name.
    sizes = F.lit(sorted(r.n for r in wanted.select(F.length("needle").alias("n")).distinct().collect())).cast("array<int>")
    hay = F.lower("name")
    pieces = F.flatten(F.transform(sizes, lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.length(hay), F.lit(1))), lambda i: i + n - 1 <= F.length(hay)),
        lambda i: F.substring(hay, i, n))))
    products = installed.withColumn("needle", F.explode(F.array_distinct(pieces)))
    pairs = wanted.join(products, "needle")
    return pairs.groupBy("application").agg(F.min_by(F.struct("name", "publisher", "executable"), "position").alias("product"))


def subdirectories(inventory: DataFrame) -> DataFrame:
    """(directory, name) of every directory below another. Distinct folders of files come first; only these are taken
    apart into the folders above them."""
    folder = F.regexp_replace(paths.backslashed("path"), r"\\[^\\]*$", "")
    folders = inventory.filter(paths.backslashed("path").contains("\\")).select(folder.alias("__folder")).distinct()
    parts = F.split("__folder", r"\\")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(
        F.array_join(F.slice(parts, F.lit(1), i), "\\").alias("directory"), F.get(parts, i).alias("name")))
    above = F.when(F.size(parts) > 1, F.filter(steps, lambda s: s["name"] != ""))
    return folders.select(F.inline(above)).distinct()


def files_in(inventory: DataFrame) -> DataFrame:
    """(directory, name) of every file, no shuffle."""
    path = paths.backslashed("path")
    name = F.regexp_extract(path, r"\\([^\\]*)$", 1)
    return (inventory.select(F.regexp_replace(path, r"\\[^\\]*$", "").alias("directory"), name.alias("name"))
            .filter(F.col("name") != ""))


def directory_listing(inventory: DataFrame, names: int | None = None) -> DataFrame:
    """(directory, has_manifest, names) of every directory. Whether it holds a manifest is known from all its names, by
    partial maxima;
    the list itself is only for show: without `names` it is left out, else the first `names` in name order, and the
    row limit runs before the shuffle, so a directory with a third of all files ships that many rows per task."""
    children = files_in(inventory).unionByName(subdirectories(inventory))
    marks = children.groupBy("directory").agg(F.max(F.lower("name").isin(NEIGHBOR_FILES)).alias("has_manifest"))
    if names is None:
        return marks.withColumn("names", F.lit(None).cast("array<string>"))
    place = Window.partitionBy("directory").orderBy("name")
    first = (children.distinct().withColumn("n", F.row_number().over(place)).filter(F.col("n") <= names)
             .groupBy("directory").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))),
                                                   lambda s: s["name"]).alias("names")))
    return marks.join(first, "directory")


def with_neighbors(findings: DataFrame, listing: DataFrame, shown: int | None = None) -> DataFrame:
    """PRV-6: names around the three nearest ancestors (with `shown`, the first so many). A manifest near the file counts for every ancestor above
    it as well. Ancestors are resolved once per distinct directory, all in one join with the listing; findings take part in
    another."""
    rows = findings.withColumn("__dir", paths.parent(paths.backslashed("path")))
    climbed = [F.col("__dir")]
    for _ in range(1, ANCESTORS):
        climbed.append(paths.parent(climbed[-1]))
    around = (rows.select("__dir").distinct().filter("__dir IS NOT NULL")
              .select("__dir", F.posexplode(F.array_compact(F.array(*climbed))).alias("__step", "directory")))
    empty = F.array().cast("array<string>")
    met = (around.join(listing, "directory", "left")
           .groupBy("__dir").agg(F.array_sort(F.collect_list(F.struct(
               "__step", "directory", F.coalesce("has_manifest", F.lit(False)).alias("has"), F.coalesce("names", empty).alias("names")))).alias("up")))
    marks = F.transform("up", lambda x, i: F.when(F.exists(F.slice("up", F.lit(1), i + 1), lambda y: y["has"]), item(
        "DIRECTORY_FINGERPRINT", "Parent directory contains application manifest/package metadata", 15, x["directory"])))
    seen = F.flatten(F.transform("up", lambda x: x["names"]))
    met = met.select("__dir", F.array_compact(marks).alias("directory_evidence"), seen.alias("__seen"))
    distinct = F.filter("__seen", lambda n, i: F.array_position(F.transform("__seen", F.lower), F.lower(n)) == i + 1)
    if shown is not None:
        distinct = F.slice(distinct, 1, shown)
    met = met.select("__dir", "directory_evidence", distinct.alias("neighbors"))
    known = rows.join(met, "__dir", "left").drop("__dir")
    nothing = F.array().cast(EVIDENCE_TYPE)
    return (known.withColumn("neighbors", F.coalesce("neighbors", empty))
            .withColumn("directory_evidence", F.coalesce("directory_evidence", nothing)))


def existing_evidence() -> Column:
    """PRV-7: what the other detectors already found."""
    def count(label: str, field: str) -> Column:
        return F.concat(F.lit(f"Existing {label} scanner found "), F.col(field).cast("string"), F.lit(" match(es)"))

    return F.array_compact(F.array(
        F.when(ev.positive("pii.total_matches"),
               item("EXISTING_SCANNER", count("PII", "pii.total_matches"), 15, "finding metadata")),
        F.when(ev.positive("secrets.total_matches"),
               item("EXISTING_SCANNER", count("secret", "secrets.total_matches"), 15, "finding metadata")),
        F.when(ev.true("config.is_credential_config"),
               item("EXISTING_SCANNER", "Existing credential/config scanner classified this file", 15,
                    "finding metadata"))))


def confidence_level(score: Column) -> Column:
    """PRV-8."""
    return (F.when(score >= 80, F.lit("HIGH")).when(score >= 55, F.lit("MEDIUM"))
            .when(score >= 25, F.lit("LOW")).otherwise(F.lit("UNKNOWN")))


def analyzed(findings: DataFrame, inventory: DataFrame, installed: DataFrame, as_of: Column) -> DataFrame:
    """PRV-1..PRV-8 as one row per finding. The orphan mark joins the evidence after the sum."""
    rows = (with_neighbors(findings, directory_listing(inventory))
            .withColumn("package", package_name("path"))
            .withColumn("application", F.coalesce("package", "related_executable.product")))
    rows = rows.join(installed_match(rows, installed), "application", "left")
    app, product = F.col("application"), F.col("product")
    status = (F.when(app.isNull(), F.lit("Unknown")).when(product.isNull(), F.lit("Not found"))
              .otherwise(F.lit("Installed")))
    schema = F.coalesce("schema_names", F.array().cast("array<string>"))
    evidence = F.concat(
        path_evidence("path"),
        F.array_compact(F.array(
            F.when(F.col("package").isNotNull(), item(
                "APPX_PATH", F.concat(F.lit("Path is inside AppX package "), F.col("package")), 35, "path")),
            F.when(F.col("related_executable").isNotNull(), item(
                "EXECUTABLE", F.concat(F.lit("Related executable: "), F.col("related_executable.name")), 20,
                "parent directory")),
            F.when(app.isNotNull() & product.isNull(), item(
                "APPLICATION_STATUS", F.concat(F.lit("No installed application matches "), app), 12,
                "uninstall registry"))
            .when(app.isNotNull(), item(
                "APPLICATION_STATUS", F.concat(F.lit("Installed application matches "), app), 20,
                "uninstall registry")))),
        F.col("directory_evidence"),
        F.array_compact(F.array(
            F.when(F.col("header").isNotNull(), item(
                "FORMAT", F.concat(F.lit("Detected format: "), F.col("detected_format")), 8, "magic bytes")),
            F.when(F.size(schema) > 0, item(
                "SQLITE_SCHEMA", F.concat(F.lit("SQLite schema contains: "),
                                          F.array_join(schema, ", ")), 25, "read-only schema")),
            F.when(F.col("zone_marker").isNotNull(), item("MARK_OF_THE_WEB", F.col("zone_marker"), 10, "NTFS ADS")))),
        existing_evidence())
    hints = F.array_distinct(F.concat(schema, F.array_compact(F.array(
        F.when(ev.positive("pii.total_matches"), F.lit("PII")),
        F.when(ev.positive("secrets.total_matches"), F.lit("Secrets")),
        F.when(ev.true("config.is_credential_config"), F.lit("Credentials/configuration"))))))
    account = app.isNull() & F.exists(schema, lambda n: F.lower(n).isin("users", "accounts", "sessions"))
    total = F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate(
        "evidence", F.lit(0), lambda acc, e: acc + e["weight"])))
    orphan = F.col("application_status") == "Not found"
    orphan_item = F.array(item("POSSIBLE_ORPHAN", "Likely application data has no matching installed application", 20,
                               "registry correlation"))
    return (rows.withColumn("application_status", status)
            .withColumn("detected_format", detected_format(F.col("header"), "path"))
            .withColumn("evidence", evidence).withColumn("confidence_score", total)
            .select(
                "finding_id", "ordinal", "path", "size_bytes", "modified_at",
                F.lit(fixed.PROVENANCE_VERSION).alias("engine_version"), app.alias("application"),
                F.coalesce("related_executable.company", "product.publisher").alias("publisher"),
                F.coalesce("related_executable.name", "product.executable").alias("executable"), "application_status",
                owner_type("path").alias("owner_type"),
                F.when(account, F.lit("ACCOUNT_PROFILE")).otherwise(role("path", "display_name")).alias("file_role"),
                "confidence_score", confidence_level(F.col("confidence_score")).alias("confidence_level"),
                orphan.alias("possible_orphan"), possible_cache("path").alias("possible_cache"),
                possible_user_data("path").alias("possible_user_data"), "detected_format",
                hints.alias("schema_hints"), "neighbors",
                F.when(orphan, F.concat("evidence", orphan_item)).otherwise(F.col("evidence")).alias("evidence"),
                as_of.alias("analyzed_at")))


def is_current(finding: str = "f", stored: str = "p") -> Column:
    """PRV-9 for aliased rows of the finding and its stored analysis."""
    def both(a: str, b: str) -> Column:
        return F.col(f"{finding}.{a}").eqNullSafe(F.col(f"{stored}.{b}"))

    return ((F.lower(F.col(f"{finding}.path")) == F.lower(F.col(f"{stored}.path")))
            & both("size_bytes", "size_bytes") & both("modified_at", "modified_at")
            & (F.col(f"{stored}.engine_version") == fixed.PROVENANCE_VERSION))
