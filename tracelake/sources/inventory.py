"""File inventories and the finding rows built from them."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.functions import paths
from tracelake.operators.joins import not_excluded
from tracelake.session import stored

LISTED = 10_000  # rows that a task gathers while it lists


def listed_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """SRC-1: path, size and time of every file below the roots. The content column is pruned, so no file is read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(sorted(set(roots)))
            .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")))


WALKED = "path string, size_bytes long, modified_at timestamp, is_directory boolean, error string"


def children(folder: str) -> Iterator[tuple[str, int, float, bool]]:
    """(path, size, seconds, is a folder) of what lies in a folder; links are not followed. A path without scheme, or of the
    scheme file, is read where the task runs (a mounted file system), others through Arrow's file systems."""
    scheme, _, rest = folder.partition(":")
    if not rest or len(scheme) == 1 or scheme == "file":
        with os.scandir(re.sub(r"^file:/*", "/", folder)) as found:
            for entry in found:
                if not entry.is_symlink():
                    state = entry.stat()
                    yield f"{folder.rstrip('/')}/{entry.name}", state.st_size, state.st_mtime, entry.is_dir()
        return
    system, path = fs.FileSystem.from_uri(folder)
    for info in system.get_file_info(fs.FileSelector(path)):
        at = info.mtime.timestamp() if info.mtime else 0.0
        yield f"{folder.rstrip('/')}/{info.base_name}", info.size or 0, at, info.type == fs.FileType.Directory


def list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder, LISTED rows at a time; a folder that cannot be read is one row with the error."""
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        path, size, at, folder, error = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(path, pa.string()), pa.array(size, pa.int64()),
             pa.array([None if t is None else int(t * 1_000_000) for t in at], pa.timestamp("us", "UTC")), pa.array(folder, pa.bool_()),
             pa.array(error, pa.string())], ["path", "size_bytes", "modified_at", "is_directory", "error"])

    for batch in batches:
        rows: list[tuple] = []
        for folder in batch.column("path").to_pylist():
            try:
                for child in children(folder):
                    rows.append((*child, None))
                    if len(rows) >= LISTED:
                        yield batch_of(rows)
                        rows = []
            except Exception as problem:  # one folder must not end the walk
                rows.append((folder, None, None, True, f"{type(problem).__name__}: {problem}"[:500]))
        if rows:
            yield batch_of(rows)


def walked(spark: SparkSession, roots: list[str]) -> DataFrame:
    """SRC-1: everything below the roots (WALKED), listed by tasks. Each round lists the folders that the round before has
    found, until none is left, so the driver sees neither files nor folders. Roots inside others are left out; links are not followed."""
    outer = [r for r in sorted({r.rstrip("/") or "/" for r in roots})]
    outer = [r for r in outer if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in outer)]
    folders, found = spark.createDataFrame([(r,) for r in outer], "path string"), []
    while True:
        dealt = folders.repartition(max(2, spark.sparkContext.defaultParallelism), F.xxhash64("path"))
        found.append(stored(dealt.mapInArrow(list_folders, WALKED)))
        folders = found[-1].filter("is_directory AND error IS NULL").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionByName, found)


def files_below(inventory: DataFrame, roots: DataFrame) -> DataFrame:
    """SRC-1 from an inventory table (path, size_bytes, modified_at, is_directory): the files below the roots (path).
    Every directory of the table meets the roots once for each of its ancestors, in an equi join."""
    rows = inventory.filter("NOT is_directory").withColumn("__folder", paths.parent(paths.backslashed("path")))
    parts = F.split("__folder", r"\\")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "\\"))
    wanted = roots.select(F.lower(paths.trim_separators(paths.backslashed("path"))).alias("root")).distinct()
    folders = (rows.filter("__folder IS NOT NULL").select("__folder").distinct()
               .select("__folder", F.explode(above).alias("above")).withColumn("root", F.lower("above"))
               .join(wanted, "root", "left_semi").select("__folder").distinct())
    return rows.join(folders, "__folder", "left_semi").select("path", "size_bytes", "modified_at")


def file_contents(spark: SparkSession, roots: list[str], pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(roots).select("path", "content")


def is_secret_by_name(path: Column | str) -> Column:
    name = F.lower(paths.base_name(path))
    return (paths.extension(path).isin(fixed.SECRET_EXTENSIONS)
            | paths.any_of([name.startswith(p) for p in fixed.SECRET_NAME_PREFIXES]))


def file_findings(inventory: DataFrame, large_bytes: int = fixed.LARGE_FILE_BYTES,
                  exclusions: DataFrame | None = None) -> DataFrame:
    """SRC-2: keep secrets, large files and every known file class; score the place of the file."""
    rows = inventory if exclusions is None else not_excluded(inventory, exclusions)
    secret, large = F.col("_secret"), F.col("size_bytes") >= large_bytes
    items = F.col("_places")
    return (rows.withColumn("_secret", is_secret_by_name("path")).withColumn("_class", paths.file_class("path"))
            .filter(secret | (F.col("_class") != "Other") | large)
            .withColumn("_places", paths.path_exposure_items("path"))
            .withColumn("category", F.when(secret, F.lit("Potential secrets")).otherwise(F.col("_class")))
            .withColumn("subcategory", F.when(secret, F.lit("Potential secret"))
                        .when(large, F.lit("Large file")).otherwise(F.lit("File")))
            .withColumn("display_name", paths.base_name("path"))
            .withColumn("exposure_score", paths.exposure_score(items))
            .withColumn("exposure_reasons", paths.exposure_reasons(items))
            .drop("_secret", "_class", "_places"))


def development_directories(inventory: DataFrame) -> DataFrame:
    """SRC-3: one row per directory with a development name anywhere on a path."""
    parts = F.split(paths.backslashed("path"), r"\\")
    names = [n.lower() for n in fixed.DEVELOPMENT_DIRECTORIES]
    depths = F.filter(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.lower(F.get(parts, i - 1)).isin(names))
    found = F.transform(depths, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "\\"))
    return (inventory.select(F.explode(found).alias("path")).distinct()
            .select(F.lit("filesystem").alias("scanner_id"), F.lit("Development").alias("category"),
                    F.lit("Environment").alias("subcategory"), "path", paths.base_name("path").alias("display_name"),
                    F.lit(True).alias("is_directory"), F.lit(10).alias("exposure_score"),
                    F.array(F.lit("Development environment or regeneratable cache")).alias("exposure_reasons")))


def recent_references(shortcuts: DataFrame, inventory: DataFrame) -> DataFrame:
    """SRC-6: shortcuts (path, target, size_bytes, modified_at); a target exists when the inventory has its path."""
    known = inventory.select(paths.match_key("path").alias("target_key")).distinct().withColumn("hit", F.lit(True))
    rows = (shortcuts.withColumn("target_key", paths.match_key("target")).join(known, "target_key", "left")
            .withColumn("exists", F.coalesce("hit", F.lit(False))))
    is_shortcut = paths.extension("path") == ".lnk"
    target, exists = F.col("target"), F.col("exists") & is_shortcut
    present = F.lit("Present in Windows Recent")
    reasons = F.array_compact(F.array(
        present,
        F.when(~is_shortcut | target.isNull(), None)
        .when(exists, F.concat(F.lit("Shortcut target is available: "), target))
        .otherwise(F.concat(F.lit("Shortcut target is no longer available: "), target))))
    sub = (F.when(~is_shortcut, F.lit("Reference")).when(exists, F.lit("Shortcut reference"))
           .otherwise(F.lit("Stale shortcut reference")))
    return rows.select(F.lit("recent").alias("scanner_id"), F.lit("Recent").alias("category"), sub.alias("subcategory"),
                       "path", paths.base_name("path").alias("display_name"), F.lit(False).alias("is_directory"),
                       "size_bytes", "modified_at", F.lit(100).alias("exposure_score"), reasons.alias("exposure_reasons"))


def user_profiles(inventory: DataFrame) -> DataFrame:
    """SRC-7: one directory row per profile root."""
    root = F.regexp_extract(paths.backslashed("path"), r"(?i)^([a-z]:\\users\\[^\\]+)\\", 1)
    return (inventory.select(root.alias("path")).filter("path <> ''").distinct()
            .select(F.lit("profiles").alias("scanner_id"), F.lit("User profile").alias("category"),
                    F.lit("Profile (account status unknown)").alias("subcategory"), "path",
                    paths.base_name("path").alias("display_name"), F.lit(True).alias("is_directory"),
                    F.lit(0).alias("exposure_score"), F.array(F.lit("Windows user profile exists")).alias("exposure_reasons")))
