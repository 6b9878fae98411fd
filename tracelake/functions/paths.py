"""Path expressions. Paths use either separator; comparison ignores case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake import fixed


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    A filter on a column made by an ordinary projection is pushed below it with the whole formula, which would
    run every text pattern twice. The single-element explode stops that and still lets unused columns be pruned.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, words: list[str]) -> Column:
    """Case-insensitive substring test against a fixed word list."""
    lowered = F.lower(text)
    return any_of([lowered.contains(word.lower()) for word in words])


def backslashed(path: Column | str) -> Column:
    return F.replace(col(path), F.lit("/"), F.lit("\\"))


def trim_separators(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"[\\/]+$", "")


def base_name(path: Column | str) -> Column:
    return F.substring_index(backslashed(path), "\\", -1)


def parent(path: Column | str) -> Column:
    """Directory part, null at the root."""
    value = F.regexp_replace(col(path), r"[\\/]+[^\\/]*$", "")
    return F.when(value != col(path), F.nullif(value, F.lit("")))


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def file_class(path: Column | str) -> Column:
    """SCL-1: class by extension."""
    pairs = [F.lit(v) for name, exts in fixed.FILE_CLASSES for ext in exts for v in (ext, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit("Other"))


def path_exposure_items(path: Column | str) -> Column:
    """SCL-5: every place that matches, as an array of (score, reason)."""
    lowered = F.lower(col(path))
    places = F.array(*[
        F.struct(lowered.contains(part.lower()).alias("hit"), F.lit(score).alias("score"),
                 F.lit(reason).alias("reason"))
        for part, score, reason in fixed.PATH_EXPOSURE
    ])
    return F.filter(places, lambda p: p["hit"])


def exposure_score(items: Column) -> Column:
    """SCL-4: sum of the factors, at most 100."""
    return F.least(F.lit(100), F.aggregate(items, F.lit(0), lambda total, p: total + p["score"]))


def exposure_reasons(items: Column) -> Column:
    return F.transform(items, lambda p: p["reason"])


def path_key(path: Column | str) -> Column:
    """SCL-6."""
    return F.upper(trim_separators(path))


def match_key(path: Column | str) -> Column:
    """SCL-7: key under which two spellings of one path meet."""
    return F.lower(trim_separators(path))


def directory_kind(path: Column | str) -> Column:
    """SCL-8: first matching kind in order."""
    lowered = F.lower(backslashed(path))
    hits = [F.when(lowered.contains(f"\\{kind.lower()}\\"), F.lit(kind)) for kind in fixed.DIRECTORY_KINDS]
    return F.coalesce(*hits, F.lit("Other"))


def safe_extension(path: Column | str) -> Column:
    """SCL-12: letters and digits only, 16 characters."""
    raw = extension(path)
    safe = F.substring(F.regexp_replace(raw, r"[^.a-z0-9]", ""), 1, 16)
    return (F.when(F.trim(raw) == "", F.lit("[none]"))
            .when(safe.startswith(".") & (F.length(safe) > 1), safe)
            .otherwise(F.lit("[other]")))


def path_shape(path: Column | str, is_directory: Column) -> Column:
    """SCL-9: anonymous outline of a path."""
    normal = backslashed(path)
    parts = F.filter(F.split(normal, r"\\"), lambda p: p != "")
    is_unc = normal.startswith("\\\\")
    start = (F.when(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).endswith(":"), F.lit(1))
             .when(is_unc, F.least(F.lit(2), F.size(parts))).otherwise(F.lit(0)))
    depth = F.greatest(F.lit(0), F.size(parts) - start - F.when(is_directory, 0).otherwise(1))
    ext = safe_extension(normal)
    leaf = F.when(~is_directory, F.when(ext == "[none]", F.lit("file")).otherwise(F.concat(F.lit("file"), ext)))
    pieces = F.concat(
        F.array(F.when(is_unc, F.lit("NETWORK_ROOT")).otherwise(F.lit("USERPROFILE"))),
        F.array_repeat(F.lit("directory"), F.least(depth, F.lit(6))),
        F.array(F.when(depth > 6, F.lit("…")), leaf),
    )
    blank = col(path).isNull() | (F.trim(col(path)) == "")
    return F.when(blank, F.lit("unknown")).otherwise(F.array_join(pieces, " / "))


def historical_risk(path: Column | str) -> Column:
    """SCL-15."""
    p = col(path)
    points = (F.when(extension(p).isin(fixed.HISTORY_SENSITIVE_EXTENSIONS), 45).otherwise(0)
              + F.when(contains_any(p, fixed.HISTORY_SENSITIVE_TOKENS), 30).otherwise(0)
              + F.when(p.startswith("\\\\"), 30).otherwise(0))
    return F.least(F.lit(75), points)


def application_id(container: Column | str) -> Column:
    return F.substring_index(base_name(container), ".", 1)


def application_name(container: Column | str) -> Column:
    """SCL-16: known name or null."""
    pairs = [F.lit(v) for pair in fixed.KNOWN_APPLICATIONS for v in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(application_id(container)))


def history_feedback_key(application_key: Column, path: Column) -> Column:
    """SCL-21."""
    return F.concat_ws("|", F.lit("APPLICATION-HISTORY"), F.upper(application_key), path_key(path))


def is_text(path: Column | str) -> Column:
    return extension(path).isin(fixed.PLAIN_TEXT_EXTENSIONS + fixed.OFFICE_EXTENSIONS)


def is_openable_archive(path: Column | str) -> Column:
    return extension(path).isin(fixed.OPENABLE_ARCHIVES)
