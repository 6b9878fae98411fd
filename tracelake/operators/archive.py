"""Archive listings: which entries are sensitive and how exposed the archive is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.functions import paths
from tracelake.operators.ordering import with_positions

#: Sensitive entries that an archive's row lists, and that a block holds.
LISTED = 1000
ENTRY_TYPE = "array<struct<name:string,size_bytes:bigint,is_sensitive:boolean,sensitivity_category:string>>"
ARCHIVE_TYPE = ("struct<is_archive:boolean,total_entries:int,sensitive_entries_count:int,privacy_score:string,"
                f"entries:{ENTRY_TYPE},tree_view:string>")

# Name tests per class, first class that matches wins.
# (class, level, substrings, endings, exact names, beginnings)
ENTRY_RULES = [
    ("Private Key / Password File", "Critical",
     ["password", "passwords", "seed_phrase", "mnemonic"], [".pem", ".key"],
     ["id_rsa", "id_ed25519", "wallet.dat"], []),
    ("ID / Passport Document Scan", "Critical",
     ["passport", "паспорт", "snils", "снилс", "inn", "инн", "id_card", "driver_license", "права", "zagran", "загран"],
     [], [], []),
    ("Environment & Auth Secret", "High",
     [], [], [".npmrc", "kubeconfig", "credentials", ".git-credentials", ".pgpass", ".my.cnf"], [".env"]),
    ("Database / User Data Export", "High",
     ["backup_db", "db_dump", "users_export", "clients_export", "database.sqlite"], [".sql"], [], []),
    ("Financial / Personal Document", "Medium",
     ["ndfl", "ндфл", "salary", "зарплата", "statement", "выписка", "dogovor", "договор"], [], [], []),
]
LEVELS = ["Safe", "Low", "Medium", "High", "Critical"]


def entry_rule(name: Column | str) -> Column:
    """ARC-2: struct(category, level), null when the entry is harmless."""
    base = F.lower(paths.base_name(name))
    result = None
    for category, level, parts, endings, exact, beginnings in ENTRY_RULES:
        tests = ([base.contains(p) for p in parts] + [base.endswith(e) for e in endings]
                 + [base == e for e in exact] + [base.startswith(b) for b in beginnings])
        value = F.struct(F.lit(category).alias("category"), F.lit(level).alias("level"))
        condition = paths.any_of(tests)
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result


def level_order(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int") - 1


def classified(entries: DataFrame) -> DataFrame:
    """Entries (archive, position, entry_name, size_bytes) with their rule; directories carry none."""
    is_file = F.trim(paths.base_name("entry_name")) != ""
    return entries.withColumn("rule", F.when(is_file, entry_rule("entry_name")))


def entry_size(size: Column) -> Column:
    kilo = F.format_string("%.1f", size / 1024.0)
    mega = F.format_string("%.1f", size / 1048576.0)
    return (F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
            .when(size < 1048576, F.concat(kilo, F.lit(" KB"))).otherwise(F.concat(mega, F.lit(" MB"))))


def tree_view(archive: Column, total: Column, sensitive: Column, shown: Column) -> Column:
    """ARC-4."""
    size = F.size(shown)
    lines = F.transform(shown, lambda e, i: F.concat(
        F.when(i == size - 1, F.lit("    └─ ")).otherwise(F.lit("    ├─ ")),
        e["name"], F.lit(" ["), e["sensitivity_category"], F.lit("] ("), entry_size(e["size_bytes"]), F.lit(")")))
    head = F.concat(paths.base_name(archive), F.lit(" ("), total.cast("string"), F.lit(" files, "),
                    sensitive.cast("string"), F.lit(" sensitive):"))
    more = F.when(sensitive > size, F.concat(F.lit("    ... and "), (sensitive - size).cast("string"),
                                             F.lit(" more sensitive files inside.")))
    return F.array_join(F.concat(F.array(head), lines, F.array(more)), "\n")


def sensitive_entries(entries: DataFrame) -> DataFrame:
    """ARC-3 as a table, a row per sensitive entry: (archive, position, entry_name, size_bytes, category, level)."""
    return classified(entries).filter("rule is not null").select(
        "archive", F.col("position").cast("long").alias("position"), "entry_name", F.col("size_bytes").cast("long").alias("size_bytes"),
        "rule.category", "rule.level")


def entry_blocks(entries: DataFrame, size: int = LISTED) -> DataFrame:
    """(archive, block, entries): the sensitive entries of every archive in order, `size` in a row. Places come from one range
    sort, so an archive with a third of all entries is dealt with by many tasks."""
    placed = with_positions(sensitive_entries(entries), F.asc("archive"), F.asc("position"), F.asc("entry_name"), out="place")
    first = placed.groupBy("archive").agg(F.min("place").alias("first"))
    block = F.floor((F.col("place") - F.col("first")) / size)
    return (placed.join(first, "archive").groupBy("archive", block.alias("block"))
            .agg(F.array_sort(F.collect_list(F.struct("place", "entry_name", "size_bytes", "category", "level"))).alias("entries"))
            .withColumn("entries", F.transform("entries", lambda e: e.dropFields("place"))))


def inspected(entries: DataFrame, limit: int | None = LISTED) -> DataFrame:
    """ARC-3: one row per archive with its first sensitive entries in order, `limit` at most (None: all); the row limit reaches the
    map side. `sensitive_entries` and `entry_blocks` have them all."""
    marked = classified(entries)
    totals = marked.groupBy("archive").agg(
        F.count(F.lit(1)).cast("int").alias("total"), F.count("rule").cast("int").alias("sensitive"),
        F.max(level_order(F.col("rule.level"))).alias("top"))
    sensitive = marked.filter("rule is not null")
    if limit is not None:
        order = Window.partitionBy("archive").orderBy("position", "entry_name")
        sensitive = sensitive.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
    first = sensitive.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct(
        F.col("position").cast("long").alias("position"), "entry_name", F.col("size_bytes").cast("long").alias("size_bytes"),
        "rule.category"))).alias("listed"))
    listed = F.transform(F.coalesce("listed", F.array().cast(
        "array<struct<position:bigint,entry_name:string,size_bytes:bigint,category:string>>")), lambda e: F.struct(
            e["entry_name"].alias("name"), e["size_bytes"].alias("size_bytes"), F.lit(True).alias("is_sensitive"),
            e["category"].alias("sensitivity_category")))
    names = F.array(*[F.lit(x) for x in LEVELS])
    return (totals.join(first, "archive", "left").withColumn("shown", listed)
            .select("archive", F.struct(
                F.lit(True).alias("is_archive"), F.col("total").alias("total_entries"),
                F.col("sensitive").alias("sensitive_entries_count"),
                F.get(names, F.coalesce("top", F.lit(0))).alias("privacy_score"), F.col("shown").alias("entries"),
                tree_view(F.col("archive"), F.col("total"), F.col("sensitive"), F.col("shown")).alias("tree_view"),
            ).alias("archive_inspection")))
