"""Top rows per group, global positions, sorts, pages and retention."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.functions import scalars
from tracelake.session import pinned

#: Ranges of a histogram, and rows level with a cut that are left to a sort.
CELLS, SMALL = 4096, 50_000


def first_per_group(df: DataFrame, keys: list, *order: Column) -> DataFrame:
    """WIN-1, WIN-2: one row per key. The limit runs before the shuffle, so a hot key ships one row per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str) -> DataFrame:
    """Exactly the first k rows of every group, numbered from 1. `order` ends in a unique column.

    The rank is the position in one range sort by group and order, less the group's first position, so a hot
    group is ranked by as many tasks as it needs.
    """
    placed = with_positions(df, *[F.asc(key) for key in keys], *order, out="__position")
    first = placed.groupBy(*keys).agg(F.min("__position").alias("__first"))
    same = [F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) for key in keys]
    joined = placed.alias("l").join(first.alias("r"), reduce(lambda x, y: x & y, same))
    rank = F.col("__position") - F.col("__first") + 1
    return joined.select("l.*", rank.alias(out)).drop("__position").filter(F.col(out) <= k)


def with_positions(df: DataFrame, *order: Column, out: str = "position") -> DataFrame:
    """Zero-based position in a total order, without a single-task window.

    The order must end in a unique column: ranges then split even when the leading key is constant. The
    sorted rows are pinned, so counting the ranges and numbering the rows see the same ranges.
    """
    return _numbered(pinned(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())), out)


def _numbered(ranged: DataFrame, out: str) -> DataFrame:
    ranged = ranged.withColumn("__range", F.shiftright("__at", 33))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # One row per shuffle partition: small whatever the data size.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (ranged.join(F.broadcast(starts), "__range")
            .withColumn(out, F.col("__start") + inside).drop("__at", "__range", "__start"))


def positions(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """(key, position): like `with_positions`, but only the unique key is pinned, however wide the rows are."""
    ranged = pinned(df.orderBy(*order).select(key, F.monotonically_increasing_id().alias("__at")))
    return _numbered(ranged, "position")


# --- selection ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class By:
    """A column to order by: rising with nulls first, or falling with nulls last."""

    name: str
    falling: bool = False

    def sort(self) -> Column:
        return F.desc_nulls_last(self.name) if self.falling else F.asc_nulls_first(self.name)

    def image(self, df: DataFrame) -> tuple[Column, bool]:
        """A long that follows the order, and whether different values have different ones."""
        kind, value, exact = df.schema[self.name].dataType.typeName(), F.col(self.name), True
        if kind in ("timestamp", "timestamp_ntz"):
            value = F.unix_micros(value.cast("timestamp"))
        elif kind == "date":
            value = F.unix_date(value).cast("long")
        elif kind == "string":
            value, exact = F.conv(F.rpad(F.hex(F.substring(value.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long"), False
        elif kind in ("byte", "short", "integer", "long", "boolean"):
            value = value.cast("long")
        else:  # fractions fall together, larger ones than a long holds as well
            wide = F.lit(float(1 << 62))
            held = F.when(value.isNotNull(), F.greatest(-wide, F.least(wide, value.cast("double"))))
            value, exact = F.floor(held).cast("long"), False
        return (F.bitwise_not(value) if self.falling else value), exact


@dataclass
class Cut:
    """The first rows of an order: those that `sure` names, `n_sure` of them, and some of the `n_maybe` that `maybe` names."""

    sure: Column
    maybe: Column
    n_sure: int
    n_maybe: int


def cut(df: DataFrame, order: list[By], k: int, small: int = SMALL) -> Cut:
    """Where the first k rows end, by counting: no row is moved. A histogram of CELLS ranges of the first column tells the range
    that holds row k; it is counted in finer ranges, then by the next column, until it has at most `small` rows."""
    sure, within, before, left = F.lit(False), F.lit(True), 0, None
    for by in order:
        value, exact = by.image(df)
        low, high = df.filter(within).agg(F.min(value), F.max(value)).first()
        while left is None or left > small:
            low, high = (0, 0) if low is None else (low, high)
            width = -(-(high - low + 1) // CELLS)
            wide = "decimal(20,0)" if high - low >= 1 << 62 else "long"
            cell = F.call_function("div", value.cast(wide) - F.lit(low).cast(wide), F.lit(width).cast(wide))
            cell = F.when(value.isNull(), F.lit(CELLS if by.falling else -1)).otherwise(cell.cast("long"))
            counts = sorted((r["cell"], r["count"]) for r in df.filter(within).groupBy(cell.alias("cell")).count().collect())
            at, left = None, 0
            for at, left in counts:
                if before + left >= k:
                    break
                before += left
            else:
                return Cut(sure | within, F.lit(False), before, 0)
            sure, within = sure | (within & (cell < at)), within & (cell == at)
            if at in (-1, CELLS):
                break
            low, high = low + at * width, min(high, low + (at + 1) * width - 1)
            if low == high:
                break
        if left is not None and (left <= small or not exact and at not in (-1, CELLS)):
            break
    return Cut(sure, within, before, left or 0)


def first_rows(df: DataFrame, order: list[By], k: int, key: str, small: int = SMALL) -> DataFrame:
    """Exactly the first k rows of an order that ends in the unique `key`; only rows level with row k are sorted."""
    found = cut(df, order, k, small)
    if found.n_sure + found.n_maybe <= k:
        return df.filter(found.sure | found.maybe)
    level = df.filter(found.maybe)
    kept = positions(level, key, *(by.sort() for by in order)).filter(F.col("position") < k - found.n_sure).select(key)
    return df.filter(found.sure).unionByName(level.join(kept, key, "left_semi"))


# --- sorts ----------------------------------------------------------------------------------------

SORT_KEYS = {
    "RiskLevel": lambda: scalars.risk_order(scalars.risk_level("exposure_score")),
    "ExposureScore": lambda: F.col("combined_score"),
    "PersonalAttentionScore": lambda: F.coalesce(F.col("personal_score"), F.lit(-1.0)),
    "ObjectivePrivacyRisk": lambda: F.col("objective_risk"),
    "CombinedPriority": lambda: F.col("combined_score"),
    "PrivacyRiskRank": lambda: F.col("privacy_rank"),
    "DetectionPriorityRank": lambda: F.col("detection_rank"),
    "Category": lambda: F.col("category"),
    "DisplayName": lambda: F.col("display_name"),
    "Path": lambda: F.col("path"),
    "SizeBytes": lambda: F.col("size_bytes"),
    "ModifiedAt": lambda: F.col("modified_at"),
}


def finding_order(name: str, descending: bool) -> list[Column]:
    """SRT-1: an unknown name sorts by modification time; input order breaks ties."""
    key = SORT_KEYS.get(name, SORT_KEYS["ModifiedAt"])()
    return [key.desc_nulls_last() if descending else key.asc_nulls_first(), F.asc("ordinal")]


INITIAL = [By("exposure_score", True), By("size_bytes", True), By("ordinal")]


def initial_order() -> list[Column]:
    """SRT-2."""
    return [by.sort() for by in INITIAL]


def media_order() -> list[Column]:
    """SRT-3."""
    return [F.desc("combined_score"), F.desc_nulls_last("modified_at"), F.asc("ordinal")]


def report_order(sort: str) -> list[Column]:
    """SRT-4."""
    if sort == "Privacy":
        return [F.desc("privacy_rank"), F.desc("detection_rank"), F.asc("ordinal")]
    if sort == "Modified":
        return [F.desc_nulls_last("modified_at"), F.asc("ordinal")]
    return [F.desc("detection_rank"), F.asc("ordinal")]


def page(df: DataFrame, order: list[By], requested: int, size: int = fixed.LIST_PAGE_SIZE, key: str = "finding_id", small: int = SMALL):
    """TOP-1: rows of one circular page and its counters (page, page_count, total, size). The order ends in a unique column.

    Counting finds where the page starts and ends (`cut`); only its rows and those level with its ends are sorted, by the order's
    columns and the key, and the rows of the page are then fetched by key.
    """
    if size < 1:
        raise ValueError("page size must be positive")
    total = df.count()
    pages = max(1, math.ceil(total / size))
    index = requested % pages
    start = index * size
    near, skipped = df, 0
    if start + size < total:
        end = cut(df, order, start + size, small)
        near = near.filter(end.sure | end.maybe)
    if start:
        begin = cut(df, order, start, small)
        near, skipped = near.filter(~begin.sure), begin.n_sure
    place = F.col("position") + skipped
    wanted = positions(near, key, *(by.sort() for by in order)).filter(place.between(start, start + size - 1)).select(key)
    return df.join(wanted, key, "left_semi"), {"page": index, "page_count": pages, "total": total, "page_size": size}


def presentation_page_size(tile_mode: bool, image_category: bool, tile_size: float) -> Column:
    """Page size of the tile view for images, else the list size."""
    if tile_mode and image_category:
        return scalars.tile_page_size(F.lit(float(tile_size)))
    return F.lit(fixed.LIST_PAGE_SIZE)


# --- retention ------------------------------------------------------------------------------------

def kept_by_rank(rows: DataFrame, keep: int, key: str, *order: By) -> DataFrame:
    """WIN-4: the first `keep` rows of an order that ends in the unique `key`. Events keep the newest ids
    (descending id); feedback literally keeps the oldest updates (ascending update time)."""
    return first_rows(rows, list(order), keep, key)


def retained(scans: DataFrame, findings: DataFrame, provenance: DataFrame, evidence: DataFrame, as_of: datetime,
             days: int = fixed.AUDIT_RETENTION_DAYS) -> dict[str, DataFrame]:
    """RET-1: drop scans finished before the cutoff with their findings, old provenance and orphan evidence."""
    cutoff = F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    expired = scans.filter(F.col("finished_at") < cutoff).select("scan_id")
    current = provenance.filter(F.col("analyzed_at") >= cutoff)
    return {
        "scans": scans.filter(~F.coalesce(F.col("finished_at") < cutoff, F.lit(False))),
        "findings": findings.join(expired, "scan_id", "left_anti"),
        "provenance": current,
        "evidence": evidence.join(current.select(F.col("finding_id").alias("provenance_id")), "provenance_id",
                                  "left_semi"),
    }
