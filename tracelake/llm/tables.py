"""Storage and iteration helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracelake.session import discard, prepare, stored

__all__ = ["components", "discard", "extended", "head_words", "read", "settled", "slices", "stored",
           "stored_counting", "text_bytes", "tidy"]

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: Texts go to Python in small batches: tasks of one executor share its memory. Descriptions of plans, which the driver
#: keeps, are cut.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
            "spark.sql.maxPlanStringLength": "2048"}


def settled(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators rely on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return prepare(spark)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return settled(spark).read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage between rounds: Spark drops the shuffle files of rounds that are over, and a driver
    that plans hundreds of small jobs doesn't let its heap grow to the limit."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored_counting(df: DataFrame, some: Column | None = None) -> tuple[DataFrame, int]:
    """`stored`, and how many of its rows meet the condition `some` (all without one), counted while they are written: the driver
    keeps the plan, stages and metrics of every query, so one that only counts costs it as much as another."""
    seen = Observation()
    out = stored(df.observe(seen, F.count_if(F.lit(True) if some is None else some).alias("n")))
    return out, seen.get.get("n") or 0  # a plan found empty has no metrics


def extended(schema: StructType, fields: dict[str, str]) -> StructType:
    """A copy of the schema with further fields (name: type)."""
    out = StructType(list(schema.fields))
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and len + 1 offsets into them; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]: ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most `step` bytes each, one row at least."""
    a, rows = 0, len(offsets) - 1
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + step, "right")) - 1)
        yield a, b
        a = b


def components(links: DataFrame, a: str, b: str, label: str = "component_id") -> DataFrame:
    """Smallest id reachable over `links` for every id that has a link: (`a`, `label`).

    Each round every id takes the smallest label among its neighbours' and its label's label; rounds are written
    tables, so a lost executor costs one round; each is removed when the next is written, and the caller may discard the
    result. Both steps are partial minima and equi joins, and the number of rounds is logarithmic for the star-like
    groups that joins of this folder yield.
    """
    both = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
                  .unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v")).where("u <> v")).distinct())
    held = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("n")))
    while True:
        labels = held.select("u", F.col("n").alias("l"))
        spread = (both.join(labels.select(F.col("u").alias("v"), F.col("l").alias("m")), "v").groupBy("u")
                  .agg(F.min("m").alias("m")))
        hop = labels.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        after, changed = stored_counting(labels.join(spread, "u").join(hop, "l")
                                         .select("u", F.least("l", "m", "ll").alias("n"), F.col("l").alias("o")), F.expr("n <> o"))
        discard(held)
        held = after
        if not changed:
            discard(both)
            out = after.select(F.col("u").alias(a), F.col("n").alias(label))
            out.stored_in = after.stored_in
            return out


def head_words(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `size` words with their counts, the most frequent first, cut where a count would not fit whole."""
    step = F.floor(F.log2("c") * 16)
    many = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    least, room = None, size
    for at, n in many:
        room -= n
        if room < 0:
            break
        least = at
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found = counts.where(step >= F.lit(least)).select("word", "c").toArrow()
    word, c = found.column("word").to_numpy().view(np.uint64), found.column("c").to_numpy()
    by = np.lexsort((word, -c))
    return word[by], c[by]
