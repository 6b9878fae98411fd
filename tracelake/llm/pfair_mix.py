"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of documents and scheduled by half blocks. The schedule runs in segments. At a segment's
end each source has had its exact target share rounded to whole half blocks: what is due, then those whose deadline, the
slot before which their share has to be whole, comes first. Inside a segment the half block j of a source that gets c of L slots
may be placed from slot floor(j L / c) on and must be placed before slot ceil((j + 1) L / c); the earliest deadline among the
released ones gets each slot. Both roundings stay below half a block, so at any slot every source has had its target
share to within less than one block, and nothing drifts however many blocks there are.

When a source runs out, a new phase starts, in which the others share in proportion to their weights. Only the numbers
at the segments' ends pass the driver; tasks schedule the segments. Documents find their places by joins of narrow
rows, and whole rows are moved once.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents a block; sources get a share in proportion to their size to this power.
BLOCK, EXPONENT = 16, 0.5
#: Slots of a segment, which one task schedules; a segment has at least this many slots a source.
SEGMENT, A_SOURCE = 1 << 16, 64
#: Documents that one task ranks at a time, about.
RANKED_TOGETHER = 10_000


def whole(weights: dict[str | None, float]) -> dict[str | None, int]:
    """The weights as whole numbers in exactly their proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("negative weight")
    scale = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * scale) for s, w in exact.items()}


def segments(shares: list[int], units: list[int], length: int) -> Iterator[tuple[int, bool, list[int], list[int]]]:
    """First slot, whether no source had run out, and for each source its first unit and how many it gets, of every segment.

    shares: weights as whole numbers; units: how many units each source has. At the end of a segment a source has had the floor
    or the ceiling of its share of the phase's slots. Ceilings go to the earliest deadlines, which leaves enough slots for all
    later ones. Sources of weight 0 follow, one after the other, when all others have run out.
    """
    done, t, first = [0] * len(units), 0, True
    active = [i for i, n in enumerate(units) if n and shares[i]]
    while active:
        total = sum(shares[i] for i in active)
        ends = {i: (units[i] - done[i]) * total // shares[i] for i in active}
        end, at, had = min(ends.values()), 0, dict.fromkeys(active, 0)
        while at < end:
            to = min(end, at + length)
            get = {i: max(to * shares[i] // total, had[i]) for i in active}
            due = sorted((-(-(get[i] + 1) * total // shares[i]), to < end or ends[i] > end, i)
                         for i in active if get[i] * total < to * shares[i])
            for *_, i in due[: to - sum(get.values())]:
                get[i] += 1
            yield (t + at, first, [done[i] + had.get(i, 0) for i in range(len(units))],
                   [get[i] - had[i] if i in had else 0 for i in range(len(units))])
            at, had = to, get
        for i in active:
            done[i] += had[i]
        t, first = t + end, False
        active = [i for i in active if done[i] < units[i]]
    for i, n in enumerate(units):
        for a in range(0, 0 if shares[i] else n, length):
            many = min(length, n - a)
            yield t, False, [a if k == i else 0 for k in range(len(units))], [many if k == i else 0 for k in range(len(units))]
            t += many


def earliest(counts: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, unit, slot, release, deadline) of one segment in which each source gets counts[source] slots."""
    total = sum(counts)
    coming, ready, turn = [(0, i) for i, c in enumerate(counts) if c], [], [0] * len(counts)
    heapify(coming)
    for t in range(total):
        while coming and coming[0][0] <= t:
            release, i = heappop(coming)
            heappush(ready, (-(-(turn[i] + 1) * total // counts[i]), i, release))
        due, i, release = heappop(ready)
        assert due > t, "weights above one"
        yield i, turn[i], t, release, due
        turn[i] += 1
        if turn[i] < counts[i]:
            heappush(coming, (turn[i] * total // counts[i], i))


def schedule(spark, names: list[str], shares: list[int], units: list[int], length: int) -> DataFrame:
    """(mix_source, mix_unit, mix_slot, mix_release, mix_deadline, mix_balanced) of every unit, scheduled by tasks."""
    parts = list(segments(shares, units, max(length, A_SOURCE * len(units))))
    many = pa.list_(pa.int64())
    table = pa.table([pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.bool_()),
                      pa.array([p[2] for p in parts], many), pa.array([p[3] for p in parts], many)],
                     names=["slot", "balanced", "first", "counts"])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = list(earliest(row["counts"]))
                if found:
                    i, unit, slot, release, due = np.array(found, np.int64).T
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names).take(pa.array(i)), pa.array(unit + np.array(row["first"])[i]),
                         *(pa.array(x + row["slot"]) for x in (slot, release, due)), pa.array(np.full(len(i), row["balanced"]))],
                        ["mix_source", "mix_unit", "mix_slot", "mix_release", "mix_deadline", "mix_balanced"])

    rows = spark.createDataFrame(table).repartition(min(max(1, len(parts)), 4096), "slot")
    return rows.mapInArrow(run, "mix_source string, mix_unit long, mix_slot long, mix_release long, mix_deadline long, "
                                "mix_balanced boolean")


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """docs with the columns mix_rank, mix_block, mix_slot, mix_release, mix_deadline, mix_order and mix_balanced.

    docs: doc_id long, source string, further columns are kept (names that start with mix_ are replaced). weights:
    target share of each source, to any scale; without them the square roots of the sources' sizes. A source of weight 0
    follows after all others. mix_order sorts the mixture: slot by slot (of half a block, of which `block` is a multiple),
    and within a slot by rank. mix_balanced tells whether all sources with a weight still had documents in that slot; up to
    there each source has had its share to within less than one block, and afterwards the others share in the same way what is
    left. Every row is kept. Documents of a source are in the order of a hash of doc_id. Rows that repeat doc_id and source take up a
    place each but all carry the first of these, as do a source's rows without doc_id; they stay side by side. A null
    source is a source. Sources and weights pass the driver, with two numbers a source and segment. Texts are not looked
    at. Empty tables give empty results.
    """
    if block % 2:
        raise ValueError("a block is two halves")
    half = block // 2
    docs = docs.drop(*(c for c in docs.columns if c.startswith("mix_")))
    name = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))  # joins as a plain key
    keyed = docs.select("doc_id", "source", name.alias("mix_source"))
    sizes = sorted(((r["mix_source"], r["source"], r["n"]) for r in keyed.groupBy("mix_source", "source").agg(F.count("*").alias("n")).collect()),
                   key=lambda r: r[0])
    shares = whole({key: weights[s] if weights else n ** EXPONENT for key, s, n in sizes})
    plan = schedule(docs.sparkSession, [key for key, *_ in sizes], [shares[key] for key, *_ in sizes],
                    [-(-n // half) for *_, n in sizes], segment)

    ranges = max(1, sum(n for *_, n in sizes) // RANKED_TOGETHER)
    order = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(42))
    rows = (keyed.groupBy("mix_source", "doc_id").agg(F.count("*").alias("n")).withColumn("mix_hash", order)
            .withColumn("mix_range", F.pmod("mix_hash", F.lit(ranges))))
    per = rows.groupBy("mix_source", "mix_range").agg(F.sum("n").alias("n"))
    preceding = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = per.select("mix_source", "mix_range", preceding(Window.partitionBy("mix_source").orderBy("mix_range")).alias("mix_before"))
    own = Window.partitionBy("mix_source", "mix_range").orderBy("mix_hash", "doc_id")
    rows = rows.withColumn("mix_number", preceding(own)).join(before, ["mix_source", "mix_range"])
    rows = rows.select("mix_source", "doc_id", (F.col("mix_before") + F.col("mix_number")).alias("mix_rank"))
    rows = (rows.withColumn("mix_unit", F.expr(f"mix_rank div {half}")).join(plan, ["mix_source", "mix_unit"])
            .withColumn("mix_block", F.expr(f"mix_rank div {block}"))
            .withColumn("mix_order", F.col("mix_slot") * half + F.pmod("mix_rank", F.lit(half)))
            .select(F.coalesce("doc_id", F.lit(0)).alias("mix_doc"), F.col("doc_id").isNull().alias("mix_null"), "mix_source",
                    "mix_rank", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_order", "mix_balanced"))
    out = docs.withColumn("mix_source", name).withColumn("mix_doc", F.coalesce("doc_id", F.lit(0))).withColumn("mix_null", F.col("doc_id").isNull())
    return (out.join(rows, ["mix_source", "mix_doc", "mix_null"])
            .select(*docs.columns, "mix_rank", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_order", "mix_balanced"))
