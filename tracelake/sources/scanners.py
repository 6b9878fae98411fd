"""Extension points: scanners that produce finding tables and detectors that add evidence to one."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import evidence as ev
from tracelake.operators import joins
from tracelake.session import pinned, stored

RUN_TYPE = "scanner_id string, findings long, errors int, duration_ms long, message string"
STATE_TYPE = "finding_id string, scanner_id string, state string"


class Scanner(Protocol):
    """EXT-1."""

    name: str

    def scan(self, spark: SparkSession, context: dict) -> DataFrame: ...


def scanners_for(preset: str, files: list[Scanner], system: list[Scanner]) -> list[Scanner]:
    """SRC-10: the quick preset reads files only."""
    return list(files) if preset == "Quick" else [*files, *system]


def run_scanners(spark: SparkSession, scanners: Iterable[Scanner], context: dict) -> tuple[DataFrame | None, DataFrame]:
    """SRC-9, SET-1: every scanner is materialised on its own, so one failure leaves the others untouched."""
    outputs, runs = [], []
    for scanner in scanners:
        started = time.monotonic()
        try:
            rows = pinned(scanner.scan(spark, context))
            found, errors, message = rows.count(), 0, ""
            outputs.append(rows)
        except Exception as failure:  # isolation is the purpose
            found, errors, message = 0, 1, str(failure).splitlines()[0]
        runs.append((scanner.name, found, errors, int((time.monotonic() - started) * 1000), message))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outputs) if outputs else None
    return union, spark.createDataFrame(runs, RUN_TYPE)


@dataclass
class Detector:
    """EXT-2: `detect` adds one evidence struct; `confirmed` tells a hit from a clear result; `failed` marks rows
    whose detection went wrong."""

    id: str
    detect: Callable[[DataFrame], DataFrame]
    confirmed: Column
    failed: Column | None = None
    available: Callable[[], bool] = lambda: True


class Registry:
    """EXT-2: detectors by id, ignoring case."""

    def __init__(self, detectors: Iterable[Detector]):
        self._by_id = {d.id.lower(): d for d in detectors}

    def get(self, name: str) -> Detector | None:
        return self._by_id.get(name.lower())

    @property
    def ids(self) -> list[str]:
        return [d.id for d in self._by_id.values()]


def run_stages(spark: SparkSession, registry: Registry, routes: DataFrame, findings: DataFrame,
               state: DataFrame | None = None,
               on_stage: Callable[[str, DataFrame], None] | None = None,
               on_error: Callable[[str, Exception], None] | None = None, texts: tuple[str, ...] = ("text", "content")) -> tuple[DataFrame, DataFrame]:
    """TRI-6: one Spark job per detector over its pending routes. Unavailable detectors, those whose findings are all gone
    and failing stages are skipped (`on_error` hears why). After a stage every route of it is completed, also those of
    findings that are gone; failing rows are failed in addition, so they are not tried again. Returns the findings with
    their new evidence, without the columns `texts`, and the route states.

    Columns `texts` stay where they are: a stage reads those of its findings, and what is stored and checkpointed are
    the other columns. A finding carries the detectors it is routed to, so a stage is a filter.
    """
    states = state if state is not None else spark.createDataFrame([], STATE_TYPE)
    pending = stored(joins.pending_routes(routes, states).select("finding_id", "scanner_id"))
    scanners = [r["scanner_id"] for r in routes.select("scanner_id").distinct().orderBy("scanner_id").collect()]
    asked = pending.groupBy("finding_id").agg(F.collect_set("scanner_id").alias("__asked"))
    wide = [c for c in findings.columns if c in texts]
    bodies = findings.select("finding_id", *wide)
    findings = stored(findings.drop(*wide).join(asked, "finding_id", "left"))
    results = [states]
    for scanner in scanners:
        todo = pending.filter(F.col("scanner_id") == scanner)
        detector = registry.get(scanner)
        if detector is None or not detector.available():
            results.append(todo.withColumn("state", F.lit("skipped")))
            continue
        mine = F.coalesce(F.array_contains("__asked", scanner), F.lit(False))
        try:
            failed = F.lit(False) if detector.failed is None else F.coalesce(detector.failed, F.lit(False))
            given = findings.filter(mine)
            given = given.join(bodies, "finding_id") if wide else given
            detected = pinned(detector.detect(given).withColumn("__failed", failed)
                              .withColumn("__confirmed", F.coalesce(detector.confirmed, F.lit(False)))
                              .withColumn("scan_status", F.when(failed, F.col("scan_status"))
                                          .otherwise(ev.status_with(scanner))).drop(*wide))
            gone = detected.isEmpty()
        except Exception as problem:  # a broken stage must not end the audit
            logging.getLogger(__name__).warning("stage %s is skipped: %s", scanner, problem)
            if on_error is not None:
                on_error(scanner, problem)
            results.append(todo.withColumn("state", F.lit("skipped")))
            continue
        if gone:
            results.append(todo.withColumn("state", F.lit("skipped")))
            continue
        results.append(todo.withColumn("state", F.lit("completed")))
        results.append(detected.filter("__failed").select("finding_id", F.lit(scanner).alias("scanner_id"),
                                                          F.lit("failed").alias("state")))
        findings = findings.filter(~mine).unionByName(detected.drop("__failed", "__confirmed"), allowMissingColumns=True)
        if on_stage is not None:
            on_stage(scanner, detected.drop("__asked"))
    return findings.drop("__asked"), reduce(lambda a, b: a.unionByName(b), results)
