"""Budgeted, diverse choice of findings for the deep detectors.

Findings need: finding_id, ordinal, path, display_name, category, size_bytes, exposure_score, ignored, is_directory,
scan_status; width and height are optional.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.functions import paths
from tracelake.operators import evidence as ev
from tracelake.operators.ordering import first_per_group, top_per_group
from tracelake.session import discard, stored

FIVE_MB = 5 * 1024 * 1024
LARGE_ARCHIVE = 512 * 1024 * 1024
SHORT_HEAD = 50_000  # rows of a head of a queue that each task trims to by itself
TURNS = 16_384  # turns played in one round


def c(name: str) -> Column:
    return F.col(name)


def offer(condition: Column, scanner: str, suitability: Column, cost: int, reason: str) -> Column:
    """One possible route, null when it does not apply or the scanner has already run."""
    value = F.struct(F.lit(scanner).alias("scanner_id"), suitability.cast("int").alias("suitability"),
                     F.lit(cost).alias("cost"), F.lit(reason).alias("reason"))
    return F.when(condition & ~ev.is_completed(scanner), value)


def full_image_bonus(findings: DataFrame) -> Column:
    """TRI-2: 24 for a real photo, -12 for a known small one, 0 when unknown."""
    if "width" not in findings.columns:
        return F.lit(0)
    side = F.least("width", "height")
    pixels = c("width").cast("long") * c("height")
    return F.coalesce(F.when((side >= 480) & (pixels >= 500_000), 24).when(side > 0, -12), F.lit(0))


def offers(findings: DataFrame, ext: Column) -> Column:
    """TRI-2: every scanner that suits the finding, with its own bonus and cost."""
    text = ext.isin(fixed.PLAIN_TEXT_EXTENSIONS + fixed.OFFICE_EXTENSIONS)
    configured = ext.isin(fixed.CONFIG_EXTENSIONS)
    image = ext.isin(fixed.IMAGE_EXTENSIONS) | (F.lower("category") == "images")
    video = ~image & (ext.isin(fixed.VIDEO_EXTENSIONS) | (F.lower("category") == "video"))
    tagged = ext.isin(fixed.METADATA_EXTENSIONS)
    compact = F.when((c("size_bytes") > 0) & (c("size_bytes") <= FIVE_MB), 8).otherwise(-8)
    photo = full_image_bonus(findings)
    named = F.when(paths.contains_any(c("display_name"), fixed.TRIAGE_SENSITIVE_TOKENS), 12).otherwise(0)
    moderate, expensive, cheap = fixed.COST_MODERATE, fixed.COST_EXPENSIVE, fixed.COST_CHEAP
    return F.array_compact(F.array(
        offer(text, "pii", 18 + compact, moderate, "text-extractable format"),
        offer(text, "secrets", 20 + compact + F.when(configured, 10).otherwise(0), moderate, "text-extractable format"),
        offer(text, "identity", 14 + compact, moderate, "text-extractable format"),
        offer(text | configured | F.lower("display_name").startswith(".env"), "configs",
              F.when(configured, 32).otherwise(12), moderate, "configuration-like format or name"),
        offer(ext.isin(fixed.OPENABLE_ARCHIVES), "archives",
              F.when(c("size_bytes") <= LARGE_ARCHIVE, 24).otherwise(4), expensive, "supported archive format"),
        offer(image, "documents", 16 + photo + named, expensive, "image candidate for document detection"),
        offer(image, "people", 14 + photo, expensive, "image candidate for face detection"),
        offer(image, "image_safety", 14 + photo, expensive, "image candidate for local safety classification"),
        offer(image & tagged, "exif", F.lit(22), cheap, "format may contain metadata"),
        offer(video, "image_safety", F.lit(12), expensive,
              "video candidate for bounded local safety classification"),
        offer(~image & ~video & tagged, "exif", F.lit(14), cheap, "office format may contain metadata")))


def routes(findings: DataFrame) -> DataFrame:
    """TRI-1: one row per finding and suitable scanner; no shuffle, the routes are built in the row."""
    place = F.concat_ws(" ", "display_name", "path")
    exposed = c("exposure_score") >= 60
    sensitive = paths.contains_any(place, fixed.TRIAGE_SENSITIVE_TOKENS)
    demo = paths.contains_any(place, fixed.TRIAGE_DEMO_TOKENS)
    base = (25 + F.least(F.lit(25), F.floor(c("exposure_score") / 4).cast("int"))
            + F.when(c("_exposed"), 10).otherwise(0) + F.when(c("_sensitive"), 15).otherwise(0)
            - F.when(c("_demo"), 18).otherwise(0))
    common = F.array_compact(F.array(
        F.when(c("_exposed"), F.lit("high initial exposure")),
        F.when(c("_sensitive"), F.lit("sensitive name or path")),
        F.when(c("_demo"), F.lit("demo/default/cache path penalty"))))
    raw_extension = F.regexp_extract(paths.base_name("path"), r"(\.[^.]+)$", 1)
    diversity = F.concat_ws("|", "category", raw_extension, F.coalesce(paths.parent("path"), F.lit("")))
    usable = ~c("ignored") & ~c("is_directory") & (F.trim("path") != "")
    # posexplode drops findings without offers, so the offers are built only once
    rows = (findings.filter(usable).withColumn("_ext", paths.extension("path")).withColumn("_offers", offers(findings, c("_ext")))
            .withColumn("_exposed", exposed).withColumn("_sensitive", sensitive).withColumn("_demo", demo)
            .select("finding_id", "ordinal", base.alias("_base"), common.alias("_common"),
                    diversity.alias("diversity_key"), F.posexplode("_offers").alias("route_no", "o")))
    return rows.select(
        "finding_id", "ordinal", "route_no", c("o.scanner_id").alias("scanner_id"),
        F.greatest(F.lit(1), F.least(F.lit(100), c("_base") + c("o.suitability"))).alias("priority"),
        c("o.cost").alias("cost"), "diversity_key",
        F.array_distinct(F.array_append(c("_common"), c("o.reason"))).alias("reasons"))


def limits(eligible: int, absolute_limit: int | None = None,
           fraction: float = fixed.TRIAGE_FRACTION) -> dict[str, int | None]:
    """TRI-3, AGG-12: requested share, limit and cost budget."""
    requested = max(1, math.ceil(eligible * fraction)) if eligible else 0
    limit = requested if absolute_limit is None else min(requested, max(1, absolute_limit))
    budget = max(limit * fixed.TRIAGE_BUDGET_PER_FINDING, 1) if eligible else 0
    return {"eligible": eligible, "requested": requested, "limit": limit, "absolute_limit": absolute_limit,
            "cost_budget": budget}


def counters(findings: DataFrame, absolute_limit: int | None = None) -> DataFrame:
    """TRI-3, AGG-12 as a one-row DataFrame: a finding is eligible when it has any route, so no distinct is needed."""
    usable = ~c("ignored") & ~c("is_directory") & (F.trim("path") != "")
    rows = findings.filter(usable).withColumn("_ext", paths.extension("path"))
    eligible = rows.agg(F.count_if(F.size(offers(findings, c("_ext"))) > 0).alias("eligible"))
    share = F.greatest(F.lit(1), F.ceil(c("eligible") * fixed.TRIAGE_FRACTION))
    requested = F.when(c("eligible") == 0, 0).otherwise(share)
    limit = requested if absolute_limit is None else F.least(requested, F.lit(max(1, absolute_limit)))
    return (eligible.withColumn("requested", requested).withColumn("selection_limit", limit)
            .withColumn("cost_budget", F.when(c("eligible") == 0, 0).otherwise(
                F.greatest(F.lit(1), limit * fixed.TRIAGE_BUDGET_PER_FINDING))))


def queue_heads(all_routes: DataFrame, limit: int) -> DataFrame:
    """WIN-3: the first `limit` routes of every scanner in diversified order, with their position.

    Dealing one route per diversity group and round equals sorting by (rank inside the group, place of the
    group's best route). A group never needs more than `limit` rows, nor does a scanner; up to SHORT_HEAD rows each
    task trims its groups to that before the shuffle, longer heads are positions in a range sort.
    """
    best_first = [F.desc("priority"), F.asc("ordinal"), F.asc("route_no")]
    keyed = (all_routes.withColumn("group_key", F.lower("diversity_key"))
             .select("finding_id", "ordinal", "route_no", "scanner_id", "priority", "cost", "group_key"))
    deal = [F.asc("group_rank"), F.desc("lead_priority"), F.asc("lead_ordinal"), F.asc("group_key"), F.asc("route_no")]
    if limit <= SHORT_HEAD:
        group = Window.partitionBy("scanner_id", "group_key").orderBy(*best_first)
        ranked = keyed.withColumn("group_rank", F.row_number().over(group)).filter(c("group_rank") <= limit)
        lead = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        led = (ranked.withColumn("lead_priority", F.first("priority").over(lead))
               .withColumn("lead_ordinal", F.first("ordinal").over(lead)))
        place = F.row_number().over(Window.partitionBy("scanner_id").orderBy(*deal))
        return led.withColumn("position", place).filter(c("position") <= limit)
    ranked = top_per_group(keyed, ["scanner_id", "group_key"], best_first, limit, "group_rank")
    leaders = ranked.filter("group_rank = 1").select("scanner_id", "group_key", c("priority").alias("lead_priority"),
                                                     c("ordinal").alias("lead_ordinal"))
    led = ranked.join(leaders, ["scanner_id", "group_key"])
    return top_per_group(led, ["scanner_id"], deal, limit, "position")


def played(names: list[str], ends: dict[str, bool], before: int, limit: int):
    """A function that plays turns over one sorted block (scanner_id, position, finding_id) and yields the picks.

    `ends` tells whether the block holds a scanner's queue up to its end. Play stops at `limit`, when no queue has a row
    left, or before a turn in which a queue would run out of rows that the block doesn't hold.
    """

    def run(batches):
        batches = [batch for batch in batches if batch.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        scanner, finding = (table.column(name).combine_chunks() for name in ("scanner_id", "finding_id"))
        code = finding.dictionary_encode().indices.to_numpy().tolist()
        taken, picks = bytearray(len(code) + 1), []
        starts = [pc.index(scanner, name).as_py() for name in names]
        many = {r["values"]: r["counts"] for r in pc.value_counts(scanner).to_pylist()}
        at = [max(0, first) for first in starts]
        stop = [first + many.get(name, 0) for first, name in zip(at, names)]
        live = list(range(len(names)))
        while live and before + len(picks) < limit:
            turn = []
            for s in list(live):
                k = at[s]
                while k < stop[s] and taken[code[k]]:
                    k += 1
                at[s] = k
                if k == stop[s]:
                    if not ends[names[s]]:
                        live, turn = [], []
                        break
                    live.remove(s)
                else:
                    taken[code[k]] = 1
                    turn.append(k)
            picks += turn
        picks = picks[: limit - before]
        number = pa.array(range(before + 1, before + 1 + len(picks)), pa.int64())
        yield pa.RecordBatch.from_arrays([*(table.column(x).combine_chunks().take(pa.array(picks, pa.int64()))
                                            for x in ("scanner_id", "position", "finding_id")), number],
                                         ["scanner_id", "position", "finding_id", "pick"])

    return run


def take_turns(queues: DataFrame, limit: int, turns: int = TURNS) -> DataFrame:
    """Scanners in name order take turns; in its turn a scanner takes the next finding of its queue (scanner_id,
    position, finding_id) that nobody has taken, until `limit` are: (finding_id, scanner_id, pick).

    What has been picked is a frozen prefix. A round plays the next turns in one task over a block of bounded size: of each
    queue as many rows, less the findings taken before, as `turns` turns of all scanners can use up. Rounds are as
    many as the picks of all scanners go into blocks, one for everyday limits, and each is a written table.
    """
    rows = stored(queues.select("scanner_id", c("position").cast("long").alias("position"), "finding_id"))
    last = {r["scanner_id"]: r["last"] for r in rows.groupBy("scanner_id").agg(F.max("position").alias("last")).collect()}
    names, done, total = sorted(last), [], 0
    front, usual = dict.fromkeys(names, 0), turns * max(1, len(names))
    reach = usual
    while True:
        ahead = F.create_map(*(F.lit(x) for s in names for x in (s, front[s])))[c("scanner_id")] if names else F.lit(0)
        block = rows.filter((c("position") >= ahead) & (c("position") < ahead + reach))
        if done:
            block = block.join(reduce(DataFrame.unionByName, done).select("finding_id"), "finding_id", "left_anti")
        ends = {s: front[s] + reach > last[s] for s in names}
        picks = stored(block.select("scanner_id", "position", "finding_id").repartition(1).sortWithinPartitions("scanner_id", "position")
                       .mapInArrow(played(names, ends, total, limit), "scanner_id string, position long, finding_id string, pick long"))
        got = {r["scanner_id"]: r for r in picks.groupBy("scanner_id").agg(F.max("position").alias("to"), F.count("*").alias("n")).collect()}
        done.append(picks)
        total += sum(r["n"] for r in got.values())
        if all(ends.values()) or total >= limit:
            break
        front.update((s, r["to"] + 1) for s, r in got.items())
        reach = usual if got else 2 * reach  # a queue may go on with a long run of taken rows
    discard(rows)
    return reduce(DataFrame.unionByName, done).select("finding_id", "scanner_id", c("pick").cast("int").alias("pick"))


def chosen(all_routes: DataFrame, eligible: int, absolute_limit: int | None = None) -> DataFrame:
    """TRI-4: the chosen findings, the scanner that picked each, and the pick number. The cost budget never decides:
    it allows more for each pick than any route costs."""
    limit = limits(eligible, absolute_limit)["limit"]
    return take_turns(queue_heads(all_routes, max(1, limit)), limit)


def expanded(all_routes: DataFrame, picks: DataFrame) -> DataFrame:
    """TRI-5: every applicable route of the chosen findings. Picking routes come first in pick order, the rest
    by priority."""
    ids = picks.select("finding_id", F.col("scanner_id").alias("picked_by"), "pick")
    rows = all_routes.join(ids, "finding_id").withColumn(
        "picking_route", F.col("scanner_id") == F.col("picked_by"))
    return rows.drop("picked_by").orderBy(*route_order())


def route_order() -> list[Column]:
    return [F.desc("picking_route"), F.when(F.col("picking_route"), F.col("pick")).asc_nulls_last(), F.desc("priority"),
            F.asc("ordinal"), F.asc("route_no")]


def eligible_count(findings: DataFrame) -> int:
    return counters(findings).first()["eligible"]


def select(findings: DataFrame, absolute_limit: int | None = None):
    """The whole selection: picks, routes of the picks, and the counters. The picks are stored once for both."""
    all_routes = routes(findings)
    plan = limits(eligible_count(findings), absolute_limit)
    picks = stored(chosen(all_routes, plan["eligible"], absolute_limit))
    return picks, expanded(all_routes, picks), plan


def recovered_session(sessions: DataFrame) -> DataFrame:
    """TRI-7: per audit the newest completed session, else the newest one; then the newest of those.

    Sessions: session_id, audit_fingerprint, status, updated_at.
    """
    completed = F.col("status") == "Completed"
    per_audit = first_per_group(sessions, ["audit_fingerprint"], completed.desc(), F.desc("updated_at"), F.asc("session_id"))
    return per_audit.orderBy(F.desc("updated_at"), F.asc("session_id")).limit(1)


def scanner_stages(state: DataFrame) -> DataFrame:
    """Completed, skipped and failed routes per scanner."""
    return state.groupBy("scanner_id").agg(*[
        F.count_if(F.col("state") == s).alias(s) for s in ("completed", "skipped", "failed")])
