"""Queries that route findings to detectors and choose what to scan."""

from __future__ import annotations


from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.operators import aggregates, joins, pii, secrets, triage
from tracelake.plans import oracle as o
from tracelake.plans.registry import query
from tracelake.plans.views import Views
from tracelake.sources import scanners

c = F.col


def token_sql(words: list[str], text: str) -> str:
    return f"regexp_matches(lower({text}), '{'|'.join(words)}')"


TEXTUAL = f"ext IN {o.in_list(fixed.PLAIN_TEXT_EXTENSIONS + fixed.OFFICE_EXTENSIONS)}"
CONFIGURED = f"ext IN {o.in_list(fixed.CONFIG_EXTENSIONS)}"
IMAGE = f"(ext IN {o.in_list(fixed.IMAGE_EXTENSIONS)} OR category = 'Images')"
VIDEO = f"(NOT {IMAGE} AND (ext IN {o.in_list(fixed.VIDEO_EXTENSIONS)} OR category = 'Video'))"
TAGGED = f"ext IN {o.in_list(fixed.METADATA_EXTENSIONS)}"
COMPACT = "(CASE WHEN size_bytes > 0 AND size_bytes <= 5242880 THEN 8 ELSE -8 END)"
OFFERS = [
    ("pii", TEXTUAL, f"18 + {COMPACT}", 3), ("secrets", TEXTUAL, f"20 + {COMPACT} + (CASE WHEN {CONFIGURED} THEN 10 ELSE 0 END)", 3),
    ("identity", TEXTUAL, f"14 + {COMPACT}", 3),
    ("configs", f"({TEXTUAL} OR {CONFIGURED} OR starts_with(lower(display_name), '.env'))", f"(CASE WHEN {CONFIGURED} THEN 32 ELSE 12 END)", 3),
    ("archives", f"ext IN {o.in_list(fixed.OPENABLE_ARCHIVES)}", "(CASE WHEN size_bytes <= 536870912 THEN 24 ELSE 4 END)", 8),
    ("documents", IMAGE, f"16 + (CASE WHEN {token_sql(fixed.TRIAGE_SENSITIVE_TOKENS, 'display_name')} THEN 12 ELSE 0 END)", 8),
    ("people", IMAGE, "14", 8), ("image_safety", IMAGE, "14", 8), ("exif", f"({IMAGE} AND {TAGGED})", "22", 1),
    ("image_safety", VIDEO, "12", 8), ("exif", f"(NOT {IMAGE} AND NOT {VIDEO} AND {TAGGED})", "14", 1),
]
BASE = f"""(25 + least(25, exposure_score // 4) + (CASE WHEN exposure_score >= 60 THEN 10 ELSE 0 END)
    + (CASE WHEN {token_sql(fixed.TRIAGE_SENSITIVE_TOKENS, "display_name || ' ' || path")} THEN 15 ELSE 0 END)
    - (CASE WHEN {token_sql(fixed.TRIAGE_DEMO_TOKENS, "display_name || ' ' || path")} THEN 18 ELSE 0 END))"""
ROUTES = "(" + " UNION ALL ".join(
    f"SELECT finding_id, ordinal, '{s}' AS scanner_id, greatest(1, least(100, {BASE} + {points})) AS priority, {cost} AS cost, "
    "lower(category || '|' || ext || '|' || regexp_replace(path, '\\\\[^\\\\]*$', '')) AS group_key "
    f"FROM audited WHERE NOT ignored AND NOT is_directory AND {condition} AND NOT done_{s}" for s, condition, points, cost in OFFERS) + ")"


@query("tri1_routes", f"SELECT finding_id, scanner_id, CAST(priority AS BIGINT) AS priority, CAST(cost AS BIGINT) AS cost, group_key FROM {ROUTES}", ("audited",))
def _(v: Views):
    return triage.routes(v.audited).select("finding_id", "scanner_id", c("priority").cast("long").alias("priority"),
                                           c("cost").cast("long").alias("cost"), F.lower("diversity_key").alias("group_key"))


PHOTO = "(CASE WHEN least(width, height) >= 480 AND width * height >= 500000 THEN 24 WHEN least(width, height) > 0 THEN -12 ELSE 0 END)"


@query("tri2_image_size_bonus", f"""
    SELECT finding_id, CAST(greatest(1, least(100, {BASE} + 14 + {PHOTO})) AS BIGINT) AS priority
    FROM (SELECT *, CASE WHEN ordinal % 3 > 0 THEN 100 * (ordinal % 17) END AS width, CASE WHEN ordinal % 3 > 0 THEN 60 * (ordinal % 19) END AS height FROM audited)
    WHERE NOT ignored AND NOT is_directory AND {IMAGE} AND NOT done_people""", ("audited",))
def _(v: Views):
    n = c("ordinal")
    sized = v.audited.withColumn("width", F.when(n % 3 > 0, 100 * (n % 17)).cast("int")).withColumn("height", F.when(n % 3 > 0, 60 * (n % 19)).cast("int"))
    return triage.routes(sized).filter("scanner_id = 'people'").select("finding_id", c("priority").cast("long").alias("priority"))


LIMITS = f"(SELECT eligible, requested, requested AS selection_limit FROM (SELECT eligible, CASE WHEN eligible = 0 THEN 0 ELSE greatest(1, CAST(ceil(eligible * 0.05) AS BIGINT)) END AS requested FROM (SELECT count(DISTINCT finding_id) AS eligible FROM {ROUTES})))"


@query("tri3_limits", f"SELECT eligible, requested, selection_limit, CASE WHEN eligible = 0 THEN 0 ELSE greatest(1, selection_limit * 24) END AS cost_budget FROM {LIMITS}", ("audited",))
def _(v: Views):
    return triage.counters(v.audited)


@query("win3_diversified_queues", f"""
    SELECT scanner_id, position, finding_id FROM (
      SELECT *, row_number() OVER (PARTITION BY scanner_id ORDER BY group_rank, lead_priority DESC, lead_ordinal) AS position FROM (
        SELECT *, row_number() OVER g AS group_rank, first_value(priority) OVER g AS lead_priority, first_value(ordinal) OVER g AS lead_ordinal
        FROM {ROUTES} WINDOW g AS (PARTITION BY scanner_id, group_key ORDER BY priority DESC, ordinal)))
    WHERE position <= 40""", ("audited",))
def _(v: Views):
    return triage.queue_heads(triage.routes(v.audited), 40).select("scanner_id", c("position").cast("long").alias("position"), "finding_id")


@query("win3_diversified_queues_salted", f"""
    SELECT scanner_id, position, finding_id FROM (
      SELECT *, row_number() OVER (PARTITION BY scanner_id ORDER BY group_rank, lead_priority DESC, lead_ordinal) AS position FROM (
        SELECT *, row_number() OVER g AS group_rank, first_value(priority) OVER g AS lead_priority, first_value(ordinal) OVER g AS lead_ordinal
        FROM {ROUTES} WINDOW g AS (PARTITION BY scanner_id, group_key ORDER BY priority DESC, ordinal)))
    WHERE position <= 1500""", ("audited",))
def _(v: Views):
    return triage.queue_heads(triage.routes(v.audited), 1500).select("scanner_id", c("position").cast("long").alias("position"), "finding_id")


QUEUE = """(SELECT scanner_id, row_number() OVER (PARTITION BY scanner_id ORDER BY group_rank, lead_priority DESC, lead_ordinal) AS position, finding_id FROM (
    SELECT *, row_number() OVER g AS group_rank, first_value(priority) OVER g AS lead_priority, first_value(ordinal) OVER g AS lead_ordinal
    FROM routes WINDOW g AS (PARTITION BY scanner_id, group_key ORDER BY priority DESC, ordinal)))"""
# The next pick belongs to the first scanner after the last one, in a circle, that still has a free finding.
PICKS = f"""routes AS MATERIALIZED (SELECT * FROM {ROUTES}), queue AS MATERIALIZED (SELECT * FROM {QUEUE}),
    plan AS MATERIALIZED (SELECT greatest(1, CAST(ceil(count(DISTINCT finding_id) * 0.05) AS BIGINT)) AS selection_limit FROM routes),
    steps AS (SELECT 0 AS pick, '' AS scanner_id, '' AS finding_id, CAST([] AS VARCHAR[]) AS taken UNION ALL
      SELECT pick + 1, best.s, best.f, list_append(taken, best.f) FROM (
        SELECT p.pick, p.taken, arg_min({{'s': q.scanner_id, 'f': q.finding_id}}, (q.scanner_id <= p.scanner_id, q.scanner_id, q.position)) AS best
        FROM steps p JOIN queue q ON NOT list_contains(p.taken, q.finding_id) WHERE p.pick < (SELECT selection_limit FROM plan)
        GROUP BY p.pick, p.taken)),
    picks AS (SELECT pick, scanner_id, finding_id FROM steps WHERE pick > 0)"""


@query("tri4_chosen_findings", f"SELECT * FROM (WITH RECURSIVE {PICKS} SELECT finding_id, scanner_id, pick FROM picks)", ("audited",))
def _(v: Views):
    return triage.select(v.audited)[0]


@query("tri5_all_routes_of_chosen", f"""
    SELECT * FROM (WITH RECURSIVE {PICKS} SELECT r.finding_id, r.scanner_id, CAST(r.priority AS BIGINT) AS priority, r.scanner_id = p.scanner_id AS picking_route
    FROM routes r JOIN picks p ON r.finding_id = p.finding_id)""", ("audited",))
def _(v: Views):
    return triage.select(v.audited)[1].select("finding_id", "scanner_id", c("priority").cast("long").alias("priority"), "picking_route")


STATE = """(SELECT finding_id, 'pii' AS scanner_id, ['completed', 'skipped', 'failed'][ordinal % 3 + 1] AS state FROM findings
    UNION ALL SELECT finding_id, 'exif', ['failed', 'completed'][ordinal % 2 + 1] FROM findings)"""


@query("jn7_pending_routes", f"""
    SELECT finding_id, scanner_id FROM {ROUTES} r WHERE NOT EXISTS (SELECT 1 FROM {STATE} s WHERE s.finding_id = r.finding_id AND s.scanner_id = r.scanner_id
      AND s.state IN ('completed', 'skipped'))""", ("audited",))
def _(v: Views):
    return joins.pending_routes(triage.routes(v.audited), v.route_state).select("finding_id", "scanner_id")


@query("agg12_triage_counters", f"SELECT eligible, requested, selection_limit * 24 AS cost_budget FROM {LIMITS}", ("audited",))
def _(v: Views):
    return triage.counters(v.audited).select("eligible", "requested", "cost_budget")


@query("agg13_session_progress", f"""
    SELECT total_routes, finished_routes, round(least(1, finished_routes / CAST(total_routes AS DOUBLE)), 9) AS progress
    FROM (SELECT (SELECT count(*) FROM {ROUTES}) AS total_routes, (SELECT count(*) FROM {STATE} WHERE state IN ('completed', 'skipped')) AS finished_routes)""", ("audited",))
def _(v: Views):
    return aggregates.session_progress(triage.routes(v.audited), v.route_state).withColumn("progress", F.round("progress", 9))


def broken(_rows):
    raise RuntimeError("this detector always fails")


@query("tri6_detector_stages", f"""
    SELECT scanner_id, state, count(*) AS routes FROM (SELECT scanner_id, CASE WHEN scanner_id IN ('pii', 'secrets') THEN 'completed' ELSE 'skipped' END AS state FROM {ROUTES}
      UNION ALL SELECT scanner_id, 'failed' FROM {ROUTES} WHERE scanner_id = 'secrets' AND ordinal % 10 = 1) GROUP BY scanner_id, state""", ("audited",))
def _(v: Views):
    """Personal data and secrets run, the config detector breaks, all others are missing."""
    registry = scanners.Registry([
        scanners.Detector("pii", lambda df: pii.with_pii(df), c("pii.total_matches") > 0),
        scanners.Detector("secrets", lambda df: secrets.with_secrets(df), c("secrets.total_matches") > 0, failed=c("ordinal") % 10 == 1),
        scanners.Detector("configs", broken, F.lit(False)),
        scanners.Detector("people", broken, F.lit(False), available=lambda: False),
    ])
    rows = v.audited.join(v.documents.select(c("doc_id").alias("ordinal"), "text"), "ordinal")
    _, state = scanners.run_stages(v.spark, registry, triage.routes(v.audited).select("finding_id", "scanner_id"), rows)
    return state.groupBy("scanner_id", "state").agg(F.count(F.lit(1)).alias("routes"))


@query("tri7_recovered_session", """
    SELECT session_id, status, updated_at FROM (
      SELECT CAST(o_orderkey AS VARCHAR) AS session_id, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'Completed' ELSE 'Paused' END AS status, o_orderdate AS updated_at FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate DESC, session_id) = 1)
    ORDER BY updated_at DESC, session_id LIMIT 1""")
def _(v: Views):
    return triage.recovered_session(v.sessions).select("session_id", "status", "updated_at")


