"""Queries over whole texts: personal data, secrets, configuration files and identity traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import paths
from tracelake.functions.paths import settled
from tracelake.operators import config, evidence, identity, ordering, pii, secrets
from tracelake.plans import oracle as o
from tracelake.plans.registry import query
from tracelake.plans.views import Views, file_path

c = F.col


def kind_query(number: int, kind: str, column: str) -> None:
    """One query per kind: number of matches and the samples of every text that has any."""
    @query(f"pii{number}_{column}", f"""
        SELECT key, CAST(len({column}) AS BIGINT) AS n, array_to_string({column}, '|') AS samples FROM pii_kinds WHERE len({column}) > 0""",
           ("pii_kinds",))
    def _(v: Views):
        found = settled(v.texts.select("key", "text"), "found", pii.KINDS[kind](c("text")))
        return found.filter(F.size("found") > 0).select("key", F.size("found").cast("long").alias("n"),
                                                        F.array_join("found", "|").alias("samples"))


for number, (kind, column) in enumerate(zip(pii.KINDS, o.KINDS), 1):
    kind_query(number, kind, column)


def fold_sql(cap: int | None) -> str:
    """Kept matches per kind: all, or with a cap at least one, and never beyond the room that is left."""
    if cap is None:
        total = " + ".join(o.KINDS)
        return f"SELECT key, CAST({total} AS BIGINT) AS total_matches, fio > 0 AND (phone > 0 OR email > 0 OR passport > 0) AS bundle " \
               f"FROM pii_counts WHERE {total} > 0"
    steps, before = [], "0"
    inner = "pii_counts"
    for k in o.KINDS:
        inner = f"(SELECT *, least({k}, greatest(1, {cap} - ({before}))) AS kept_{k} FROM {inner})"
        before += f" + kept_{k}"
        steps.append(f"kept_{k}")
    return f"SELECT key, CAST({' + '.join(steps)} AS BIGINT) AS total_matches, " \
           f"kept_fio > 0 AND (kept_phone > 0 OR kept_email > 0 OR kept_passport > 0) AS bundle FROM {inner} " \
           f"WHERE {' + '.join(steps)} > 0"


@query("pii12_total_and_bundle", fold_sql(None), ("pii_counts",))
def _(v: Views):
    rows = pii.with_pii(v.texts)
    return rows.filter("pii.total_matches > 0").select(
        "key", c("pii.total_matches").cast("long").alias("total_matches"),
        F.array_contains("pii.categories", "PII_Bundle").alias("bundle"))


@query("pii13_cap_fold", fold_sql(3), ("pii_counts",))
def _(v: Views):
    rows = pii.with_pii(v.texts, cap=3)
    return rows.filter("pii.total_matches > 0").select(
        "key", c("pii.total_matches").cast("long").alias("total_matches"),
        F.array_contains("pii.categories", "PII_Bundle").alias("bundle"))


@query("pii14_read_repair", """
    SELECT doc_id, doc_id % 4 AS total_matches, CASE WHEN doc_id % 4 > 0 THEN 'Email' ELSE '' END AS categories FROM documents""")
def _(v: Views):
    n = c("doc_id")
    stored = F.concat(
        F.lit('{"pii_scan":{"status":"completed","total_matches":99,"categories":["BirthDate"'),
        F.when(n % 4 > 0, F.lit(',"Email"')).otherwise(F.lit("")),
        F.lit('],"matches":[{"category":"birthdate","sample":"01.01.2000","confidence":0.75}'),
        F.array_join(F.array_repeat(F.lit(',{"category":"Email","sample":"a@b.cc","confidence":0.95}'), (n % 4).cast("int")), ""),
        F.lit("]}}"))
    rows = v.documents.select("doc_id", pii.repaired(evidence.parsed(stored, "pii")).alias("p"))
    return rows.select("doc_id", c("p.total_matches").cast("long").alias("total_matches"),
                       F.array_join("p.categories", ",").alias("categories"))


VENDORS = " UNION ALL ".join(
    f"SELECT key, '{name}' AS category, unnest(regexp_extract_all(text, '{pattern}')) AS hit FROM texts"
    for name, pattern in secrets.VENDOR_FORMATS)
BLOCKS = " UNION ALL ".join(
    "SELECT key, '{}' AS category, unnest(regexp_extract_all(text, '{}')) AS hit FROM texts".format(name, pattern.replace("\\\"'", "\"''"))
    for name, pattern in secrets.BLOCK_FORMATS)
ASSIGNED = ("(?i)\\b[A-Za-z0-9_.-]*(?:password|passwd|pwd|secret|token|api_?key|access_?key|private_?key)[A-Za-z0-9_]*"
            "[\"'']?[ \\t]*[=:][ \\t]*[\"'']?([!#-&(-+\\--:<-~]{8,})")


def secret_rows(v: Views, tagged):
    rows = v.texts.select("key", F.explode(tagged(c("text"))).alias("m"))
    return rows.groupBy("key", "m.category").agg(F.count(F.lit(1)).alias("n"), F.min("m.sample").alias("first_hit"))


GROUPED = "SELECT key, category, count(*) AS n, min(hit) AS first_hit FROM ({}) GROUP BY key, category"


@query("sec1_vendor_tokens", GROUPED.format(VENDORS), ("texts",))
def _(v: Views):
    return secret_rows(v, secrets.vendor_tokens)


@query("sec2_named_assignments", GROUPED.format(
    f"SELECT key, 'Named secret' AS category, hit FROM (SELECT key, unnest(regexp_extract_all(text, '{ASSIGNED}', 1)) AS hit FROM texts) "
    "WHERE NOT regexp_matches(hit, '^[A-Za-z_][A-Za-z_.]*(?:\\(.*)?$') AND NOT starts_with(hit, '$')"), ("texts",))
def _(v: Views):
    return secret_rows(v, secrets.assignments)


@query("sec3_keys_and_connections", GROUPED.format(BLOCKS), ("texts",))
def _(v: Views):
    return secret_rows(v, secrets.blocks)


ENTROPY = ("list_sum(list_transform(list_distinct(string_split(t, '')), lambda ch: "
           "-(len(t) - len(replace(t, ch, ''))) / CAST(len(t) AS DOUBLE) * log2((len(t) - len(replace(t, ch, ''))) / CAST(len(t) AS DOUBLE))))")


@query("sec4_entropy_tokens", GROUPED.format(
    f"""SELECT key, 'High entropy string' AS category, t AS hit FROM (SELECT DISTINCT key, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_-]{{20,}}={{0,2}}')) AS t FROM texts)
    WHERE regexp_matches(t, '[a-z]') AND regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[0-9]') AND {ENTROPY} >= 3.9"""), ("texts",))
def _(v: Views):
    return secret_rows(v, lambda t: secrets.entropy_tokens(t, 3.9))


NAMED = f"""SELECT DISTINCT key, category, hit FROM ({VENDORS} UNION ALL {BLOCKS} UNION ALL
    SELECT key, 'Named secret', hit FROM (SELECT key, unnest(regexp_extract_all(text, '{ASSIGNED}', 1)) AS hit FROM texts)
    WHERE NOT regexp_matches(hit, '^[A-Za-z_][A-Za-z_.]*(?:\\(.*)?$') AND NOT starts_with(hit, '$'))"""
SPARE = f"""SELECT DISTINCT key, t AS hit FROM (SELECT key, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_-]{{20,}}={{0,2}}')) AS t FROM texts)
    WHERE regexp_matches(t, '[a-z]') AND regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[0-9]') AND {ENTROPY} >= 4.0"""


SECRET_TOTALS = f"""
    SELECT key, count(*) AS total_matches, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM (
      {NAMED} UNION ALL SELECT key, 'High entropy string', hit FROM ({SPARE}) s
      WHERE NOT EXISTS (SELECT 1 FROM ({NAMED}) n WHERE n.key = s.key AND (contains(n.hit, s.hit) OR contains(s.hit, n.hit)))) GROUP BY key"""
o.CTES["secret_counts"] = (["texts"], SECRET_TOTALS)


@query("sec5_secret_totals", SECRET_TOTALS, ("texts",))
def _(v: Views):
    rows = secrets.with_secrets(v.texts)
    return rows.filter("secrets.total_matches > 0").select(
        "key", c("secrets.total_matches").cast("long").alias("total_matches"), F.array_join(F.array_sort("secrets.categories"), ",").alias("categories"))


CONFIG_TYPES = ("['Environment variables', 'NPM registry', 'Configuration', 'Maven settings', 'Docker Compose', 'VPN profile'][n % 6 + 1]")


@query("cfg1_config_type", f"SELECT n AS config_id, {CONFIG_TYPES} AS config_type FROM config_files", ("config_files",))
def _(v: Views):
    return v.config_files.select("config_id", F.coalesce(config.config_type("path"), F.lit("Configuration")).alias("config_type"))


@query("cfg2_exposed_parameters", "SELECT n AS config_id, exposed FROM config_files WHERE exposed <> ''", ("config_files",))
def _(v: Views):
    rows = settled(v.config_files.select("config_id", "text"), "names", config.exposed_parameters(c("text"))).select(
        "config_id", F.array_join("names", ",").alias("exposed"))
    return rows.filter("exposed <> ''")


@query("cfg3_endpoints_and_level", f"""
    SELECT n AS config_id, 'https://api' || (n % 7) || '.example.com/v1' AS endpoints,
           CASE WHEN exposed <> '' THEN 'High' WHEN {CONFIG_TYPES} <> 'Configuration' THEN 'Medium' ELSE 'Low' END AS exposure_level
    FROM config_files""", ("config_files",))
def _(v: Views):
    return config.with_config(v.config_files).select(
        "config_id", F.array_join("config.endpoints", ",").alias("endpoints"), "config.exposure_level")


@query("cfg4_generic_config_recheck", """
    SELECT n AS config_id, CASE WHEN n % 6 = 2 AND exposed = '' THEN 'Other' ELSE 'Potential secrets' END AS category,
           CASE WHEN n % 6 = 2 AND exposed = '' THEN 'File' ELSE 'Potential secret' END AS subcategory
    FROM config_files""", ("config_files",))
def _(v: Views):
    rows = secrets.with_secrets(config.with_config(v.config_files))
    return config.reclassified(rows).select("config_id", "category", "subcategory")


@query("idt1_identity_terms", "SELECT term, category FROM identity_terms", ("identity_terms",))
def _(v: Views):
    return identity.identity_terms(v.raw_terms).select("term", "category")


IDENTITY = "SELECT doc_id, CAST(sum(n) AS BIGINT) AS total_mentions, count(*) AS terms, min(category || ' (' || n || 'x): ' || term) AS first_label FROM identity_counts GROUP BY doc_id"


def identity_rows(v: Views, counted):
    """The path is a function of the number beside the text."""
    docs = v.document_texts.select("doc_id", "text", file_path(c("doc_id")).alias("path"))
    rows = counted(docs, identity.identity_terms(v.raw_terms))
    entries = F.transform(F.map_entries("identity.matched_terms"), lambda e: F.concat(e["value"], F.lit(": "), e["key"]))
    return rows.filter("identity.has_identity_trace").select(
        "doc_id", c("identity.total_mentions").cast("long").alias("total_mentions"),
        F.size("identity.matched_terms").cast("long").alias("terms"), F.array_min(entries).alias("first_label"))


@query("idt2_identity_mentions", IDENTITY, ("identity_counts",))
def _(v: Views):
    return identity_rows(v, identity.with_identity)


@query("jn11_identity_by_anchor_join", IDENTITY, ("identity_counts",))
def _(v: Views):
    return identity_rows(v, identity.identity_by_join)


@query("idt3_read_repair", """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 + 1 ELSE 77 END AS total_mentions FROM documents""")
def _(v: Views):
    n = c("doc_id")
    stored = F.concat(
        F.lit('{"identity_trace":{"has_identity_trace":true,"total_mentions":77,"matched_terms":{'),
        F.when(n % 3 == 0, F.lit('"bob":"User Profile Directory (9x)",')).otherwise(F.lit("")),
        F.lit('"a@b.cc":"Git Email ('), (n % 5 + 1).cast("string"), F.lit('x)"},"summary":"old"}}'))
    rows = v.documents.select("doc_id", identity.repaired(evidence.parsed(stored, "identity")).alias("i"))
    return rows.select("doc_id", c("i.total_mentions").cast("long").alias("total_mentions"))


@query("flagship_risk_by_language", f"""
    SELECT lang, count(*) AS files, count(*) FILTER (total > 0) AS with_personal_data, CAST(sum(total) AS BIGINT) AS matches,
           CAST(sum(least(100, exposure + CASE WHEN total > 0 THEN 18 ELSE 0 END)) AS BIGINT) AS risk_sum
    FROM (SELECT lang, {' + '.join(o.KINDS)} AS total, {o.exposure_sql('path')} AS exposure
          FROM documents JOIN pii_counts ON key = 'd' || doc_id JOIN inventory ON ordinal = doc_id)
    GROUP BY lang""", ("pii_counts", "inventory"))
def _(v: Views):
    docs = v.document_texts.select("lang", "text", file_path(c("doc_id")).alias("path"))
    rows = pii.with_pii(docs)
    exposure = paths.exposure_score(paths.path_exposure_items("path"))
    risk = F.least(F.lit(100), exposure + evidence.points(evidence.positive("pii.total_matches"), 18))
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(c("pii.total_matches") > 0).alias("with_personal_data"),
        F.sum("pii.total_matches").alias("matches"), F.sum(risk).alias("risk_sum"))


@query("audit_ranks_from_texts", """
    SELECT finding_id, CAST(pii_total AS BIGINT) AS personal, CAST(sec_total AS BIGINT) AS secrets, CAST(idt_total AS BIGINT) AS mentions,
           cfg_is AS configured, CAST(arc_sensitive AS BIGINT) AS archived, CAST(exif_fields AS BIGINT) AS disclosed, CAST(confirmed_categories AS BIGINT) AS confirmed_categories, CAST(evidence_count AS BIGINT) AS evidence_count,
           CAST(objective_risk AS BIGINT) AS objective_risk, CAST(privacy_rank AS BIGINT) AS privacy_rank, CAST(detection_rank AS BIGINT) AS detection_rank
    FROM text_ranked""", ("text_ranked",))
def _(v: Views):
    """The audit from end to end: detectors over the texts, their evidence merged into the findings, then the ranks."""
    rows = evidence.with_ranks(v.text_audited)
    return rows.select("finding_id", *(c(f).cast("long").alias(n) for f, n in (
        ("pii.total_matches", "personal"), ("secrets.total_matches", "secrets"), ("identity.total_mentions", "mentions"),
        ("archive.sensitive_entries_count", "archived"))), c("config.is_credential_config").alias("configured"),
        F.size("exif.disclosed_fields").cast("long").alias("disclosed"),
        *(c(n).cast("long").alias(n) for n in ("confirmed_categories", "evidence_count", "objective_risk", "privacy_rank", "detection_rank")))


@query("audit_report_from_texts", """
    SELECT finding_id, CAST(row_number() OVER (ORDER BY privacy_rank DESC, detection_rank DESC, ordinal) AS BIGINT) AS place FROM text_ranked
    WHERE NOT ignored QUALIFY place <= 100""", ("text_ranked",))
def _(v: Views):
    """The first hundred rows of the report that ranks by privacy."""
    rows = evidence.with_ranks(v.text_audited).filter("NOT ignored").select("finding_id", "privacy_rank", "detection_rank", "ordinal")
    placed = ordering.positions(rows, "finding_id", *ordering.report_order("Privacy"))
    return placed.filter("position < 100").select("finding_id", (c("position") + 1).alias("place"))
