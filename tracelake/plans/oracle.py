"""The audit views restated in SQL for the side-by-side check, one common table expression per view."""

from __future__ import annotations

from tracelake import fixed
from tracelake.operators import config

DAY0 = "TIMESTAMP '2024-06-01'"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def pick(values, n: str) -> str:
    return f"{sql_list(values)}[(({n}) % {len(values)}) + 1]"


DIRECTORIES = ["Desktop", "Pictures", "Downloads", "Documents", "AppData\\Local\\Temp", "AppData\\Roaming", "Other"]
EXTENSIONS = ["txt", "docx", "json", "env", "jpg", "mp4", "zip", "pdf", "gguf", "py", "key"]
STEMS = ["passport_scan", "report", "config", "secrets", "screenshot", "demo_sample", "contract", "notes",
         "backup_db", "invoice", "photo", "token", "draft"]


def name_sql(n: str) -> str:
    stem, ext = pick(STEMS, n), pick(EXTENSIONS, n)
    return (f"(CASE WHEN {stem} IN ('config','secrets','token') THEN {stem} || '.' || {ext} "
            f"WHEN {stem} = 'draft' AND {ext} = 'env' THEN '.env' ELSE {stem} || '_' || ({n}) || '.' || {ext} END)")


def path_sql(n: str) -> str:
    name = name_sql(n)
    return (f"('C:\\Users\\user' || (({n}) % 5) || '\\' || {pick(DIRECTORIES, n)} || '\\' || "
            f"(CASE ({n}) % 20 WHEN 0 THEN 'node_modules' WHEN 1 THEN '.venv' "
            f"WHEN 2 THEN 'Packages\\Vendor.App' || (({n}) // 20 % 4) WHEN 3 THEN 'cache' ELSE 'proj' || (({n}) % 20) END) "
            f"|| '\\' || (CASE WHEN contains({name}, '_') THEN '' ELSE 'p' || ({n}) || '\\' END) || {name})")


def before(days: str) -> str:
    return f"({DAY0} - to_days(CAST({days} AS INTEGER)))"


def base_name(path: str) -> str:
    return f"regexp_extract({path}, '[^\\\\/]*$')"


def extension(path: str) -> str:
    return f"lower(regexp_extract({base_name(path)}, '\\.[^.]+$'))"


def class_sql(ext: str) -> str:
    whens = " ".join(f"WHEN {ext} IN {in_list(exts)} THEN '{name}'" for name, exts in fixed.FILE_CLASSES)
    return f"(CASE {whens} ELSE 'Other' END)"


def level_sql(score: str) -> str:
    return (f"(CASE WHEN {score} >= 80 THEN 'Critical' WHEN {score} >= 60 THEN 'High' WHEN {score} >= 30 THEN 'Medium' "
            f"WHEN {score} >= 1 THEN 'Low' ELSE 'None' END)")


def order_sql(level: str) -> str:
    return f"(list_position({sql_list(fixed.RISK_LEVELS)}, {level}) - 1)"


def exposure_sql(path: str) -> str:
    parts = " + ".join(f"(CASE WHEN contains(lower({path}), '{p.lower()}') THEN {s} ELSE 0 END)"
                       for p, s, _ in fixed.PATH_EXPOSURE)
    return f"least(100, {parts})"


def reasons_sql(path: str) -> str:
    parts = ", ".join(f"CASE WHEN contains(lower({path}), '{p.lower()}') THEN '{r}' END" for p, _, r in fixed.PATH_EXPOSURE)
    return f"concat_ws('; ', {parts})"


def bytes_sql(n: str) -> str:
    def show(power: int) -> str:
        return (f"regexp_replace(CAST(round(CAST({n} AS DOUBLE) / {1024 ** power}, 2) AS VARCHAR), '\\.0$', '') "
                f"|| ' {fixed.BYTE_UNITS[power]}'")

    whens = " ".join(f"WHEN {n} < {1024 ** (p + 1)} THEN {show(p)}" for p in range(4))
    return f"(CASE {whens} ELSE {show(4)} END)"


def words_sql(text: str) -> str:
    """Unicode words, since \\b and \\w only know ASCII here."""
    return f"regexp_extract_all({text}, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+')"


def even(x: str) -> str:
    return f"CAST(round_even(CAST({x} AS DOUBLE), 0) AS BIGINT)"


def positive_terms(items: list[str]) -> str:
    return " + ".join(f"(CASE WHEN {i} THEN 1 ELSE 0 END)" for i in items)


# Evidence flags over the flat columns of `audited`; a null is no evidence.
HITS = [
    "coalesce(pii_total > 0, false)", "coalesce(sec_total > 0, false)", "coalesce(cfg_is, false)",
    "coalesce(idt_total > 0, false)", "coalesce(arc_sensitive > 0, false)", "coalesce(doc_is, false)",
    "coalesce(ppl_seen, false)", "coalesce(saf_status = 'Completed' AND saf_class <> 'SFW', false)",
    "coalesce(exif_fields > 0, false)",
]
COUNTS = [
    "pii_total", "sec_total", "1", "greatest(1, idt_total)", "arc_sensitive",
    "CASE WHEN doc_is_id THEN 2 ELSE 1 END", "greatest(1, ppl_faces)", "1", "exif_fields",
]
EVIDENCE_COUNT = " + ".join(f"(CASE WHEN {h} THEN {n} ELSE 0 END)" for h, n in zip(HITS, COUNTS))
OBJECTIVE = ("greatest(0, least(100, exposure_score + " + " + ".join(
    f"(CASE WHEN {h} THEN {n} ELSE 0 END)" for h, n in zip(
        HITS[:7] + [HITS[8], "coalesce(exif_gps, false)"],
        ["18", "28", "22", "14", "24", "(CASE WHEN doc_is_id THEN 24 ELSE 15 END)", "10", "6", "16"])) + "))")
FLOOR = (f"(CASE WHEN {HITS[1]} THEN 90 WHEN {HITS[2]} THEN 85 WHEN coalesce(doc_is_id, false) THEN 80 "
         "WHEN coalesce(exif_gps, false) THEN 75 ELSE 0 END)")

CONTACT_SNILS = "lpad(CAST((n * 1000003 + 11223344595) % 100000000000 AS VARCHAR), 11, '0')"


def pad(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS VARCHAR), {width}, '0')"


def weighted(text: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"CAST(substr({text}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights) if w) + ")"


LUHN = ("list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i % 2 = 1 "
        "THEN CAST(substr(reverse(x), i, 1) AS INT) "
        "WHEN CAST(substr(reverse(x), i, 1) AS INT) > 4 THEN CAST(substr(reverse(x), i, 1) AS INT) * 2 - 9 "
        "ELSE CAST(substr(reverse(x), i, 1) AS INT) * 2 END)) % 10 = 0")
CARD = ("CASE WHEN len(x) = 15 THEN x[1:2] IN ('34', '37') WHEN x[1:1] = '4' THEN true "
        "WHEN len(x) = 16 AND (CAST(x[1:2] AS INT) BETWEEN 51 AND 55 OR CAST(x[1:4] AS INT) BETWEEN 2221 AND 2720 "
        "OR x[1:4] = '6011' OR x[1:2] IN ('65', '35') OR x[1:3] = '220') THEN true "
        "ELSE len(x) BETWEEN 16 AND 19 AND x[1:2] = '62' END")
INN = (f"CASE len(x) WHEN 10 THEN {weighted('x', fixed.INN_WEIGHTS_10)} % 11 % 10 = CAST(x[10:10] AS INT) "
       f"ELSE {weighted('x', fixed.INN_WEIGHTS_11)} % 11 % 10 = CAST(x[11:11] AS INT) "
       f"AND {weighted('x', fixed.INN_WEIGHTS_12)} % 11 % 10 = CAST(x[12:12] AS INT) END")
SNILS = (f"CAST(x[1:9] AS BIGINT) <= 1001998 OR CAST(x[10:11] AS INT) = "
         f"(CASE WHEN {weighted('x', list(range(9, 0, -1)))} < 100 THEN {weighted('x', list(range(9, 0, -1)))} "
         f"WHEN {weighted('x', list(range(9, 0, -1)))} % 101 = 100 THEN 0 "
         f"ELSE {weighted('x', list(range(9, 0, -1)))} % 101 END)")
PHONE = ("(?:^|[^0-9])((?:(?:\\+7|8)[ \\t\\-]?(?:\\([0-9]{3}\\)|[0-9]{3})[ \\t\\-]?[0-9]{3}[ \\t\\-]?[0-9]{2}[ \\t\\-]?[0-9]{2}"
         "|\\+[1-9][0-9]{0,2}[ \\t\\-]?\\(?[0-9]{2,4}\\)?[ \\t\\-]?[0-9]{3,4}[ \\t\\-]?[0-9]{2,4}))(?:[^0-9]|$)")
FIO = ("(?:^|[^\\p{L}\\p{N}_])([А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?\\s+[А-ЯЁ][а-яё]+\\s+[А-ЯЁ][а-яё]+"
       "(?:ович|евич|ич|овна|евна|ична|инична))(?:[^\\p{L}\\p{N}_]|$)")
KINDS = ["card", "inn", "snils", "passport", "email", "phone", "fio", "telegram", "ip", "mac", "address"]

CTES: dict[str, tuple[list[str], str]] = {
    "inventory": ([], f"""
        SELECT doc_id AS ordinal, 'f' || {pad('doc_id', 10)} AS finding_id, {path_sql('doc_id')} AS path,
               n_chars * (CASE WHEN doc_id % 10 = 9 THEN 1048576 ELSE 1024 END) AS size_bytes,
               CASE WHEN doc_id % 46 <> 0 THEN {before('doc_id + 30')} END AS created_at,
               CASE WHEN doc_id % 23 <> 0 THEN {before('doc_id')} END AS modified_at,
               CASE WHEN doc_id % 29 = 0 THEN 'search-index' ELSE 'filesystem' END AS scanner_id,
               doc_id % 17 = 0 AS ignored, doc_id % 41 = 0 AS is_directory
        FROM documents"""),
    "findings": (["inventory"], f"""
        SELECT *, CASE WHEN secret THEN 'Potential secrets' ELSE class END AS category,
               CASE WHEN secret THEN 'Potential secret' WHEN size_bytes >= 1073741824 THEN 'Large file' ELSE 'File' END AS subcategory
        FROM (SELECT *, {base_name('path')} AS display_name, {extension('path')} AS ext, {class_sql(extension('path'))} AS class,
                     ({extension('path')} IN {in_list(fixed.SECRET_EXTENSIONS)}
                      OR regexp_matches(lower({base_name('path')}), '^(\\.env|credentials\\.|secrets\\.|config\\.|auth\\.|token\\.)')) AS secret,
                     {exposure_sql('path')} AS exposure_score, {reasons_sql('path')} AS reasons
              FROM inventory)
        WHERE secret OR class <> 'Other' OR size_bytes >= 1073741824"""),
    "audited": (["findings"], """
        SELECT *, CASE WHEN media AND saf_status IS NOT NULL THEN
                 CASE WHEN nsfl >= nsfw AND nsfl >= 0.3 THEN 'NSFL' WHEN nsfw >= 0.3 THEN 'NSFW' ELSE 'SFW' END END AS saf_class,
               CASE WHEN ppl_status = 'Completed' THEN ordinal % 3 WHEN ppl_status = 'Error' THEN 0 END AS ppl_faces,
               CASE WHEN ppl_status IS NOT NULL THEN ppl_status = 'Completed' AND ordinal % 3 > 0 END AS ppl_seen
        FROM (SELECT *, category IN ('Images', 'Video') AS media,
               CASE WHEN ordinal % 3 = 0 THEN ordinal % 4 END AS pii_total,
               CASE WHEN ordinal % 5 = 0 THEN ordinal % 3 END AS sec_total,
               CASE WHEN ordinal % 5 = 0 THEN ordinal % 2 = 0 END AS sec_entropy,
               CASE WHEN ordinal % 7 = 0 THEN ordinal % 2 = 0 END AS cfg_is,
               CASE WHEN ordinal % 6 = 0 THEN ordinal % 4 END AS idt_total,
               CASE WHEN ext = '.zip' THEN ordinal % 3 END AS arc_sensitive,
               CASE WHEN ext = '.zip' THEN ['Safe', 'High', 'Critical'][ordinal % 3 + 1] END AS arc_score,
               CASE WHEN category = 'Images' THEN ordinal % 2 = 0 END AS doc_is,
               CASE WHEN category = 'Images' THEN ordinal % 4 = 0 END AS doc_is_id,
               CASE WHEN category = 'Images' THEN (65 + ordinal % 30) / 100.0 END AS doc_conf,
               CASE WHEN category IN ('Images', 'Video') THEN CASE WHEN ordinal % 5 <> 0 THEN 'Completed' ELSE 'Error' END END AS ppl_status,
               CASE WHEN category IN ('Images', 'Video') THEN CASE WHEN ordinal % 9 <> 0 THEN 'Completed' ELSE 'Error' END END AS saf_status,
               (ordinal % 37) / 100.0 AS nsfl, (ordinal % 100) / 100.0 AS nsfw,
               CASE WHEN category IN ('Images', 'Documents') THEN ordinal % 4 END AS exif_fields,
               CASE WHEN category IN ('Images', 'Documents') THEN ordinal % 8 = 1 END AS exif_gps,
               CASE WHEN category IN ('Images', 'Documents') AND ordinal % 3 = 1 THEN 'Model' || (ordinal % 5) END AS exif_model,
               CASE WHEN category IN ('Images', 'Documents') AND ordinal % 3 = 2 THEN 'SN' || ordinal END AS exif_serial,
               CASE WHEN ordinal % 4 = 3 THEN (ordinal * 37) % 101 END AS personal_score,
               ordinal % 3 = 0 AS done_pii, ordinal % 5 = 0 AS done_secrets, ordinal % 7 = 0 AS done_configs,
               ordinal % 6 = 0 AS done_identity, ext = '.zip' AS done_archives, category = 'Images' AS done_documents,
               category IN ('Images', 'Video') AND ordinal % 5 <> 0 AS done_people,
               category IN ('Images', 'Video') AND ordinal % 9 <> 0 AS done_image_safety,
               category IN ('Images', 'Documents') AND ordinal % 2 = 0 AS done_exif
              FROM findings)"""),
    "ranked": (["audited"], f"""
        SELECT *, CASE WHEN confirmed_categories > 0 THEN 2000000000 + evidence_count * 10000 + confirmed_categories * 100 + privacy_rank
                       WHEN has_completed_scan THEN 1000000000 + privacy_rank ELSE privacy_rank END AS detection_rank
        FROM (SELECT *, CAST(round((objective_risk + combined_score) / 2.0, 0) AS BIGINT) AS privacy_rank
        FROM (SELECT *, CASE WHEN personal_score IS NULL THEN objective_risk ELSE greatest({FLOOR}, least(100, greatest(0,
                       {even('objective_risk * CAST(0.8 AS DOUBLE) + personal_score * CAST(0.2 AS DOUBLE)')}))) END AS combined_score
        FROM (SELECT *, {OBJECTIVE} AS objective_risk, {positive_terms(HITS)} AS confirmed_categories,
                     {EVIDENCE_COUNT} AS evidence_count,
                     done_pii OR done_secrets OR done_configs OR done_identity OR done_archives OR done_documents
                     OR done_people OR done_image_safety OR done_exif AS has_completed_scan
              FROM audited)))"""),
    "feedback": ([], f"""
        SELECT 'f' || {pad('doc_id', 10)} AS finding_id, upper({path_sql('doc_id')}) AS path_key, quality = 1 AS label,
               {before('doc_id + 1')} AS created_at, {before('doc_id')} AS updated_at,
               CASE WHEN toxic = 1 THEN 1 ELSE 2 END AS schema_version
        FROM labels"""),
    "feedback_changes": ([], f"""
        SELECT 'f' || {pad('doc_id', 10)} AS finding_id, upper({path_sql('(doc_id % 50)')}) AS path_key,
               CASE WHEN doc_id % 5 <> 0 THEN quality = 1 END AS label, {before('doc_id * 2 + 1')} AS updated_at
        FROM labels
        UNION ALL
        SELECT 'f' || {pad('doc_id', 10)}, upper({path_sql('(doc_id % 50)')}),
               CASE WHEN doc_id % 7 <> 0 THEN toxic = 1 END, {before('doc_id * 2')}
        FROM labels"""),
    "keyed_events": ([], """
        SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events"""),
    "history_entries": (["keyed_events"], f"""
        SELECT *, coalesce(known, app_id) AS application_key, coalesce(known, '{fixed.UNKNOWN_APPLICATION}') AS application_name,
               coalesce(known, '{fixed.UNKNOWN_APPLICATION} · ' || app_id) AS shown_name,
               lower(target_path) AS path_match
        FROM (SELECT event_id AS ordinal, user_id, CASE WHEN user_id % 15 < 13 THEN {pick([i for i, _ in fixed.KNOWN_APPLICATIONS], 'user_id % 15')}
                     ELSE 'ffff00000000000' || (user_id % 15) END AS app_id,
               CASE WHEN user_id % 15 < 13 THEN {pick([a for _, a in fixed.KNOWN_APPLICATIONS], 'user_id % 15')} END AS known,
               CASE WHEN event_type = 'error' THEN '\\\\srv' || (k % 3) || '\\clients\\contract_' || k || '.key'
                    WHEN event_type = 'click' AND k % 2 = 0 THEN 'C:\\Users\\user1\\Medical\\tax_' || k || '.pdf'
                    ELSE {path_sql('k')} END AS target_path,
               ts AS last_interaction, CAST(floor(value) AS BIGINT) AS interactions, event_type = 'signup' AS pinned,
               event_type <> 'error' AS exists_now, event_type = 'view' AND k % 10 = 0 AS is_dir,
               CAST(floor(value * 1000) AS BIGINT) AS size_bytes,
               CASE WHEN k % 7 <> 0 THEN {before('k')} END AS target_modified_at,
               CASE WHEN user_id % 2 = 0 THEN 'Automatic' ELSE 'Custom' END AS source_kind
        FROM keyed_events)"""),
    "history": (["history_entries", "findings"], f"""
        SELECT *, CASE WHEN related_risk <> 'None' THEN related_risk ELSE {level_sql('historical_score')} END AS effective_risk
        FROM (SELECT e.*, b.finding_id AS related_finding_id,
               CASE WHEN b.finding_id IS NULL THEN 'None' ELSE {level_sql('b.exposure_score')} END AS related_risk,
               CASE WHEN b.finding_id IS NOT NULL THEN 0 ELSE least(75,
                 (CASE WHEN {extension('e.target_path')} IN {in_list(fixed.HISTORY_SENSITIVE_EXTENSIONS)} THEN 45 ELSE 0 END)
                 + (CASE WHEN regexp_matches(lower(e.target_path), '{"|".join(fixed.HISTORY_SENSITIVE_TOKENS)}') THEN 30 ELSE 0 END)
                 + (CASE WHEN starts_with(e.target_path, '\\\\') THEN 30 ELSE 0 END)) END AS historical_score
        FROM history_entries e LEFT JOIN (
            SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY exposure_score DESC, ordinal) = 1) b
          ON e.path_match = lower(b.path))"""),
    "merged_history": (["history"], """
        SELECT * REPLACE (m_interactions AS interactions, m_pinned AS pinned)
        FROM (SELECT *, max(interactions) OVER w AS m_interactions, bool_or(pinned) OVER w AS m_pinned,
                     row_number() OVER (PARTITION BY application_key, path_match ORDER BY last_interaction DESC, ordinal) AS latest
              FROM history WINDOW w AS (PARTITION BY application_key, path_match))
        WHERE latest = 1"""),
    "scans": ([], """
        SELECT CAST(o_orderkey AS VARCHAR) AS scan_id, o_orderdate AS started_at, o_orderdate AS finished_at FROM orders"""),
    "archive_entries": ([], """
        SELECT 'C:\\Archives\\' || replace(p_brand, '#', '_') || '.zip' AS archive, p_partkey AS position,
               ['docs/passport_scan_', 'secrets/passwords_', 'app', 'README_', 'dump/users_export_', 'fin/salary_', 'keys',
                'img/dinner_', 'folder'][p_partkey % 9 + 1] || p_partkey
               || ['.jpg', '.txt', '/.env', '.md', '.csv', '.xlsx', '/id_rsa', '.png', '/'][p_partkey % 9 + 1] AS entry_name,
               CAST(p_size * 100 AS BIGINT) AS size_bytes
        FROM part"""),
    "rated_entries": (["archive_entries"], """
        SELECT *, CASE p_kind WHEN 0 THEN 'ID / Passport Document Scan' WHEN 1 THEN 'Private Key / Password File'
                     WHEN 2 THEN 'Environment & Auth Secret' WHEN 4 THEN 'Database / User Data Export'
                     WHEN 5 THEN 'Financial / Personal Document' WHEN 6 THEN 'Private Key / Password File'
                     WHEN 7 THEN 'ID / Passport Document Scan' END AS rule_category,
               CASE p_kind WHEN 0 THEN 'Critical' WHEN 1 THEN 'Critical' WHEN 2 THEN 'High' WHEN 4 THEN 'High'
                     WHEN 5 THEN 'Medium' WHEN 6 THEN 'Critical' WHEN 7 THEN 'Critical' END AS rule_level
        FROM (SELECT *, position % 9 AS p_kind FROM archive_entries)"""),
    "image_statistics": ([], """
        SELECT vec_id, 'C:\\Photos\\' || ['scan_', 'holiday_', 'passport-', 'img_docs_', 'my.id.'][vec_id % 5 + 1] || vec_id || '.jpg' AS path,
               vec_id % 5 IN (0, 2, 4) AS has_word,
               [1414, 1000, 800, 1000][vec_id % 4 + 1] AS width, [1000, 1586, 800, 1420][vec_id % 4 + 1] AS height,
               (vec_id % 41) / 100.0 AS avg_saturation, (vec_id % 34) / 100.0 AS high_saturation_ratio,
               110 + vec_id % 150 AS mean_luminance, (vec_id % 43) / 100.0 AS dark_ratio, (20 + vec_id % 71) / 100.0 AS paper_ratio,
               vec_id % 9 AS text_bands, 20 + vec_id % 60 AS horizontal, vec_id % 53 AS vertical,
               vec_id % 3 = 0 AS face, CASE WHEN vec_id % 3 = 0 THEN vec_id % 4 ELSE 0 END AS faces
        FROM embeddings"""),
    "frames": ([], """
        SELECT vec_id // 3 AS video, vec_id % 3 AS frame, (vec_id * 7) % 100 / 100.0 AS nsfl, (vec_id * 13) % 100 / 100.0 AS nsfw,
               (vec_id * 29) % 100 / 100.0 AS sfw, label AS face_count, (vec_id * 17) % 100 / 100.0 AS confidence
        FROM embeddings"""),
    "media": ([], f"""
        SELECT vec_id AS media_id, 'C:\\Media\\m' || vec_id || '.jpg' AS path, vec_id * 100 AS file_size,
               {before('vec_id')} AS file_modified_at, 'v2' AS model_version FROM embeddings"""),
    "stored_results": ([], f"""
        SELECT 'c:\\media\\M' || vec_id || '.JPG' AS path, CASE WHEN vec_id % 5 = 0 THEN vec_id * 100 + 1 ELSE vec_id * 100 END AS file_size,
               {before('vec_id')} AS file_modified_at, CASE WHEN vec_id % 7 = 0 THEN 'v1' ELSE 'v2' END AS model_version,
               CASE WHEN vec_id % 11 = 0 THEN 'Error' ELSE 'Completed' END AS status,
               vec_id % 11 <> 0 AND label % 3 > 0 AS people_detected, CASE WHEN vec_id % 11 = 0 THEN 0 ELSE label % 3 END AS face_count
        FROM embeddings"""),
    "contacts": ([], f"""
        SELECT n, concat_ws(chr(10),
          'Клиент: ' || {pick(['Иванов', 'Петров', 'Сидоров', 'Смирнов', 'Кузнецов'], 'n')} || ' '
            || {pick(['Иван', 'Пётр', 'Алексей', 'Олег', 'Никита', 'Сергей', 'Андрей'], 'n')} || ' '
            || {pick(['Иванович', 'Петрович', 'Сергеевич', 'Андреевич', 'Олегович', 'Ильич'], 'n')}
            || ', тел. +7 (' || (900 + n % 100) || ') ' || {pad('n % 1000', 3)} || '-' || {pad('n % 97', 2)} || '-' || {pad('n % 89', 2)},
          'ИНН ' || {pad('(n * 7919 + 1000000007) % 10000000000', 10)} || ' / ' || {pad('(n * 104729 + 500100732259) % 1000000000000', 12)},
          'СНИЛС ' || substr({CONTACT_SNILS}, 1, 3) || '-' || substr({CONTACT_SNILS}, 4, 3) || '-' || substr({CONTACT_SNILS}, 7, 3)
            || ' ' || substr({CONTACT_SNILS}, 10, 2),
          'Паспорт ' || {pad('n % 100', 2)} || ' ' || {pad('n % 37', 2)} || ' ' || {pad('(n * 13) % 1000000', 6)},
          'Карта 4' || {pad('(n * 9973 + 539148803436467) % 1000000000000000', 15)},
          CASE WHEN n % 5 = 0 THEN 'Card: 5555 5555 5555 4444' ELSE 'Card: none' END,
          'Адрес: г. Москва, ул. Ленина, д. ' || (n % 200) || ', кв. ' || (n % 99),
          'link https://t.me/' || (CASE WHEN n % 10 = 0 THEN 'example_user' ELSE 'user_' || n END),
          'mac 00:1A:2B:3C:' || {pad('n % 100', 2)} || ':' || {pad('n % 90 + 10', 2)} || ' ip ' || (n % 256) || '.16.' || (n % 300) || '.10',
          'mail client' || n || '@mail.example.ru',
          CASE WHEN n % 20 = 0 THEN 'value = "ghp_' || md5(CAST(n AS VARCHAR)) || 'AbC9"'
               WHEN n % 30 = 1 THEN 'url postgres://app:pw' || n || '@db.example.com/x'
               WHEN n % 40 = 3 THEN '-----BEGIN RSA PRIVATE KEY-----'
               WHEN n % 7 = 2 THEN 'blob Zx9' || upper(substr(md5(CAST(n AS VARCHAR)), 1, 12)) || substr(md5(CAST(n AS VARCHAR)), 13, 16)
               ELSE 'the secret of this document is kept well' END) AS text
        FROM (SELECT c_custkey AS n FROM customer)"""),
    "texts": (["contacts"], """
        SELECT 'd' || doc_id AS key, text FROM documents UNION ALL SELECT 'c' || n, text FROM contacts
        UNION ALL SELECT 'p' || page_id, html FROM pages UNION ALL SELECT 't' || conv_id || '-' || turn, text FROM conversations"""),
    "pii_kinds": (["texts"], f"""
        SELECT key,
          list_transform(list_filter(list_concat(
              list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: len(x) BETWEEN 13 AND 19),
              list_transform(list_filter(list_transform(regexp_extract_all(text, '[0-9]+(?:[ -][0-9]+)*'),
                  lambda r: regexp_extract(r, '(?:^|[ -])([0-9]{{4}}(?:[ -][0-9]{{4}}){{3}})$', 1)), lambda r: r <> ''),
                  lambda r: regexp_replace(r, '[^0-9]', '', 'g'))),
              lambda x: ({CARD}) AND {LUHN}), lambda x: x[1:4] || ' **** **** ' || right(x, 4)) AS card,
          list_filter(list_filter({words_sql('text')}, lambda w: regexp_matches(w, '^([0-9]{{10}}|[0-9]{{12}})$')), lambda x: {INN}) AS inn,
          list_transform(list_filter(list_transform(
              regexp_extract_all(text, '\\b[0-9]{{3}}[-\\s]?[0-9]{{3}}[-\\s]?[0-9]{{3}}[-\\s]?[0-9]{{2}}\\b'),
              lambda r: regexp_replace(r, '[^0-9]', '', 'g')), lambda x: {SNILS}),
              lambda x: x[1:3] || '-' || x[4:6] || '-' || x[7:9] || ' ' || x[10:11]) AS snils,
          list_transform(list_filter(list_transform(
              regexp_extract_all(text, '\\b[0-9]{{2}}\\s?[0-9]{{2}}\\s?[0-9]{{6}}\\b'),
              lambda r: regexp_replace(r, '[^0-9]', '', 'g')), lambda x: x[1:2] <> '00'),
              lambda x: x[1:2] || ' ' || x[3:4] || ' ******') AS passport,
          regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}\\b') AS email,
          list_filter(regexp_extract_all(text, '{PHONE}', 1),
              lambda x: len(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15) AS phone,
          regexp_extract_all(text, '{FIO}', 1) AS fio,
          list_filter(regexp_extract_all(text, 'https?://(?:www\\.)?t\\.me/[a-zA-Z0-9_]+', 0, 'i'),
              lambda x: len(regexp_extract(x, '[^/]*$')) BETWEEN 5 AND 32 AND NOT contains(lower(x), 'example')) AS telegram,
          list_filter(regexp_extract_all(text, '\\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\\.){{3}}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\\b'),
              lambda x: len(list_filter(string_split(x, '.'), lambda o: len(o) >= 2)) >= 2
                        AND string_split(x, '.')[1] NOT IN ('0', '127') AND x <> '255.255.255.255') AS ip,
          regexp_extract_all(text, '\\b(?:[0-9A-Fa-f]{{2}}[:-]){{5}}(?:[0-9A-Fa-f]{{2}})\\b') AS mac,
          list_transform(regexp_extract_all(text, 'г\\.\\s+[А-ЯЁа-яё0-9\\s.,\\-/]{{4,40}}'), lambda x: regexp_replace(x, '\\s+$', '')) AS address
        FROM texts"""),
    "pii_counts": (["pii_kinds"], "SELECT key, " + ", ".join(f"len({k}) AS {k}" for k in KINDS) + " FROM pii_kinds"),
    "doc_terms": ([], f"""
        SELECT doc_id, term, count(*) AS n, any_value(total) AS total
        FROM (SELECT doc_id, unnest(w) AS term, len(w) AS total
              FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                      lambda x: len(x) <= 40 AND x NOT IN {in_list(dict.fromkeys(fixed.STOP_WORDS_RU + fixed.STOP_WORDS_EN))}) AS w
                    FROM documents))
        GROUP BY doc_id, term"""),
    "doc_weights": (["doc_terms"], """
        SELECT t.*, f.df, (0.5 + 0.5 * CAST(t.n AS DOUBLE) / t.total)
               * (ln((1 + (SELECT count(DISTINCT doc_id) FROM doc_terms)) / CAST(1 + f.df AS DOUBLE)) + 1) AS w
        FROM doc_terms t JOIN (SELECT term, count(*) AS df FROM doc_terms GROUP BY term) f USING (term)"""),
    "grids": ([], """
        SELECT vec_id, a_grid, list_concat(a_grid, a_grid[1:8]) AS d_grid, list_sum(a_grid) AS a_sum
        FROM (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1) * CAST(127.5 AS DOUBLE)) AS INT)) AS a_grid
              FROM embeddings)"""),
    "bits": (["grids"], """
        SELECT vec_id, list_transform(range(0, 64), lambda i: d_grid[i // 8 * 9 + i % 8 + 1] > d_grid[i // 8 * 9 + i % 8 + 2]) AS d_bits,
               list_transform(range(0, 64), lambda i: a_grid[i + 1] * 64 >= a_sum) AS a_bits
        FROM grids"""),
    "exclusions": ([], """
        SELECT CASE WHEN n_nationkey < 3 THEN 'c:\\USERS\\user' || n_nationkey || '\\desk' ELSE 'D:\\' || n_name END AS path FROM nation"""),
    "identity_terms": ([], f"""
        SELECT arg_min(term, position) AS term, arg_max(category, position) AS category, lower(term) AS word
        FROM (SELECT regexp_extract(text, '^\\s*(\\p{{L}}+)', 1) AS term, {pick(['Account', 'Host', 'Author'], 'item_id')} AS category,
                     item_id AS position FROM benchmark
              UNION ALL SELECT s_name, 'Supplier', s_suppkey + 1000000 FROM supplier)
        WHERE length(term) >= 3 AND lower(term) NOT IN {in_list(fixed.GENERIC_IDENTITY_TERMS)}
        GROUP BY lower(term)"""),
    "identity_counts": (["identity_terms", "inventory"], f"""
        SELECT d.doc_id, t.term, t.category, count(*) AS n
        FROM (SELECT doc_id, unnest({words_sql("lower(" + base_name('path') + " || chr(10) || text)")}) AS word
              FROM documents JOIN inventory ON ordinal = doc_id) d JOIN identity_terms t USING (word)
        GROUP BY d.doc_id, t.term, t.category"""),
    "config_files": ([], """
        SELECT c_custkey AS n, ['.env', '.npmrc', 'config.py', 'settings.xml', 'docker-compose.yml', 'office.ovpn'][c_custkey % 6 + 1] AS name,
               c_custkey * 1000 AS size_bytes,
               concat_ws(',', CASE WHEN c_custkey % 4 = 0 THEN 'DB_PASSWORD' END, CASE WHEN c_custkey % 3 = 0 THEN 'AuthToken' END) AS exposed
        FROM customer"""),
}


def named_parts(parts: list[str], name: str) -> str:
    return "(" + " OR ".join(f"contains({name}, '_{part}_')" for part in parts) + ")"


SNAKE = ("'_' || lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), "
         "'([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) || '_'")
ASSIGNED_LINE = config.ASSIGNMENT.replace("'", "''")
CTES["config_counts"] = ([], f"""
        SELECT doc_id, count(*) AS n FROM (
          SELECT *, {SNAKE} AS snake, regexp_replace(trim(value), '^["'']+|["'',;]+$', '', 'g') AS bare FROM (
            SELECT doc_id, unnest(regexp_extract_all(text, '{ASSIGNED_LINE}', 1)) AS name, unnest(regexp_extract_all(text, '{ASSIGNED_LINE}', 2)) AS value
            FROM documents))
        WHERE {named_parts(config.SENSITIVE_PARTS, 'snake')} AND NOT {named_parts(config.HARMLESS_PARTS, 'snake')}
          AND CASE WHEN regexp_matches(lower(value), '^{config.ENVIRONMENT_READ}') THEN regexp_extract(value, '{config.FALLBACK.replace("'", "''")}', 1) <> ''
                   ELSE NOT regexp_matches(bare, '^(?:\\$\\{{[A-Za-z0-9_]+\\}}|\\$[A-Z][A-Z0-9_]*|%[A-Za-z0-9_]+%|<[^>]*>)$')
                        AND lower(bare) NOT IN {in_list(config.PLACEHOLDERS)} AND NOT regexp_matches(lower(bare), '^(?:your[_-].*|x+|\\*+)$')
                        AND NOT (trim(value) = bare AND regexp_matches(bare, '^[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)+(?:\\(.*)?$')) END
        GROUP BY doc_id""")


# The audit with the evidence that detectors found in the texts; `secret_counts` is added where its patterns are.
# Every zip made of a text lists one sensitive entry, every Office file names its author and a date.
CTES["text_audited"] = (["audited", "pii_counts", "secret_counts", "identity_counts", "config_counts"], f"""
        SELECT a.* REPLACE (coalesce(p.n, 0) AS pii_total, coalesce(s.total_matches, 0) AS sec_total, coalesce(i.n, 0) AS idt_total,
                            g.n IS NOT NULL AS cfg_is, CASE WHEN ext = '.zip' THEN 1 END AS arc_sensitive, CASE WHEN ext = '.zip' THEN 'Critical' END AS arc_score,
                            CASE WHEN ext <> '.docx' THEN exif_fields WHEN coalesce(author, '') <> '' THEN 2 ELSE 1 END AS exif_fields,
                            exif_gps AND ext <> '.docx' AS exif_gps, ext = '.docx' OR done_exif AS done_exif,
                            true AS done_pii, true AS done_secrets, true AS done_identity, true AS done_configs)
        FROM audited a LEFT JOIN (SELECT key, {' + '.join(KINDS)} AS n FROM pii_counts) p ON p.key = 'd' || a.ordinal
        LEFT JOIN secret_counts s ON s.key = 'd' || a.ordinal LEFT JOIN config_counts g ON g.doc_id = a.ordinal
        LEFT JOIN (SELECT doc_id, trim(source, ' ') AS author FROM documents) d ON d.doc_id = a.ordinal
        LEFT JOIN (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM identity_counts GROUP BY doc_id) i ON i.doc_id = a.ordinal""")
CTES["text_ranked"] = (["text_audited"], CTES["ranked"][1].replace("FROM audited", "FROM text_audited"))


def cte_names(wanted: list[str]) -> list[str]:
    """Dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in wanted:
        visit(name)
    return order


def with_views(views: list[str], body: str) -> str:
    parts = ", ".join(f"{name} AS ({CTES[name][1]})" for name in cte_names(views))
    if not parts:
        return body
    return f"WITH {parts} SELECT * FROM ({body})" if body.lstrip().startswith("WITH") else f"WITH {parts} {body}"
