"""Ranking, filters, joins, triage, stores and learning."""

import collections
import math
import random
import re
from datetime import datetime

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake import fixed
from tracelake.functions import paths, scalars
from tracelake.operators import aggregates, evidence, filters, history, joins, learning, ordering, provenance, similarity, triage
from tracelake.plans import packing
from tracelake.plans.views import AS_OF, Views
from tracelake.session import dealt
from tracelake.sources import inventory, scanners, store, text

c = F.col


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("path, kind", [("C:\\a\\p.JPG", "Images"), ("x/y.gguf", "AI / Models"), ("noext", "Other"), ("a.tar.gz", "Archives")])
def test_file_class(value, path, kind):
    assert value(paths.file_class(F.lit(path))) == kind


@pytest.mark.parametrize("size, shown", [(0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (1024**2, "1 MB"), (5 * 1024**4, "5 TB"), (2000 * 1024**4, "2000 TB")])
def test_human_bytes(value, size, shown):
    assert value(scalars.human_bytes(F.lit(size).cast("long"))) == shown


@pytest.mark.parametrize("path, directory, shape", [
    ("C:\\Users\\me\\x.txt", False, "USERPROFILE / directory / directory / file.txt"), ("\\\\srv\\share\\a\\b", False, "NETWORK_ROOT / directory / file"),
    ("C:/a/b/c/d/e/f/g/h.TXT", False, "USERPROFILE" + " / directory" * 6 + " / … / file.txt"), ("", False, "unknown"), ("C:\\a\\b", True, "USERPROFILE / directory / directory"),
    ("C:\\a\\x.имя", False, "USERPROFILE / directory / file[other]")])
def test_path_shape(value, path, directory, shape):
    assert value(paths.path_shape(F.lit(path), F.lit(directory))) == shape


@pytest.mark.parametrize("path, score", [("C:\\k\\a.kdbx", 45), ("\\\\srv\\client\\passport.env", 75), ("C:\\k\\a.txt", 0), ("C:\\Договор\\a.txt", 30)])
def test_historical_risk(value, path, score):
    assert value(paths.historical_risk(F.lit(path))) == score


@pytest.mark.parametrize("tile, rows", [(140.0, 240), (80.0, 600), (260.0, 72), (1000.0, 72), (float("nan"), 240)])
def test_tile_pages(value, tile, rows):
    assert value(scalars.tile_page_size(F.lit(tile))) == rows


@pytest.mark.parametrize("ms, offsets", [(1500, [750]), (4000, [1000, 3000]), (60000, [1000, 30000]), (0, [1000, 3000]), (None, [1000, 3000])])
def test_video_offsets(value, ms, offsets):
    assert value(scalars.sample_offsets_ms(F.lit(ms).cast("long"))) == offsets


def test_missing_dates_fail_every_age_step(spark):
    rows = spark.createDataFrame([(None, None), (None, datetime(2030, 1, 1))], "modified_at timestamp, created_at timestamp")
    assert [rows.filter(filters.age(s, AS_OF)).count() for s in (0, 1, 4)] == [2, 1, 0]


RANKED = "finding_id string, ordinal int, exposure_score int, personal_score float"


@pytest.mark.parametrize("exposure, personal, expected", [(50, 100.0, (50, 60, 55)), (50, 0.0, (50, 40, 45)), (50, None, (50, 50, 50))])
def test_rank_arithmetic(spark, exposure, personal, expected):
    rows = spark.createDataFrame([("a", 1, exposure, personal)], RANKED)
    for name, (_, kind) in evidence.JSON_KEYS.items():
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("people", F.lit(None).cast("struct<people_detected:boolean,face_count:int>")).withColumn("scan_status", F.lit(None).cast("map<string,boolean>"))
    found = evidence.with_ranks(rows).first()
    assert (found.objective_risk, found.combined_score, found.privacy_rank) == expected


@pytest.mark.parametrize("k", [3, 1500])
def test_top_rows_of_a_hot_group(spark, k):
    """A third of all rows share one key; the trimmed result equals the plain one."""
    rows = spark.range(9000).select(c("id"), F.when(c("id") % 3 == 0, F.lit(0)).otherwise(c("id") % 7).alias("g"), (F.xxhash64("id") % 50).alias("p"))
    order = [F.desc("p"), F.asc("id")]
    found = ordering.top_per_group(rows, ["g"], order, k, "n").select("g", "n", "id").collect()
    expected = []
    for g, part in rows.toPandas().groupby("g"):
        best = part.sort_values(["p", "id"], ascending=[False, True]).head(k)
        expected += [(g, i, x) for i, x in enumerate(best["id"], 1)]
    assert sorted(tuple(r) for r in found) == sorted(expected)


def test_positions_with_a_constant_leading_key(spark):
    rows = spark.range(5000).select(F.lit(1).alias("same"), c("id"))
    placed = ordering.with_positions(rows, F.asc("same"), F.desc("id"))
    assert placed.filter(c("position") != 4999 - c("id")).count() == 0 and placed.count() == 5000


def test_circular_pages(spark):
    rows = spark.range(25)
    for requested, small in ((0, 1), (-1, 1), (7, 50), (2, 3)):
        found, info = ordering.page(rows, [ordering.By("id")], requested, 10, "id", small)
        index = requested % 3
        assert info == {"page": index, "page_count": 3, "total": 25, "page_size": 10}
        assert sorted(r.id for r in found.collect()) == list(range(25))[index * 10:index * 10 + 10]


@pytest.mark.parametrize("small", [1, 40])
def test_first_rows_by_counting(spark, small):
    """Ties, nulls, extremes and strings in common: the same rows as a sort, and the cut holds few of them."""
    rng = random.Random(small)
    rows = [(rng.choice([None, 5, 5, 5, -(1 << 63), (1 << 63) - 1, rng.randrange(100)]), rng.choice([None, 0.5, -1e300, 1e300, rng.random()]),
             rng.choice([None, "", "same prefix a", "same prefix b", "é", "\U0001f600", str(rng.random())]), i) for i in range(700)]
    table = spark.createDataFrame(rows, "a long, b double, s string, id long").withColumn("t", F.timestamp_seconds(F.col("id") % 50)).repartition(4).cache()
    B = ordering.By
    orders = [[B("a"), B("id")], [B("a", True), B("b"), B("id", True)], [B("s"), B("id")], [B("s", True), B("b", True), B("id")], [B("t", True), B("id")]]
    for order in orders:
        want = [r.id for r in table.orderBy(*(by.sort() for by in order)).select("id").collect()]
        for k in (0, 1, 350, 699, 700, 900):
            assert sorted(r.id for r in ordering.first_rows(table, order, k, "id", small).select("id").collect()) == sorted(want[:k])
    table.unpersist()


def test_exclusions_have_no_separator_boundary(spark):
    files = spark.createDataFrame([("C:\\r\\Archive\\i.txt",), ("C:\\r\\archives.txt",), ("C:\\r\\other\\i.txt",), (None,), ("",)], "path string")
    banned = spark.createDataFrame([("c:\\R\\archive",), ("",), (None,)], "path string")
    for few in (0, 10):
        kept = [r.path for r in joins.not_excluded(files, banned, few).collect()]
        assert len(kept) == 3 and set(kept) == {"C:\\r\\other\\i.txt", None, ""}
    assert joins.not_excluded(files, banned.limit(0)).count() == 5


def test_installed_products(spark):
    names = spark.createDataFrame([("App1",), ("",), (None,), ("zzz",)], "application string")
    products = spark.createDataFrame([(2, "big APP1 suite", "p2", "e"), (1, "my app1", "p1", "e"), (3, "", "p3", "e"), (4, None, "p4", "e")],
                                     "position long, name string, publisher string, executable string")
    assert [(r.application, r.product.publisher) for r in provenance.installed_match(names, products).collect()] == [("App1", "p1")]


def test_a_late_manifest_counts(spark):
    """The manifest is the 41st name of its directory."""
    names = [f"a{i:02}.txt" for i in range(40)] + ["package.json"]
    files = spark.createDataFrame([(f"C:\\top\\app\\{n}",) for n in names], "path string")
    found = spark.createDataFrame([("C:\\top\\app\\data\\x.db",), ("D:\\else\\y.db",)], "path string")
    near = {r.path: r for r in provenance.with_neighbors(found, provenance.directory_listing(files)).collect()}
    assert len(near["C:\\top\\app\\data\\x.db"].directory_evidence) == 2 and not near["D:\\else\\y.db"].directory_evidence
    shown = provenance.with_neighbors(found, provenance.directory_listing(files, 40), 24).collect()
    assert sorted(len(r.neighbors) for r in shown) == [0, 24]


def test_inventory_findings(spark):
    rows = spark.createDataFrame([("C:\\u\\Desktop\\photo.jpg", 3), ("C:\\u\\.env", 1), ("C:\\u\\model.gguf", 1), ("C:\\u\\plain.xyz", 1), ("C:\\u\\huge.xyz", 1 << 30)], "path string, size_bytes long")
    found = {r.display_name: (r.category, r.subcategory, r.exposure_score) for r in inventory.file_findings(rows).collect()}
    assert found == {"photo.jpg": ("Images", "File", 60), ".env": ("Potential secrets", "Potential secret", 0), "model.gguf": ("AI / Models", "File", 0),
                     "huge.xyz": ("Other", "Large file", 0)}


def triage_rows(spark, rows):
    schema = "finding_id string, ordinal int, path string, size_bytes long, exposure_score int"
    frame = spark.createDataFrame([(f"f{i}", i, p, s, e) for i, (p, s, e) in enumerate(rows)], schema)
    return (frame.withColumn("display_name", paths.base_name("path")).withColumn("category", paths.file_class("path")).withColumn("ignored", F.lit(False))
            .withColumn("is_directory", F.lit(False)).withColumn("scan_status", F.lit(None).cast("map<string,boolean>")))


def test_a_run_with_failures_comes_to_its_end(spark):
    """Failing rows are completed and failed; a finding that is gone is completed; nothing stays pending."""
    findings = spark.createDataFrame([("a", "x@y.org"), ("b", "none"), ("c", "none")], "finding_id string, text string").withColumn(
        "scan_status", F.lit(None).cast("map<string,boolean>"))
    routes = spark.createDataFrame([("a", "seen"), ("b", "seen"), ("gone", "seen"), ("c", "broken"), ("a", "missing")], "finding_id string, scanner_id string")
    heard = []

    def fails(_rows):
        raise RuntimeError("always")

    registry = scanners.Registry([
        scanners.Detector("seen", lambda df: df.withColumn("hit", c("text").contains("@")), c("hit"), failed=c("finding_id") == "b"),
        scanners.Detector("broken", fails, F.lit(False))])
    rows, state = scanners.run_stages(spark, registry, routes, findings, on_error=lambda name, problem: heard.append((name, str(problem))))
    assert sorted(tuple(r) for r in state.collect()) == [
        ("a", "missing", "skipped"), ("a", "seen", "completed"), ("b", "seen", "completed"), ("b", "seen", "failed"),
        ("c", "broken", "skipped"), ("gone", "seen", "completed")]
    assert heard == [("broken", "always")] and {r.finding_id: r.hit for r in rows.collect()} == {"a": True, "b": False, "c": None}
    assert joins.pending_routes(routes, state).count() == 0
    assert aggregates.session_progress(routes, state).first()["progress"] == 1.0


def test_five_percent_and_cap(spark):
    rows = triage_rows(spark, [(f"C:\\d{i % 9}\\settings{i}.json", 100, 10) for i in range(200)])
    picks, routes, plan = triage.select(rows)
    assert plan["requested"] == 10 and picks.count() == 10
    assert routes.groupBy("finding_id").count().filter("count <> 4").count() == 0
    assert triage.select(rows, absolute_limit=7)[0].count() == 7


def test_images_reach_every_image_scanner(spark):
    rows = triage_rows(spark, [(f"C:\\p\\photo{i}.jpg", 100, 10) for i in range(50)])
    picks, routes, _ = triage.select(rows)
    assert picks.count() == 3 and {r.scanner_id for r in routes.collect()} == {"documents", "people", "image_safety", "exif"}


def test_demo_paths_rank_lower_but_stay(spark):
    rows = triage_rows(spark, [("C:\\a\\passport.txt", 100, 60), ("C:\\demo\\passport.txt", 100, 60)])
    found = {r.finding_id: r.priority for r in triage.routes(rows).filter("scanner_id = 'pii'").collect()}
    assert found["f0"] == 91 and found["f1"] == 73


def test_completed_scanners_are_not_routed(spark):
    rows = triage_rows(spark, [("C:\\a\\x.txt", 100, 0)]).withColumn("scan_status", F.create_map(F.lit("pii"), F.lit(True)))
    assert {r.scanner_id for r in triage.routes(rows).collect()} == {"secrets", "identity", "configs"}


def naive_turns(queues, limit, budget):
    queues, taken, spent = {k: list(v) for k, v in queues.items()}, [], 0
    while queues and len(taken) < limit:
        moved = False
        for name in sorted(queues):
            while queues[name]:
                finding, cost = queues[name].pop(0)
                if finding in [t[0] for t in taken] or spent + cost > budget:
                    continue
                taken.append((finding, name, len(taken) + 1))
                spent += cost
                moved = True
                break
            if not queues[name]:
                del queues[name]
            if len(taken) >= limit:
                break
        if not moved:
            break
    return taken


@pytest.mark.parametrize("turns", [1, 3, 1000])
def test_turns_equal_the_naive_loop(spark, turns):
    """In blocks of few turns and of all; queues with common runs, which others have taken when their turn comes."""
    rng = random.Random(turns)
    for same in (False, True, False):
        queues = {s: [(f"f{i}", 1) for i in (range(30) if same else rng.sample(range(40), rng.randint(1, 30)))] for s in "abcd"}
        if same:
            queues["z"] = [(f"f{i}", 1) for i in (*range(29), 77)]
        rows = [(s, p, f) for s, q in queues.items() for p, (f, _) in enumerate(q)]
        limit = rng.choice([rng.randint(1, 40), 1000])
        table = spark.createDataFrame(rows, "scanner_id string, position long, finding_id string")
        found = triage.take_turns(table, limit, turns).orderBy("pick").collect()
        assert [tuple(r) for r in found] == naive_turns(queues, limit, 10 ** 6)
    assert triage.take_turns(table.limit(0), 5).collect() == []


def test_similar_texts(spark):
    docs = spark.createDataFrame([
        (1, "spark cluster shuffle partition executor memory planning guide"), (2, "spark cluster shuffle partition executor memory tuning notes"),
        (3, "apple banana cherry dessert recipe with sugar"), (4, "the and of"), (5, "")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in similarity.similar_documents(similarity.TermIndex.of(docs), 1).collect()}
    assert set(found) == {2} and found[2] >= 0.5


def test_identical_and_scaled_images(spark):
    grid = [(i * 37) % 256 for i in range(64)]
    rows = spark.createDataFrame([(1, grid, grid + grid[:8]), (2, [v // 2 * 2 for v in grid], [v // 2 * 2 for v in grid + grid[:8]]), (3, [9] * 64, [9] * 72)],
                                 "vec_id long, a_grid array<int>, d_grid array<int>")
    hashes = rows.select("vec_id", similarity.difference_hash(c("d_grid")).alias("d_hash"), similarity.average_hash(c("a_grid")).alias("a_hash"))
    assert {r.vec_id: (r.d_hash, r.a_hash) for r in hashes.collect()}[3] == (0, -1)
    assert {r.vec_id: r.score for r in similarity.similar_images(hashes, 1).collect()}[2] >= 0.85


def test_history_priority(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "exists boolean, pinned boolean")
    assert [r.p for r in rows.select(history.priority().alias("p")).collect()] == [4, 3, 2, 1]


def test_orphan_weight_stays_outside_the_sum(views):
    rows = provenance.analyzed(views.provenance_input, views.inventory, views.installed, F.lit(AS_OF)).filter("possible_orphan").first()
    assert rows.evidence[-1].evidence_type == "POSSIBLE_ORPHAN"
    assert rows.confidence_score == min(100, sum(e.weight for e in rows.evidence[:-1]))


@pytest.mark.parametrize("positive, negative, ready", [(10, 9, False), (15, 5, True), (26, 4, False), (25, 5, False), (20, 10, True)])
def test_training_gate(spark, positive, negative, ready):
    rows = spark.createDataFrame([(True, 2)] * positive + [(False, 2)] * negative + [(True, 1)] * 40, "label boolean, schema_version int")
    assert aggregates.feedback_stats(rows).first()["can_train"] is ready


def feature_rows(spark, n):
    names = learning.NUMERIC + learning.BOOLEAN
    rows = [(i % 2 == 0, tuple([float(90 if i % 2 == 0 else 5) if x == "ExposureScore" else float(i % 3) for x in names] + ["x"] * len(learning.CATEGORICAL))) for i in range(n)]
    from pyspark.sql import types as T
    return spark.createDataFrame(rows, T.StructType([T.StructField("label", T.BooleanType()), T.StructField("features", learning.FEATURE_TYPE)]))


def test_model_learns_saves_and_loads(spark, tmp_path):
    rows = feature_rows(spark, 24)
    model, facts = learning.train(rows)
    assert facts["trained_samples"] == 24 and facts["validation_metrics"] is None
    scored = learning.with_personal_score(rows, model).collect()
    assert min(r.personal_score for r in scored if r.label) > max(r.personal_score for r in scored if not r.label)
    learning.save_model(spark, model, facts, str(tmp_path / "m"))
    loaded, metadata = learning.load_model(spark, str(tmp_path / "m"))
    assert metadata["positive_samples"] == 12 and learning.with_personal_score(rows, loaded).collect() == scored
    learning.save_model(spark, model, facts | {"feature_schema_version": 1}, str(tmp_path / "old"))
    assert learning.load_model(spark, str(tmp_path / "old")) is None and learning.load_model(spark, str(tmp_path / "none")) is None
    assert learning.with_personal_score(rows, None).first()["personal_score"] is None


def test_training_is_refused_below_the_gate(spark):
    with pytest.raises(ValueError):
        learning.train(feature_rows(spark, 19))


FEEDBACK = store.TABLES["feedback"]


def at(day):
    return datetime(2024, 1, day)


def test_feedback_created_time_restarts_after_a_clear(spark):
    changes = spark.createDataFrame([
        ("f", "a", True, at(1), 2, "{}"), ("f", "a", None, at(2), 2, "{}"), ("f", "a", False, at(3), 2, "{}"), ("f", "A", True, at(4), 2, "{}"),
        ("g", "b", True, at(1), 2, "{}"), ("g", "b", None, at(5), 2, "{}")],
        "finding_id string, path_key string, label boolean, updated_at timestamp, schema_version int, feature_json string")
    found = store.feedback_after(spark.createDataFrame([("h", "c", True, at(1), at(1), 2, "{}")], FEEDBACK), changes).collect()
    assert {(r.path_key, r.label, r.created_at, r.updated_at) for r in found} == {("A", True, at(3), at(4)), ("C", True, at(1), at(1))}


def test_tables_publish_whole_generations(spark, tmp_path):
    tables = store.Tables(spark, str(tmp_path))
    assert tables.read("exclusions").count() == 0
    tables.append("exclusions", spark.createDataFrame([("a",)], "path string"))
    tables.append("exclusions", spark.createDataFrame([("b",)], "path string"))
    tables.replace("exclusions", store.exclusions_after(tables.read("exclusions"), spark.createDataFrame([("b",), ("c",)], "path string")))
    assert sorted(r.path for r in tables.read("exclusions").collect()) == ["a", "b", "c"]
    tables.clear("exclusions")
    assert tables.read("exclusions").count() == 0


def test_snapshot_ceiling(spark, tmp_path, views):
    rows = views.findings.withColumn("last_access_at", F.lit(None).cast("timestamp")).withColumn("metadata", F.lit("{}"))
    with pytest.raises(ValueError):
        store.write_snapshot(rows, str(tmp_path / "s"), ceiling=3)


class Good:
    name = "good"

    def scan(self, spark, context):
        return spark.createDataFrame([("p",)], "path string")


class Bad:
    name = "bad"

    def scan(self, spark, context):
        raise RuntimeError("no access\nmore")


def test_one_failing_scanner_does_not_stop_the_others(spark):
    rows, runs = scanners.run_scanners(spark, [Bad(), Good()], {})
    assert rows.count() == 1 and {r.scanner_id: (r.findings, r.errors, r.message) for r in runs.collect()} == {"bad": (0, 1, "no access"), "good": (1, 0, "")}


def test_inventory_and_text_of_real_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "notes.txt").write_text("письмо late@example.org", encoding="utf-8")
    (tmp_path / "photo.jpg").write_bytes(b"\x00\x01")
    listed = inventory.listed_files(spark, [str(tmp_path)])
    assert sorted(r.size_bytes for r in listed.collect()) == [2, len("письмо late@example.org".encode())]
    assert "content" not in listed._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    files = inventory.file_contents(spark, [str(tmp_path)])
    assert [r.text for r in text.plain_files(files).collect()] == ["письмо late@example.org"]


def test_spreadsheet_and_slides(spark):
    import io
    import zipfile

    def zipped(members):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as out:
            for name, xml in members.items():
                out.writestr(name, xml)
        return buffer.getvalue()

    files = spark.createDataFrame([
        ("a.xlsx", zipped({"xl/worksheets/sheet1.xml": "<s><c><v>42</v></c><t>in</t></s>", "xl/sharedStrings.xml": "<s><t>one</t><t> </t></s>"})),
        ("b.pptx", zipped({"ppt/slides/slide1.xml": "<p><t>hello</t></p>", "ppt/other.xml": "<t>no</t>"})), ("c.docx", b"broken")], "path string, content binary")
    assert {r.path: r.text for r in text.office_text(text.office_members(files)).collect()} == {"a.xlsx": "one 42 in", "b.pptx": "hello"}


def test_stream_of_new_files(spark, tmp_path):
    from tracelake.streaming.incremental import audit_new_files

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "mail a@example.org"), (2, "nothing")], "doc_id long, text string")
    for part in (rows.filter("doc_id = 1"), rows.filter("doc_id = 2")):
        part.write.mode("append").parquet(source)
        audit_new_files(spark, source, "doc_id long, text string", target, str(tmp_path / "state")).awaitTermination()
    found = spark.read.parquet(target)
    assert {r.doc_id: r.pii.total_matches for r in found.collect()} == {1: 1, 2: 0}


def test_fixed_values_stay_small_tables():
    assert len(fixed.STOP_WORDS_EN) < 200 and len(fixed.STOP_WORDS_RU) < 200


def plain_similar(docs, query_id, floor=0.15, limit=50):
    """Cosines of one document with all others, from words to scores."""
    found = {k: [w for w in re.findall(r"[^\W]{2,40}", t.lower()) if w not in similarity.STOP_WORDS] for k, t in docs}
    found = {k: w for k, w in found.items() if w}
    df = collections.Counter(t for w in found.values() for t in set(w))
    vectors = {k: {t: (0.5 + 0.5 * n / len(w)) * (math.log((1 + len(found)) / (1 + df[t])) + 1) for t, n in collections.Counter(w).items()}
               for k, w in found.items()}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in vectors.items()}
    own = vectors.get(query_id, {})
    scores = {k: sum(x * own.get(t, 0) for t, x in v.items()) / (norm[k] * norm[query_id]) for k, v in vectors.items() if own and k != query_id}
    best = sorted((-round(min(1, s), 3), k) for k, s in scores.items() if s >= floor)
    return [(k, -s) for s, k in best[:limit]]


def zipf_texts(seed, many=400):
    rng = random.Random(seed)
    topics = [[f"t{k}x{i}" for i in range(12)] for k in range(10)]
    texts = []
    for k in range(many):
        common = [f"c{min(int(rng.paretovariate(0.6)), 3000)}" for _ in range(rng.randrange(5, 120))]
        texts.append(" ".join(common + [rng.choice(topics[k % 10]) for _ in range(rng.randrange(1, 25))]))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, limit", [(1, 50), (2, 5), (3, 1)])
def test_pruned_similarity_equals_all_cosines(spark, seed, limit):
    """Also with a document of common words only, an unknown one and after documents came in."""
    texts = zipf_texts(seed)
    texts.append((400, " ".join(f"c{i}" for i in range(1, 30))))
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = similarity.TermIndex.of(table(texts[:250])).added(table(texts[250:]))
    for query in (7, 399, 400, 999):
        got = [(r.doc_id, r.score) for r in similarity.similar_documents(index, query, limit=limit).collect()]
        assert got == plain_similar(texts, query, limit=limit)


def test_common_terms_read_a_fraction_of_the_postings():
    """A query of thirty common and three rare terms needs few of the bands, and only the heavy postings there."""
    common = [{"band": 15, "energy": 0.001, "most": 0.03 * 0.2, "sum": 0.03, "n": 40_000}] * 30
    bands = {"band": 15, "energy": 0.03, "most": sum(b["most"] for b in common), "sum": 0.9, "n": 1_200_000}
    rare = {"band": 3, "energy": 0.97, "most": 1.2, "sum": 1.7, "n": 30}
    plan = similarity.Pruning.of([bands, rare], 0.2)
    assert plan.bands == [3] and 0 < plan.least < 0.2 and plan.rest <= 0.2
    everything = similarity.Pruning.of([bands, rare], 0.0)
    assert everything.bands == [15, 3] and everything.least == 0


def test_walked_folders(spark, tmp_path):
    """Nested, empty and missing folders, links in a circle, and roots inside roots."""
    for name in ("a/b/c/x.txt", "a/y.bin", "z"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "empty").mkdir()
    (tmp_path / "a" / "again").symlink_to(tmp_path)
    rows = inventory.walked(spark, [f"{tmp_path}/", f"{tmp_path}/a", f"file://{tmp_path}/a/b", f"{tmp_path}-missing"]).collect()
    plain = [(r.path.removeprefix(f"{tmp_path}/"), r.is_directory) for r in rows if not r.path.startswith("file:") and r.error is None]
    assert sorted(plain) == [("a", True), ("a/b", True), ("a/b/c", True), ("a/b/c/x.txt", False), ("a/y.bin", False), ("empty", True), ("z", False)]
    assert {r.path.rpartition("/")[2]: r.size_bytes for r in rows if r.is_directory is False} == {"x.txt": 11, "y.bin": 7, "z": 1}
    assert [r.path for r in rows if r.error] == [f"{tmp_path}-missing"] and all(r.modified_at for r in rows if not r.error)


def test_listings_and_files_leave_tasks_in_pieces():
    """Archives that come together are listed together, and packed files leave in pieces instead of a whole batch."""
    texts = [f"line {i} " + "".join(chr(97 + (i * j * j) % 26) for j in range(2000)) for i in range(40)]
    names = ["path", "text", "author", "damage"]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (
        [f"a{i}.zip" for i in range(40)], texts, ["me"] * 40, ["", "vast"] * 20)], names)
    most, packing.OUT_BYTES = packing.OUT_BYTES, 20_000
    try:
        files = list(packing.packed([batch]))
    finally:
        packing.OUT_BYTES = most
    assert len(files) > 2 and sum(f.num_rows for f in files) == 40
    (listing,) = text.list_members([pa.Table.from_batches(files).combine_chunks().to_batches()[0]])
    assert listing.num_rows == 40 * 5 and listing.column("error").null_count == 200
    sizes = {(r["archive"], r["entry_name"]): r["size_bytes"] for r in listing.to_pylist()}
    assert sizes["a1.zip", "word/footnotes.xml"] > 2_000_000 and sizes["a39.zip", "README.md"] == len(texts[39])


def test_terms_are_counted_and_weighted_where_they_are(spark):
    """Counting moves nothing; with a bound on the common terms the counts of all others move and weigh the same."""
    rows = [(1, "beta alpha beta _x gamma"), (2, "alpha"), (3, ""), (4, None), (5, "delta alpha beta")]
    counts = similarity.term_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.total, r.term, r.n) for r in counts.collect()} == {
        (1, 5, "beta", 2), (1, 5, "alpha", 1), (1, 5, "_x", 1), (1, 5, "gamma", 1), (2, 1, "alpha", 1),
        (5, 3, "delta", 1), (5, 3, "alpha", 1), (5, 3, "beta", 1)}
    kept = similarity.stored(counts)
    terms = similarity.stored(similarity.document_frequency(kept))
    assert [similarity.common_from(terms, most) for most in (5, 2, 0)] == [1, 2, 4]
    weights = [sorted(map(tuple, similarity.weighted_in_place(kept, terms, F.lit(3), least).select("doc_id", "term", "n", "df", "w").collect()))
               for least in (1, 2, 4)]
    assert len(weights[0]) == 8 and weights[0] == weights[1] == weights[2]


def test_few_bytes_with_much_work_are_dealt_out(spark):
    """A table of narrow rows is one split; the texts made of them are searched by as many tasks as its rows need."""
    keys = spark.range(0, 25_000, 1, 1)
    assert dealt(keys, 1_000, "id").rdd.getNumPartitions() == 25
    assert dealt(keys, 1_000, "id").select(F.sum("id")).first()[0] == sum(range(25_000))


def test_entries_of_one_path_are_merged_before_they_meet_the_findings(spark, monkeypatch):
    """A path with most of the entries is a row per application by the time of the join, and no task merges more than its share."""
    entries = spark.range(4_000).select(
        c("id").alias("ordinal"), F.concat(F.lit("app"), c("id") % 2).alias("application_key"), F.timestamp_seconds(c("id") % 1_000).alias("last_interaction"),
        F.when(c("id") % 10 > 0, F.when(c("id") % 3 > 0, "C:\\Hot.KEY").otherwise("c:\\hot.key")).otherwise(F.concat(F.lit("C:\\p"), c("id"))).alias("target_path"),
        (c("id") % 7).cast("int").alias("interactions"), (c("id") == 11).alias("pinned"), F.lit(True).alias("exists"), F.lit(False).alias("is_directory"),
        c("id").alias("size_bytes"), F.lit(None).cast("timestamp").alias("target_modified_at"), F.lit("Automatic").alias("source_kind"))
    findings = spark.createDataFrame([("c:\\HOT.key", "f1", 50, 1), ("C:\\p20", "f2", 90, 2)], "path string, finding_id string, exposure_score int, ordinal long")
    merged = history.merged(entries, "application_key")
    assert merged.count() == 2 + 400
    rows = {(r.application_key, r.path_match): r for r in history.related(merged, findings).collect()}
    hot, lone = rows["app1", "c:\\hot.key"], rows["app0", "c:\\p0"]
    assert (hot.ordinal, hot.interactions, hot.pinned, hot.related_finding_id, hot.effective_risk) == (999, 6, True, "f1", "Medium")
    assert (rows["app0", "c:\\p20"].related_risk, lone.related_finding_id, lone.effective_risk) == ("Critical", None, "None")
    monkeypatch.setattr("tracelake.plans.views.ENTRIES_A_TASK", 500)
    assert Views(spark, "/root/testdata/sf0.001").dealt_entries.rdd.getNumPartitions() >= 2
    monkeypatch.setattr("tracelake.plans.views.ENTRIES_A_TASK", 50)
    assert Views(spark, "/root/testdata/sf0.001").dealt_entries.rdd.getNumPartitions() >= 20


def test_entries_of_few_paths_stay_where_they_are(spark):
    """Few paths hold all entries: neither join with many findings moves them. Where Spark has to move them, those without a finding spread."""
    findings = inventory.file_findings(spark.range(3_000).select(
        c("id").alias("ordinal"), F.concat(F.lit("f"), c("id")).alias("finding_id"), F.concat(F.lit("C:\\p"), c("id"), F.lit(".zip")).alias("path"),
        c("id").alias("size_bytes"), F.lit(AS_OF).alias("created_at"), F.lit(AS_OF).alias("modified_at"), F.lit("filesystem").alias("scanner_id"),
        F.lit(False).alias("ignored"), F.lit(False).alias("is_directory")))
    entries = spark.range(0, 4_000, 1, 4).select(
        c("id").alias("ordinal"), F.when(c("id") % 4 == 0, F.lit("c:\\P7.zip")).otherwise(F.lit("C:\\gone.txt")).alias("target_path"), F.lit(True).alias("exists"),
        F.lit(False).alias("is_directory"), c("id").alias("size_bytes"), F.lit(AS_OF).alias("target_modified_at"), F.lit(AS_OF).alias("last_interaction"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, setting in settings.items():
            spark.conf.set(name, setting)
        known = history.remembered(entries, findings)
        assert [r.finding_id for r in known.collect()] == ["f7"]
        rows = history.entry_findings(history.related(entries, known), known)
        assert rows.filter("path = 'C:\\\\p7.zip'").count() == 1_000 and rows.count() == 4_000
        rows.collect()
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        held = entries.select("*", F.when(c("ordinal") % 4 == 0, F.lit("f7")).alias("related_finding_id"), F.lit(0).alias("historical_score"))
        sizes = history.entry_findings(held, findings).groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 4_000 and max(r["count"] for r in sizes) < 2_500
    finally:
        for name, setting in before.items():
            spark.conf.set(name, setting)
