"""Operators without a fixed contract, the pipeline, and what is registered."""

import collections
import math
import re

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import difference
from tracelake.llm import cross_parse, license_scan, pfair_mix, weak_quality

FOLDER = "/root/testdata/sf0.001"


def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [(truth[r.doc_id], r.keep) for r in weak_quality.quality(docs).collect() if r.doc_id in truth]
    good, bad = [k for q, k in got if q], [k for q, k in got if not q]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_of_odd_rows(odd, none):
    got = weak_quality.quality(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert not any(r.keep for r in got if r.doc_id in (3, 4, 5, 12))
    kept = weak_quality.good_documents(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.keep}
    assert weak_quality.quality(none).collect() == []


def test_estimated_accuracies():
    """Labellers of known accuracy, drawn independently, get it back to within two hundredths."""
    rng = np.random.default_rng(4)
    right = np.array([0.95, 0.9, 0.85, 0.9, 0.8, 0.9, 0.95, 0.85, 0.9])
    bad = rng.random(60_000) < 0.3
    correct = rng.random((60_000, len(right))) < right
    votes = np.where(correct ^ bad[:, None], weak_quality.GOOD, weak_quality.BAD)
    votes[rng.random(votes.shape) < 0.2] = weak_quality.ABSTAIN
    patterns, counts = np.unique((votes * 3 ** np.arange(len(right))).sum(axis=1), return_counts=True)
    found = weak_quality.estimated(patterns, counts.astype(float))
    assert np.abs(np.array(list(found.accuracies().values())) - right).max() < 0.02 and abs(found.bad - 0.3) < 0.02


@pytest.mark.parametrize("table", ["odd", "documents", "none"])
def test_mixture(request, table):
    docs = request.getfixturevalue(table)
    rows = pfair_mix.mixed(docs, block=4).collect()
    assert len(rows) == docs.count()
    by = collections.defaultdict(list)
    for r in rows:
        assert r.mix_release <= r.mix_slot < r.mix_deadline and r.mix_block == r.mix_rank // 4
        assert r.mix_order == r.mix_slot * 2 + r.mix_rank % 2
        by[r.source].append((r.mix_rank, r.doc_id))
    for found in by.values():  # repeated ids carry the first of their places
        found.sort(key=lambda r: r[0])
        assert all(rank == k or found[k - 1] == (rank, doc) for k, (rank, doc) in enumerate(found))
    assert rows == [] or len({(r.source, r.doc_id) for r in rows}) == len({r.mix_order for r in rows})


WEIGHTS = [{"a": 1, "b": 1, "c": 1}, {"big": 1 / 3, **{f"s{i}": 2 / 3 / 40 for i in range(40)}}, {"a": 1e-6, "b": 1.0, "c": 0.3},
           {f"s{i}": (i + 1) ** 0.5 for i in range(25)}]


@pytest.mark.parametrize("length", [1, 7, 100, 1 << 16])
@pytest.mark.parametrize("weights", WEIGHTS)
def test_mixture_keeps_to_its_targets(weights, length):
    """No source is a block (two units) away from its exact target, however many segments pass."""
    shares = list(pfair_mix.whole(weights).values())
    total, slots = sum(shares), 20_000
    units = [slots * w // total + 2 for w in shares]
    placed, balanced, end = np.full((len(units), max(units)), -1), 0, 0
    for at, first, begin, counts in pfair_mix.segments(shares, units, length):
        assert at == end
        end += sum(counts)
        balanced += first * sum(counts)
        for i, unit, slot, release, due in pfair_mix.earliest(counts):
            assert release <= slot < due
            placed[i, begin[i] + unit] = at + slot
    assert end == sum(units) and balanced >= slots
    assert sorted(t for i, n in enumerate(units) for t in placed[i, :n].tolist()) == list(range(end))
    for i, w in enumerate(shares):
        had = np.cumsum(np.isin(np.arange(balanced), placed[i, : units[i]]))
        exact = np.array([w * (t + 1) / total for t in range(balanced)])
        assert np.abs(had - exact).max() < 2
        assert (np.diff(placed[i, : units[i]]) > 0).all()


def test_mixture_after_sources_run_out():
    """The others go on in proportion, whatever the segments' length."""
    shares, units = [4, 2, 1, 1], [10, 400, 100, 3]
    for length in (1, 5, 64, 1000):
        got, end, phase = np.zeros(4, int), 0, []
        for at, first, begin, counts in pfair_mix.segments(shares, units, length):
            assert at == end and begin == [b if c else g for b, c, g in zip(begin, counts, got.tolist())]
            got += counts
            end += sum(counts)
            phase.append((end, got.copy()))
        assert got.tolist() == units and end == sum(units)
        for end, now in phase:
            if end > 30 and now[1] < 400 and now[2] < 100:
                assert abs((now[1] - 5) - 2 * (now[2] - 2.5)) <= 6


def test_mixture_of_zero_weight_and_uneven_sources(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "CASE WHEN id < 300 THEN 'zero' WHEN id < 310 THEN 'few' ELSE 'much' END AS source")
    rows = sorted(pfair_mix.mixed(docs, {"zero": 0, "few": 1, "much": 3}, block=2, segment=16).collect(), key=lambda r: r.mix_order)
    assert len(rows) == len({r.mix_order for r in rows}) == 900
    assert all(r.source == "zero" for r in rows[600:]) and not any(r.source == "zero" for r in rows[:600])
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in rows)
    assert [r.source for r in rows[:40]].count("few") == 10 and rows[39].mix_balanced and not rows[599].mix_balanced


def test_mixture_by_segments_of_tasks(spark):
    """Segments that tasks schedule apart keep the same counts as one."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('s', cast(log2(id + 2) as int)) AS source", "id AS mix_rank")
    long_, short = (sorted(pfair_mix.mixed(docs, block=2, segment=n).collect(), key=lambda r: r.mix_order) for n in (1 << 16, 1))
    assert [r.mix_order for r in long_] == [r.mix_order for r in short] == list(range(6000))
    sizes = collections.Counter(r.source for r in long_)
    share = {s: n ** 0.5 / sum(n ** 0.5 for n in sizes.values()) for s, n in sizes.items()}
    for rows in (long_, short):
        had = collections.Counter()
        for t, r in enumerate(rows):
            if not r.mix_balanced:
                break
            had[r.source] += 1
            assert all(abs(had[s] - share[s] * (t + 1)) < 2 for s in share)


def plain_licenses(files):
    """Cosines of every line, paragraph and text, and inheritance by walking up."""
    def terms(text):
        return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    templates = [(n, collections.Counter(terms(t))) for n, t in license_scan.TEMPLATES]
    vocabulary = set().union(*(t for _, t in templates))
    having = collections.Counter(w for _, text in files for w in set(terms(text)) & vocabulary)
    idf = lambda w: math.log((len(files) + 1) / (having[w] + 1 if w in vocabulary else 1)) + 1
    norm = lambda v: math.sqrt(sum((n * idf(w)) ** 2 for w, n in v.items()))
    out, carriers = {}, {}
    for path, text in files:
        best = (0.0, None, 0.0)
        for part in [*(text or "").split("\n"), *re.split("\n(?=\n)", text or ""), text or ""]:
            v = collections.Counter(terms(part))
            for name, t in templates:
                if v and (c := sum(n * t[w] * idf(w) ** 2 for w, n in v.items()) / norm(v) / norm(t)) > best[0] + 1e-9:
                    best = (c, name, sum(v.values()) / len(terms(text)))
        name = best[1] if best[0] >= license_scan.SIMILAR else None
        out[path] = [name, "own" if name else None, None]
        if path is not None and name and (best[2] >= license_scan.MOSTLY or re.match(license_scan.LICENSE_NAMES, path.split("/")[-1])):
            where = path.rpartition("/")[0]
            carriers[where] = max(carriers.get(where, (0, "", "")), (round(best[0], 9), "", name))
    for path, found in out.items():
        where = None if path is None or found[0] else path.rpartition("/")[0]
        while where is not None:
            if where in carriers:
                out[path] = [carriers[where][2], "inherited", where]
                break
            where = where.rpartition("/")[0] if where else None
    return out


def test_licenses(spark, none):
    files = [("LICENSE", "All rights reserved."), ("a/COPYING.txt", "Notes here that are long enough to be most of it all\nReleased under the MIT License."),
             ("a/b/c/x.py", "print(1)"), ("a/b/y.py", "import os\nLicensed under the Apache License, Version 2.0.\n" + "code " * 20),
             ("d/notice-file", "Licensed under CC BY-NC 4.0."), ("d/z", None), ("d/e/q", ""), ("top.txt", "nothing of the kind, the of"),
             (None, "Released under the MIT License."), ("d/licensed.md", "This work is licensed under the GNU General Public License, version 2."),
             ("f/long", "word " * 30_000 + "\nAll rights reserved.\n" + "word " * 10)]
    rows = spark.createDataFrame([(p, t, "clash") for p, t in files], "path string, text string, license string").repartition(3)
    got = {r.path: [r.license, r.license_from, r.license_directory] for r in license_scan.licenses(rows).collect()}
    assert got == plain_licenses(files)
    assert got["a/b/c/x.py"] == ["MIT", "inherited", "a"] and got["top.txt"] == ["Proprietary", "inherited", ""]
    assert license_scan.licenses(none.selectExpr("source AS path", "text")).collect() == []


def test_licenses_of_headers_and_files(spark):
    """Wrapped comments, notices inside a line, and licence files, some with a longer text behind."""
    by = {}
    for name, text in license_scan.TEMPLATES:
        by[name] = max(by.get(name, ""), text, key=len)
    wrapped = lambda text: "".join(f" * {line}\n" for line in re.findall(r".{1,60}(?:\s|$)", text))
    code = "\n".join(f"value_{i} = compute(item{i}, {i})" for i in range(60))
    want = {}
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "Apache-2.0", "MPL-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"):
        want[f"{name}/x.c"] = (name, f"/* Copyright 2019 Some One. All rights reserved.\n{wrapped(by[name])} */\n{code}")
    start = next(t for n, t in license_scan.TEMPLATES if n == "GPL-3.0" and t.startswith("GNU GENERAL"))
    want["g/COPYING"] = ("GPL-3.0", wrapped(start) + "\n Preamble\n\n" + "The licenses for most software are designed to take away freedom. " * 80)
    want["g/y.c"] = ("GPL-3.0", code)
    want["l/z.txt"] = ("GPL-3.0", "These notes on rivers and stones were written last year. " * 3 + "This work is licensed under the GNU "
                       "General Public License, version 3. " + "More notes follow on houses. " * 4)
    want["n/plain.c"] = (None, code)
    rows = spark.createDataFrame([(p, t) for p, (_, t) in want.items()], "path string, text string").repartition(3)
    assert {r.path: r.license for r in license_scan.licenses(rows).collect()} == {p: n for p, (n, _) in want.items()}


def test_known_language_keeps_columns(odd):
    kept = cross_parse.in_known_language(odd)
    assert kept.columns == odd.columns
    assert not {3, 4, 5, 9, 12} & {r.doc_id for r in kept.collect()}


def test_pipeline_stages(spark, odd, none):
    for table in (odd, none):
        docs, count = table, table.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            rows = out.collect()
            assert len(rows) <= count
            if name == "tokens":
                assert all(r.lossless for r in rows)
            else:
                assert out.columns == table.columns
                docs, count = spark.createDataFrame(rows, table.schema), len(rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mixture", "tokens"]


def test_rows_of_the_pipeline_show_the_mixture(spark, odd):
    rows = corpus_pipeline.tokens(spark, odd, FOLDER).collect()
    order = lambda found: sorted((r.mix_order, r.doc_id or 0) for r in found)
    assert len(rows) == odd.count() and order(rows) == order(pfair_mix.mixed(odd).collect())


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)


def test_every_operator_is_registered():
    names = sorted(int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in entry.queries()) if m)
    assert names == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op")))
def test_registered(spark, name):
    problem, rows = difference(spark, FOLDER, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem == "" and rows > 0
