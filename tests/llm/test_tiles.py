"""Tiles of the near-duplicate join, and the counts behind the quality measures."""

import collections

import numpy as np
import pytest

from tracelake.llm import ngram_join, weak_quality


@pytest.mark.parametrize("held", [1 << 22, 8])
def test_tiles_of_the_same_sets_are_one(spark, monkeypatch, held):
    """Tiles that two sets or more share, those of the same sets once; with little held the pairs are the same."""
    monkeypatch.setattr(ngram_join, "HELD_KEYS", held)
    monkeypatch.setattr(ngram_join, "RANGE_KEYS", 100)
    rng = np.random.default_rng(3)
    names = rng.integers(-(1 << 63), 1 << 63, 120)
    rows = [(doc, doc % 30 - 15, [int(k) for k in rng.choice(names[(doc % 3) * 30: (doc % 3) * 30 + 60], rng.integers(1, 9), False)])
            for doc in range(30)]
    rows += [(100 + doc, s, k) for doc, s, k in rows[:10]]  # equal sets
    rows += [(doc, 500 + doc, [int(k) for k in rng.integers(-(1 << 63), 1 << 63, 4)] + [int(names[-1])]) for doc in range(300, 340)]
    rows += [(None, 900, rows[0][2]), (400, None, []), (401, 901, [7, 8, 9]), (402, 902, [9, 8, 7])]
    of = collections.defaultdict(set)
    for doc, s, keys in rows:
        if doc is not None and s is not None:
            for k in keys:
                of[k].add(s)
    want = {frozenset(x) for x in of.values() if len(x) > 1}
    found = spark.createDataFrame(rows, "doc_id long, set_id long, keys array<long>").repartition(5)
    got = collections.defaultdict(list)
    for r in ngram_join.shared_tiles(found, sum(len(r[2]) for r in rows)).collect():
        got[r.key].append(r.set_id)
    assert all(len(x) == len(set(x)) for x in got.values())
    pairs = lambda tiles: {(a, b) for x in tiles for a in x for b in x if a < b}
    assert pairs(got.values()) == pairs(want)
    if held > 8:
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert ngram_join.shared_tiles(found.where("false"), 0).collect() == []


def test_measures_count_bytes_of_texts_and_words():
    texts = ["", "  \n", "AB É c!! |#", "## #a | ||", "x é #é# É!", "a a a\nb"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    found = weak_quality.shapes(data, np.cumsum([0, *map(len, raw)]))
    assert found.words.tolist() == [len(t.split()) for t in texts]
    for share, flag in (("mark_words", lambda w: "!" in w), ("bare_words", lambda w: not w.strip("|#")),
                        ("symbol_words", lambda w: w.count("#") + w.count("|") > 1 and any(map(str.isalpha, w)))):
        want = [sum(map(flag, t.split())) / len(t.split()) if len(t.split()) > 2 else np.nan for t in texts]
        assert np.array_equal(found.measures[share], want, equal_nan=True)
