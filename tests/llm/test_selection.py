"""Resampling towards a target, fill-in-the-middle and near vectors against plain versions."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash

from conftest import prose
from tracelake.llm import cap_filters, fill_middle, importance_draw, maxent_lm, ngram_join

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_grams(text):
    w = WORD.findall((text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    return len(w), w + [a + b" " + b for a, b in zip(w, w[1:])]


def plain_draw(rows, target, share=25, least=20):
    def counts(texts):
        return collections.Counter(zlib.crc32(g) % 10_000 for t in texts for g in plain_grams(t)[1])

    t, s = counts(target), counts([x for _, x in rows])
    all_t, all_s = sum(t.values()), sum(s.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for doc, text in rows:
        n, grams = plain_grams(text)
        weight = sum(gain[zlib.crc32(g) % 10_000] for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[4] = k + 1
    return out


def ordered(rows):
    return sorted((tuple(-(1 << 60) if x is None else x for x in r) for r in rows))


@pytest.mark.parametrize("table", ["odd", "documents", "none"])
def test_importance_draw(spark, request, table):
    docs = request.getfixturevalue(table)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    target = [prose(5, 50), None, "", "Das Haus", "the the the été"]
    for texts in (target, []):
        given = spark.createDataFrame([(t, 1.0) for t in texts], "text string, score double")
        got = importance_draw.resampled(docs, given).select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()
        # rows alike in all columns may change places
        assert ordered(got) == ordered(plain_draw(rows, texts))


def test_importance_draw_counts_words_over_blocks(spark, monkeypatch):
    """A text far longer than a block, and words right at its edges."""
    monkeypatch.setattr(importance_draw, "BLOCK_WORDS", 7)
    texts = [" ".join(f"w{i % 5}" for i in range(n)) for n in (0, 1, 6, 7, 8, 13, 14, 15, 100)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    found = [[] for _ in texts]
    for joined, starts, ends, of in importance_draw.blocks(data, importance_draw.spans(data, offsets, importance_draw.GAP), 2):
        for a, b, k in zip(starts, ends, of):
            found[k].append(joined[a:b].tobytes())
    assert [sorted(f) for f in found] == [sorted(plain_grams(t)[1]) for t in texts]


def test_interned_ngrams_are_told_apart_by_bytes():
    rng = random.Random(1)
    spans = [bytes(rng.randrange(256) for _ in range(n)) for n in range(130)] * 2 + [b"ab", b"ab ", b"ab", b"a"]
    data = np.frombuffer(b"".join(spans) + bytes(8), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    starts = ends - [len(s) for s in spans]
    assert importance_draw.xxhash64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(s) for s in spans]
    assert importance_draw.crc32(data, starts, ends).tolist() == [zlib.crc32(s) for s in spans]
    for keys in (None, np.zeros(len(spans), np.uint64)):  # all keys collide
        table = importance_draw.Interned(data, starts, ends, keys=keys)
        slots = {s: {int(table.slot[i]) for i, x in enumerate(spans) if x == s} for s in spans}
        assert all(len(v) == 1 for v in slots.values()) and len(set.union(*slots.values())) == len(slots)
        assert {s: int(table.count[min(v)]) for s, v in slots.items()} == collections.Counter(spans)
        assert all(table.bucket[min(v)] == zlib.crc32(s) % 10_000 for s, v in slots.items())


def plain_middle(doc, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k: 8 * k + 8], 16) for k in range(4))
    n = len(text)
    low, high = sorted((a % (n + 1), b % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return doc, n, "plain", None, None, text
    p, m, s = text[:low], text[low:high], text[high:]
    spm = d % 100 < 20
    return doc, n, "spm" if spm else "psm", low, high - low, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("table", ["odd", "documents", "none", "marked"])
def test_fill_middle(spark, request, table):
    if table == "marked":
        rng = random.Random(2)
        docs = spark.createDataFrame([(k, "".join(rng.choice("<>PSMé漢\U0001f600\n ") for _ in range(rng.randrange(40)))) for k in range(500)],
                                     "doc_id long, text string")
    else:
        docs = request.getfixturevalue(table)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = fill_middle.transformed(docs).withColumn("restored", fill_middle.restored()).collect()
    want = [plain_middle(*r) for r in rows]
    assert ordered((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output.decode()) for r in got) == ordered(want)
    assert ordered((r.doc_id, r.restored) for r in got) == ordered((d, t or "") for d, t in rows)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert ordered((r.doc_id, r.output_sha256, r.restored_sha256) for r in fill_middle.digests(docs).collect()) == ordered(
        (w[0], digest(w[5]), digest(t or "")) for w, (_, t) in zip(want, rows))


@pytest.mark.parametrize("seed", range(4))
def test_cuts_between_units(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = ["".join(rng.choice("aé漢\U0001f600\n<") for _ in range(rng.choice([0, 0, 1, 2, 7, 8, 9, 30]))) for _ in range(rng.randrange(1, 9))]
        offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
        ends, before = fill_middle.unit_ends(np.frombuffer("".join(texts).encode(), np.uint8), offsets)
        first = fill_middle.units_before(ends, before, offsets)
        assert np.diff(first).tolist() == [len(t) for t in texts]
        for a, start, t in zip(first, offsets, texts):
            cuts = fill_middle.byte_after(ends, before, a + np.arange(1, len(t) + 1))
            assert cuts.tolist() == [start + len(t[: k + 1].encode()) for k in range(len(t))]


def plain_near(rows, cosine=0.95):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    sizes = collections.Counter(len(v) for i, v in rows if usable(i, v))
    usual = max(sizes, key=lambda n: (sizes[n], n), default=0)
    good = [k for k, (i, v) in enumerate(rows) if usable(i, v) and len(v) == usual]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    if good:
        x = np.array([rows[k][1] for k in good], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= cosine)):
            if a != b:
                links[good[a]] += 1
                root[find(good[a])] = find(good[b])
    least = {}
    for k in good:
        least[find(k)] = min(rows[k][0], least.get(find(k), rows[k][0]))
    alone = set(range(len(rows))) - set(good)
    out = [(i, links[k], i if k in alone else least[find(k)]) for k, (i, _) in enumerate(rows)]
    return ordered((*r, True if r[0] is None else r[0] == r[2]) for r in out)


def usable(i, v):
    return i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def near(spark, rows, kind="float", **more):
    docs = spark.createDataFrame([(i, v, "x", True) for i, v in rows], f"vec_id long, embedding array<{kind}>, kept string, home boolean")
    return ordered(tuple(r) for r in cap_filters.near_vectors(docs.repartition(3), **more).collect())


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    one, two = (rng.normal(size=8).astype(np.float32).tolist() for _ in range(2))
    rows = [(1, one), (2, [2 * x for x in one]), (2, one), (2, one), (3, None), (4, []), (5, [0.0] * 8), (6, [*one[:7], None]),
            (7, [*one[:7], float("nan")]), (8, [*one[:7], float("inf")]), (9, one[:5]), (None, one), (10, two), (11, [-x for x in one]),
            (12, [1e-30 * x for x in one]), (13, [1e30 * x for x in two]), (14, one[:5])]
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert near(spark, rows) == plain_near(rows)
    assert near(spark, []) == [] and near(spark, rows[4:7]) == plain_near(rows[4:7])
    wide = [(i, v and [x and x * 1e200 for x in v]) for i, v in rows if i != 9]
    assert near(spark, wide, "double") == plain_near([(i, v and [x and x / 1e200 for x in v]) for i, v in wide])


@pytest.mark.parametrize("size, many", [(1, 40), (2, 200), (3, 600), (10, 400)])
def test_few_dimensions_are_exact(spark, size, many):
    """The thresholds are lower bounds there: no link is lost, chains and all."""
    x = np.random.default_rng(size).normal(size=(many, size)).astype(np.float32).astype(float)
    rows = list(enumerate(x.tolist()))
    assert near(spark, rows) == plain_near(rows)


def test_groups_of_near_copies(spark, monkeypatch):
    """A large group of near copies, a large group of copies, both dealt into many blocks, chains, and vectors of their own."""
    monkeypatch.setattr(cap_filters, "HOME_ROWS", 16)
    monkeypatch.setattr(cap_filters, "OTHER_ROWS", 32)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=64)
    rows = [middle / np.linalg.norm(middle) + rng.normal(size=64) * 0.02 for _ in range(500)]
    rows += [rng.normal(size=64)] * 300
    step = rng.normal(size=(40, 64))
    rows += list(np.cumsum(step * 0.25, axis=0) + 3 * rng.normal(size=64))
    rows += list(rng.normal(size=(400, 64)))
    rows = [(i, np.float32(v).astype(float).tolist()) for i, v in enumerate(rows)]
    rng.shuffle(rows)
    rows = [(int(i), v) for i, v in rows]
    want = plain_near(rows)
    assert sum(r[1] for r in want) > 200_000 and near(spark, rows) == want


def test_recall_right_at_the_threshold(spark):
    """20,000 pairs of 64 dimensions a hair above 0.95: at most two of them missed; none a hair below links."""
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = []
    for cosine, many in ((0.95001, 20_000), (0.94999, 2_000)):
        a = unit(rng.normal(size=(many, 64)))
        w = rng.normal(size=(many, 64))
        w = unit(w - (w * a).sum(axis=1, keepdims=True) * a)
        rows += [a, cosine * a + math.sqrt(1 - cosine ** 2) * w]
    vectors = np.concatenate(rows).astype(np.float32)
    docs = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in cap_filters.near_vectors(docs).collect()}
    assert sum(got[k] == 0 for k in range(20_000)) <= 2 and all(got[k] == 0 for k in range(40_000, 44_000))


def test_first_of_groups_with_repeated_ids(spark):
    """Rows that repeat a doc_id are told apart by their texts: one row of each group stays, whole."""
    a, b = prose(11, 200), prose(12, 200)
    rows = [(1, a, "x"), (1, b, "y"), (2, a + " more", "z"), (3, b + " more", "z"), (1, a, "w"), (4, "", "p"), (4, "", "q"), (4, None, "r"),
            (5, prose(13, 90), "s"), (5, prose(13, 90), "s"), (None, a, "t"), (None, a, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set string").repartition(3)
    kept = [tuple(r) for r in ngram_join.first_of_groups(docs).collect()]
    texts = collections.Counter((d, t or "") for d, t, _ in kept)
    assert texts == {(1, a): 1, (1, b): 1, (4, ""): 1, (5, rows[8][1]): 1, (None, a): 2} and all(k in rows for k in kept)


def plain_log10(model, counts, text):
    """log10 probability of a text, token by token, from the model's tables."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    hashed, tail, _, _ = maxent_lm.tokens(raw, np.array([0, len(raw)]))
    place = model.near(hashed).tolist()
    classes = [int(model.classes[p]) if p >= 0 else int(t) for p, t in zip(place, tail)]
    at = lambda values, k, fill: values[k] if k >= 0 else fill
    number = lambda x: int(maxent_lm.bucket(np.array([x % (1 << 64)], np.uint64))[0])
    seeds, total = [int(s) for s in maxent_lm.SEEDS], 0.0
    for i, h in enumerate(hashed.tolist()):
        one, two = (int(at(hashed, i - k, maxent_lm.START)) for k in (1, 2))
        before, third, fourth = (at(classes, i - k, maxent_lm.UNKNOWN) for k in (1, 3, 4))
        keys = [one + seeds[0], one * 0x9E3779B1 + two + seeds[1], two + seeds[2], third + seeds[3], fourth + seeds[4]]
        logits = [float(model.bias[c]) + sum(float(model.weights[c, number(k)]) for k in keys) for c in range(maxent_lm.CLASSES)]
        whole = math.log(sum(math.exp(x) for x in logits))
        own = classes[i]
        if place[i] >= 0:
            a, b = model.cuts[own], model.cuts[own + 1]
            inner = [float(model.word_bias[k]) + float(model.word_weights[before, k]) for k in range(a, b)]
            word = float(model.word_bias[model.place[place[i]]]) + float(model.word_weights[before, model.place[place[i]]])
            total += logits[own] - whole + word - math.log(sum(math.exp(x) for x in inner))
        elif h in counts:
            total += logits[own] - whole + math.log((counts[h] + 0.5) / max(float(model.tail_mass[own]), 0.5))
        else:
            total += logits[maxent_lm.UNKNOWN] - whole
    return total / math.log(10)


@pytest.mark.parametrize("head", [1 << 19, 12])
def test_model_scores_token_by_token(spark, odd, monkeypatch, head):
    """Also with most words' counts met in a join (a small head)."""
    monkeypatch.setattr(maxent_lm, "HEAD", head)
    monkeypatch.setattr(maxent_lm, "WORDS", 10)
    rows = [(k, prose(k, 70), False) for k in range(30)]
    train = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    counts = maxent_lm.count_words(train).cache()
    model = maxent_lm.trained(train, maxent_lm.start_model(train, counts))
    known = {r.word % (1 << 64): r.c for r in counts.collect()}
    texts = [prose(3, 70), prose(99, 40), "never seen words The house river, 7", "", None, "the the the", "Ünïcödé ñandú of"]
    docs = spark.createDataFrame([(k, t, True) for k, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r.head_score + r.rest_score for r in maxent_lm.scored(docs, model, counts).collect()}
    for k, text in enumerate(texts):
        assert got[k] == pytest.approx(plain_log10(model, known, text), rel=1e-4, abs=1e-3)


def test_class_probabilities_of_a_long_text():
    """They are worked out some tokens at a time; those of all tokens would take 77 MB here."""
    rng, n = np.random.default_rng(5), 300_000
    weights = rng.normal(size=(maxent_lm.CLASSES, 1 << maxent_lm.BUCKET_BITS)).astype(np.float32)
    none = np.zeros(0)
    model = maxent_lm.Model(none, None, none, 0, 0, none, none, none, none, rng.normal(size=maxent_lm.CLASSES).astype(np.float32), weights,
                            none, none, none)
    buckets = [rng.integers(0, weights.shape[1], n) for _ in range(3)]
    far, classes = rng.integers(0, maxent_lm.CLASSES ** 2, n), rng.integers(0, maxent_lm.CLASSES, n)
    tables, sums = maxent_lm.class_tables(model), np.zeros(maxent_lm.CLASSES)
    tracemalloc.start()
    for _, p in maxent_lm.class_shares(tables, buckets, far):
        sums += p.sum(axis=1)
    own, unknown = maxent_lm.class_logs(tables, buckets, far, classes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20
    logits = maxent_lm.class_logits(model, buckets, far).astype(np.float64)
    logits -= np.log(np.exp(logits).sum(axis=0))
    assert sums == pytest.approx(np.exp(logits).sum(axis=1), rel=1e-5)
    assert own == pytest.approx(logits[classes, np.arange(n)], abs=1e-5) and unknown == pytest.approx(logits[maxent_lm.UNKNOWN], abs=1e-5)
