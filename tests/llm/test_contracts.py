"""Operators with a fixed contract against plain versions of it."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import byte_bpe, cross_parse, maxent_lm, mpeg_audio, ngram_join, nn_descent, url_digests
from tracelake.llm.tables import stored_counting

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words(text):
    return (text or "").encode().lower().split()


def held(doc_id, of, is_):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % of == is_


def plain_groups(rows, size, part):
    """(n, smallest doc_id reachable) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= part * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted((-1 if d is None else d, len(s), -1 if d is None else least[root(i)])
                  for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("size, part", [(3, 90), (5, 80)])
@pytest.mark.parametrize("table", ["odd", "documents", "none", "close"])
def test_ngram_join(spark, request, table, size, part):
    if table == "close":
        docs = spark.createDataFrame(close_texts(), "doc_id long, text string").repartition(4)
    else:
        docs = request.getfixturevalue(table)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = ngram_join.jaccard_groups(docs, size, part).collect()
    nulls = lambda x: -1 if x is None else x
    assert sorted((nulls(r.doc_id), r.n_shingles, nulls(r.component_id)) for r in got) == plain_groups(rows, size, part)


def close_texts():
    """Chains and groups of texts right at the threshold, of few and many words."""
    rng = np.random.default_rng(3)
    out = []
    for n in (3, 9, 10, 11, 12, 20, 21, 39, 60, 200):
        base = [f"w{x}" for x in rng.integers(0, 10_000, n)]
        for _ in range(14):
            copy = list(base)
            for at in rng.integers(0, n, rng.integers(0, 4)):
                copy[at] = f"v{rng.integers(0, 50)}"
            if rng.random() < 0.3:
                copy += [f"t{rng.integers(0, 9)}"]
            out.append(" ".join(copy))
            if rng.random() < 0.5:
                base = copy
    return [(i, t) for i, t in enumerate(out)]


def test_one_document_of_each_group_stays(odd):
    kept = ngram_join.first_of_groups(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert [i for null, i in ids if not null] == [1, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15] and ids[-1][0]


def test_near_duplicate_stage_at_its_threshold(spark):
    """The pipeline's stage keeps the first of each group linked by five words at 0.8, as all pairs compared tell."""
    rng = np.random.default_rng(9)
    texts = []
    for share in (0, 5, 11, 15, 20, 24, 26, 40):  # so many words in a hundred are appended, or put in
        base = [f"w{x}" for x in rng.integers(0, 10_000, 204)]
        more = [f"m{x}" for x in rng.integers(0, 10_000, 2 * share)]
        texts += [base, base + more, base[:90] + more + base[90:]]
    for apart in (30, 44, 46, 50, 56, 60, 90):  # single words replaced at this distance
        base = [f"e{x}" for x in rng.integers(0, 10_000, 1000)]
        texts += [base, [f"x{i}" if i % apart == apart // 2 else w for i, w in enumerate(base)]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in close_texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = [doc for doc, _, least in plain_groups(rows, 5, 80) if doc == least]
    assert want != [doc for doc, _, least in plain_groups(rows, 3, 90) if doc == least]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


@pytest.mark.parametrize("table", ["odd", "documents", "none"])
def test_language_model(request, table):
    docs = request.getfixturevalue(table)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    counts = collections.Counter()
    for doc, text in rows:
        if not held(doc, 5, 1):
            counts.update([*words(text), None])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for doc, text in rows:
        tokens = [*words(text), None]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in tokens)
        want.append((-1 if doc is None else doc, held(doc, 5, 1), len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 6)))
    got = maxent_lm.lm_scores(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                  for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    if table == "documents":
        out = [r for r in got if r.held_out]
        assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_is_a_distribution(documents):
    """The probabilities of all outcomes after some histories sum to one."""
    train = documents.select("doc_id", "text")
    counts = maxent_lm.count_words(train)
    model = maxent_lm.trained(train, maxent_lm.start_model(train, counts), 1)
    table, tail = counts.collect(), model.tail_mass
    word = np.array([r.word for r in table], np.int64).view(np.uint64)
    c = np.array([r.c for r in table])
    place = model.near(word)
    own = (place >= 0) & (place < len(model.classes))
    inner = maxent_lm.word_table(model)
    for history in ([], [5], [7, 9, 11, 13]):
        hashed = np.array([*history, 99], np.uint64)
        classes = np.array([(k * 7) % maxent_lm.CLASSES for k in range(len(hashed))])
        buckets, far, before = maxent_lm.features(hashed, classes, np.array([0, len(hashed)]))
        logits = maxent_lm.class_logits(model, buckets, far)[:, -1].astype(float)
        p = np.exp(logits - logits.max())
        p /= p.sum()
        frequent = (p[model.classes[place[own]]] * np.exp(inner[before[-1], model.place[place[own]]])).sum()
        other = np.array([r.tail for r in table])[~own]
        rare = (p[other] * (c[~own] + 0.5) / tail[other]).sum()
        empty = p[[k for k in range(maxent_lm.CLASSES) if tail[k] <= 0]].sum()
        assert abs(frequent + rare + empty + p[maxent_lm.UNKNOWN] - 1) < 1e-4


@pytest.mark.parametrize("table", ["odd", "documents", "none"])
def test_languages(request, table):
    docs = request.getfixturevalue(table)
    rows = {r.doc_id: r for r in docs.collect()}
    got = cross_parse.languages(docs).collect()
    assert len(got) == docs.count()
    learnt = {r.lang for r in rows.values() if r.lang and r.doc_id is not None and r.text and any(map(str.isalpha, r.text))
              and not held(r.doc_id, 3, 1)}
    for r in got:
        assert r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1
        letters = any(map(str.isalpha, rows[r.doc_id].text or ""))
        assert (r.lang_pred in learnt) if letters and learnt else (r.lang_pred == "und" and r.score == 0)
    if table == "documents":
        out = [r for r in got if r.held_out]
        assert sum(r.lang_pred == rows[r.doc_id].lang for r in out) >= 0.95 * len(out)


def test_cross_parsing_against_plain_parse():
    samples = {"x": b"the cat sat on the mat ", "y": b"das haus und der hund "}
    parser = cross_parse.Parser.of(samples)

    def phrases(text, sample):
        n = at = 0
        while at < len(text):
            end = at
            while end < len(text) and text[at: end + 1] in sample:
                end += 1
            n, at = n + 1, max(end, at + 1)
        return n

    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(np.frombuffer(b"abcdehnstu q", np.uint8), rng.integers(0, 200))) for _ in range(40)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    got = parser.phrases(data, offsets)
    assert got.tolist() == [[phrases(t, samples[k]) for t in texts] for k in parser.languages]


def test_word_spans_match_the_pattern():
    import regex

    pattern, rng = regex.compile(public_tokenizers.PATTERN), np.random.default_rng(5)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "B", "é", "1", "½", "!", "漢", "😀", "\x85", "'S"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(3000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    starts, ends, first = byte_bpe.word_spans(data, offsets)
    raw = data.tobytes()
    for i, text in enumerate(texts):
        assert [raw[a:b].decode() for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]])] == pattern.findall(text)


@pytest.mark.parametrize("table", ["odd", "documents", "none"])
def test_byte_bpe(request, table):
    docs = request.getfixturevalue(table)
    ranks = byte_bpe.Ranks(RANKS).of
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((-1 if r.doc_id is None else r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest(), True))
    got = byte_bpe.encoded_texts(docs, RANKS).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == sorted(want)


@pytest.mark.parametrize("rows", [40, 0])
def test_turns_without_links_take_no_queries(spark, rows, monkeypatch):
    """The driver keeps the plan, stages and metrics of each query: what can't change anything is not asked."""
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(30))) for k in range(rows)], "doc_id long, text string")
    writer, written = type(docs.write), []
    monkeypatch.setattr(writer, "parquet", lambda self, path, put=writer.parquet: written.append(path) or put(self, path))
    assert [tuple(r) for r in ngram_join.jaccard_groups(docs).select("doc_id", "component_id").orderBy("doc_id").collect()] == [(k, k) for k in range(rows)]
    assert len(written) <= 12


def test_rows_are_counted_while_they_are_stored(spark):
    table, n = stored_counting(spark.range(10), F.col("id") > 6)
    assert (table.count(), n) == (10, 3)
    assert stored_counting(spark.range(10))[1] == 10
    assert stored_counting(spark.range(10).where("id < 0"))[1] == 0
    assert stored_counting(spark.range(10).where("false"))[1] == 0


def test_fold_equals_the_library(spark):
    ranks = byte_bpe.Ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.of, special_tokens={})
    texts = [" house", "Unbelievably", "ñandú", "=====", "a", " thorinouble", "12345", "漢字"]
    rows = spark.createDataFrame([(t, t.encode().decode("latin-1")) for t in texts], "text string, word string")
    ids = byte_bpe.folded(rows.word, ranks.rank_map())
    found = rows.select("text", ids.alias("ids"))
    for r in found.select("*", byte_bpe.unfolded(found.ids, ranks.piece_table()).alias("back")).collect():
        assert r.ids == library.encode_ordinary(r.text) and bytes(r.back) == r.text.encode()
    long_word = b"abcab" * 3000
    assert ranks.merged_alone(long_word) == library.encode_ordinary(long_word.decode())


def test_ranks_stay_out_of_plans(spark, odd, monkeypatch):
    """As literals the ranks would be printed with every state of a plan and kept by the driver."""
    sizes, keep, most = [], byte_bpe.stored, spark.conf.get("spark.sql.maxPlanStringLength")
    monkeypatch.setattr(byte_bpe, "stored", lambda df, *by: sizes.append(len(df._jdf.queryExecution().analyzed().toString())) or keep(df, *by))
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 24))
    try:
        assert byte_bpe.encoded_texts(odd, RANKS).count() == odd.count()
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", most)
    assert sizes and max(sizes) < 100_000


@pytest.mark.parametrize("table", ["odd", "none"])
def test_audio_round_trip(request, table):
    docs = request.getfixturevalue(table)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = mpeg_audio.stored_texts(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        text = texts[r.doc_id]
        payload = text + bytes(-len(text) % 64 if text else 64)
        media = mpeg_audio.written(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (
            len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media),
            hashlib.sha256(media).hexdigest())


def test_audio_damage(spark):
    whole = mpeg_audio.written(bytes(range(1, 250)) * 100)
    stream = mpeg_audio.parsed(whole)
    assert mpeg_audio.payload_of(whole, stream) == bytes(range(1, 250)) * 100
    assert stream.seconds == len(stream.offsets) * 1152 / 32000 and stream.table["frames"] == len(stream.offsets)
    assert all(whole[a: a + 2] == b"\xff\xfa" for a in stream.offsets)
    torn = whole[:2000] + b"\xff\xe0 noise \xff" + whole[2000:]
    found = mpeg_audio.parsed(torn)
    assert found.resyncs >= 1 and found.skipped and len(found.offsets) >= len(stream.offsets) - 2
    flipped = bytearray(whole)
    flipped[stream.offsets[3] + 10] ^= 1  # in the protected side information
    assert mpeg_audio.parsed(bytes(flipped)).bad_checksums == 1
    with pytest.raises(ValueError):
        mpeg_audio.payload_of(bytes(flipped), mpeg_audio.parsed(bytes(flipped)))
    rows = spark.createDataFrame([(1, bytearray(whole), "clash"), (2, None, "x"), (3, bytearray(b""), "x"), (4, bytearray(b"\xff" * 99), "x")],
                                 "id long, content binary, audio string")
    out = {r.id: r.audio for r in mpeg_audio.with_audio(rows).collect()}
    assert out[1].frames == len(stream.offsets) and out[1].offsets == stream.offsets and out[1].variable
    assert [out[k].frames for k in (2, 3, 4)] == [0, 0, 0]


def plain_nearest(rows, wanted, every):
    out = {}
    for query, x in rows:
        if query % every == 0:
            scored = sorted((-float(np.dot(x, y)), other) for other, y in rows if other != query)
            out[query] = [other for _, other in scored[:wanted]]
    return out


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32)) for i in range(600)]
    rows += [(600 + i, rows[40][1]) for i in range(60)]  # copies
    odd = [(1000, None), (1020, []), (1040, [0.0] * 8), (1060, [float("nan")] * 8), (1080, [1.0] * 7), (None, [1.0] * 8),
           (1100, [None] + [1.0] * 7), (1120, [float("inf")] * 8)]
    table = spark.createDataFrame([(i, [float(x) for x in v], 1.0) for i, v in rows] + [(*r, 2.0) for r in odd],
                                  "vec_id long, embedding array<float>, score double")
    want = plain_nearest([(i, v.astype(float)) for i, v in rows], 20, 20)
    got = collections.defaultdict(list)
    for r in nn_descent.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.95
    assert got[40] == want[40]  # copies tie; the smaller vec_id comes first
    few = nn_descent.nearest(table.where("vec_id < 5")).collect()
    assert [(r.query_id, r["rank"]) for r in few] == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert nn_descent.nearest(table.where("vec_id > 1000")).collect() == []


def test_nearest_in_a_group_of_near_copies(spark):
    """Neighbours inside a group whose vectors differ by less than a rounding to eight bits, beside others."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=64) / 8
    x = np.concatenate([centre + rng.normal(size=(800, 64)) * 0.0012, rng.normal(size=(400, 64)) / 8])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    assert (x[:800].astype(float) @ x[:800].T.astype(float)).min() > 0.9995
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = plain_nearest(list(enumerate(x.astype(float))), 20, 20)
    got = collections.defaultdict(set)
    for r in nn_descent.nearest(table).collect():
        got[r.query_id].add(r.vec_id)
    assert all(len(got[q]) == 20 for q in want)
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want if q < 800]) >= 0.9


@pytest.mark.parametrize("n", [15, 30, 64])
def test_nearest_in_small_tables(spark, n):
    rng = np.random.default_rng(n)
    x = (rng.normal(size=(n, 8)) * np.exp(rng.normal(size=(n, 1)))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in nn_descent.nearest(table, every=1).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got == plain_nearest(list(enumerate(x.astype(float))), 20, 1)


def test_urls(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    urls = {1: "http://a.Example.NET/en/1?x", 2: "https://example.net/de/", 3: "http://net", 4: "http://xnet/", 5: None, 6: "no scheme",
            7: "http://example.com/de/x#y", 8: "http://www.example.org/fr/", 9: "http://example.com/DE/", 10: "x://y://z.net/", 11: ""}
    pages = spark.createDataFrame([(k, u, "clash") for k, u in urls.items()] + [(2, urls[2], "again")], "page_id long, url string, host string")
    got, cut = ({r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_digests.judged(pages, rules, most=most).collect()}
                for most in (url_digests.FILE_BYTES, 50))  # one file and several
    assert cut == got and len(url_digests.files(rules, 50)) > 1
    assert got == {1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.net", "/de/", "net/", "block"),
                   3: ("net", "", None, "allow"), 4: ("xnet", "/", None, "allow"), 5: ("", "", None, "allow"),
                   6: ("", "", None, "allow"), 7: ("example.com", "/de/x", "example.com/de/", "block"),
                   8: ("www.example.org", "/fr/", "org/fr/", "allow"), 9: ("example.com", "/DE/", None, "allow"),
                   10: ("y:", "//z.net/", None, "allow"), 11: ("", "", None, "allow")}
    assert url_digests.judged(pages.limit(0), rules).count() == 0


def test_url_digest_collisions(monkeypatch, tmp_path):
    """Equal digests of different strings are told apart by the stored strings."""
    monkeypatch.setattr(url_digests.xxhash, "xxh64_intdigest", lambda text: len(text))
    path = tmp_path / "rules"
    (data,) = url_digests.files([("block", "aa.b/"), ("allow", "cc.d/"), ("block", "e.f/gh")])
    path.write_bytes(data)
    rules = url_digests.Rules([str(path)])
    assert rules.parts[0].found([b"cc.d/", b"aa.b/", b"xx.y/", b"e.f/gh"])[2] == -1
    assert rules.longest(["x.cc.d", "aa.b", "e.f", "q"], ["/", "/z", "/ghi", "/"]) == [
        ("cc.d/", "allow"), ("aa.b/", "block"), ("e.f/gh", "block"), None]
