"""Hashed maximum-entropy language model over words.

P(word | history) = P(class | history) * P(word | class, history). Both factors are softmaxes. The class softmax sums
hashed feature weights: the previous word, the two previous words as one feature, the word before (skipping one) and
the classes two and three words further back. The word softmax runs over the words of one class with weights for the
class of the previous word. Frequent words are clustered by the frequent words near them; every other known word
belongs to a class chosen by its last two bytes, where its share is its smoothed relative frequency; all unknown words
are one outcome, a class of its own. The probabilities of all known words and the unknown outcome sum to one.

Biases start at the classes' logarithmic frequencies, so training starts at the unigram model. Every round then adds
up, over the documents of its slice, observed minus expected feature counts (the gradient of the log likelihood) in
Spark tasks and moves each weight by that gradient over its expected count; the slices cover all training documents.

Counts, classes and gradients come from all training documents. What is broadcast has a size fixed by parameters:
counts of at most `HEAD` words (the others meet their counts in a join) and the weight tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.tables import head_words, slices, stored, text_bytes
from tracelake.llm.words import LOWER, Lookup, hashes, mix, spans

HEAD = 1 << 19  # words whose counts are broadcast
WORDS = 4096  # words with weights of their own
HEAD_CLASSES, TAIL_CLASSES = 40, 23
UNKNOWN = HEAD_CLASSES + TAIL_CLASSES
CLASSES = UNKNOWN + 1
CLASS_WORDS = 128  # most words in one class
CONTEXT = 128  # frequent words that describe the others
BUCKET_BITS = 13
ROUNDS = 3
SMOOTH = 20.0
STEP = 1 << 17  # bytes of text whose tokens are worked out together
BLOCK, CHUNK = 1 << 11, 1 << 14  # tokens whose class weights are gathered together, and whose probabilities are added up
END, START = np.uint64(0xD1B54A32D192ED03), np.uint64(0xABC98388FB8FAC03)
SEEDS = np.array([0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0xCBBB9D5DC1059ED8, 0x629A292A367CD507, 0x9159015A3070DD17],
                 np.uint64)


@dataclass
class Model:
    words: np.ndarray  # head words, the most frequent first
    near: Lookup  # of those with weights only
    counts: np.ndarray
    total: int
    distinct: int
    classes: np.ndarray  # of the WORDS most frequent
    order: np.ndarray  # those words by class
    place: np.ndarray  # their places in order
    cuts: np.ndarray  # where each class starts in order
    bias: np.ndarray
    weights: np.ndarray  # class x bucket
    word_bias: np.ndarray  # by order
    word_weights: np.ndarray  # class of the previous word x order
    tail_mass: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, tail classes and text numbers of all tokens, an end after each text; len + 1 offsets of the texts."""
    starts, ends, first = spans(data, offsets)
    rows, per = len(offsets) - 1, np.diff(first)
    row = np.repeat(np.arange(rows), per)
    at = np.arange(len(starts)) + row
    out = np.full(len(starts) + rows, END)
    tail = np.zeros(len(out), np.int64)
    if len(starts):
        out[at] = hashes(data, starts, ends)
        last, before = LOWER[data[ends - 1]].astype(np.int64), LOWER[data[np.maximum(ends - 2, starts)]].astype(np.int64)
        tail[at] = (last * 31 + before * 7) % TAIL_CLASSES
    row_of = np.repeat(np.arange(rows), per + 1)
    return out, HEAD_CLASSES + tail, row_of, np.concatenate([[0], np.cumsum(per + 1)])


def shifted(values: np.ndarray, starts: np.ndarray, k: int, fill) -> np.ndarray:
    """The value k tokens before in the same text."""
    out = np.empty_like(values)
    out[k:] = values[:-k] if k < len(values) else values[:0]
    out[:k] = fill
    for i in range(k):
        at = starts[:-1] + i
        out[at[at < starts[1:]]] = fill
    return out


def bucket(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


#: Buckets of the classes two and three words further back.
FAR = [bucket(np.arange(CLASSES, dtype=np.uint64) + SEEDS[k]) for k in (3, 4)]


def features(hashed: np.ndarray, classes: np.ndarray, starts: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Buckets of the word features, the pair of classes further back as one number, the class of the previous token."""
    one, two = (shifted(hashed, starts, k, START) for k in (1, 2))
    before, third, fourth = (shifted(classes, starts, k, UNKNOWN) for k in (1, 3, 4))
    keys = [one + SEEDS[0], one * np.uint64(0x9E3779B1) + two + SEEDS[1], two + SEEDS[2]]
    return [bucket(k) for k in keys], third * CLASSES + fourth, before


def parts(n: int, size: int) -> list[slice]:
    return [slice(a, min(a + size, n)) for a in range(0, n, size)]


def class_tables(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The weights by bucket, and the biases with the weights of a pair of far classes by pair: rows of all classes, so that
    what a token needs of a table lies together."""
    both = (model.weights[:, FAR[0], None] + model.weights[:, None, FAR[1]]).reshape(CLASSES, -1)
    return np.ascontiguousarray(model.weights.T), np.ascontiguousarray((both + model.bias[:, None]).T)


def class_rows(tables: tuple[np.ndarray, np.ndarray], buckets: list, far: np.ndarray) -> np.ndarray:
    """Unnormalised log probabilities (token x class)."""
    rows = np.take(tables[1], far, axis=0)
    for b in buckets:
        rows += np.take(tables[0], b, axis=0)
    return rows


def class_logits(model: Model, buckets: list, far: np.ndarray) -> np.ndarray:
    """Unnormalised log probabilities (class x token)."""
    return class_rows(class_tables(model), buckets, far).T


def class_shares(tables: tuple[np.ndarray, np.ndarray], buckets: list, far: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Class probabilities (class x token) of the tokens, `CHUNK` at a time."""
    for chunk in parts(len(far), CHUNK):
        many, near = far[chunk], [b[chunk] for b in buckets]
        p = np.empty((CLASSES, len(many)))
        for at in parts(len(many), BLOCK):
            rows = class_rows(tables, [b[at] for b in near], many[at])
            np.exp(rows, out=rows)
            rows /= rows.sum(axis=1, keepdims=True)
            p[:, at] = rows.T
        yield chunk, p


def class_logs(tables: tuple[np.ndarray, np.ndarray], buckets: list, far: np.ndarray,
               classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of each token's class, and of the unknown outcome in its place."""
    own, unknown = np.empty(len(far)), np.empty(len(far))
    for at in parts(len(far), BLOCK):
        rows = class_rows(tables, [b[at] for b in buckets], far[at])
        own[at], unknown[at] = rows[np.arange(len(rows)), classes[at]], rows[:, UNKNOWN]
        total = np.log(np.exp(rows, out=rows).sum(axis=1))
        own[at] -= total
        unknown[at] -= total
    return own, unknown


def word_table(model: Model) -> np.ndarray:
    """Log probability of each frequent word in its class, by class of the previous word (class x word in order)."""
    out = model.word_weights.astype(np.float64) + model.word_bias
    for a, b in zip(model.cuts[:-1], model.cuts[1:]):
        part = out[:, a:b]
        if b > a:
            part -= part.max(axis=1, keepdims=True)
            part -= np.log(np.exp(part).sum(axis=1, keepdims=True))
    return out


def add_columns(table: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
    """Add each row of values, summed by key, to the table's row."""
    for total, row in zip(table, values):
        np.add.at(total, keys, row)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, tail, c): occurrences of every word, its end-of-text token included."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            parts = [tokens(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])[:2] for a, b in slices(offsets)]
            if not parts:
                continue
            word, tail = (np.concatenate(x) for x in zip(*parts))
            word, first, c = np.unique(word, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(tail[first].astype(np.int32)),
                                              pa.array(c)], ["word", "tail", "c"])

    return (docs.select("text").mapInArrow(run, "word long, tail int, c long").groupBy("word", "tail")
            .agg(F.sum("c").alias("c")))


def summed(rows: DataFrame, *shapes: tuple[int, int]) -> list[np.ndarray]:
    """Add up (key, values) rows, values being packed numbers, into tables whose rows are numbered on end by key."""

    def add(batches):
        table = {}
        for batch in batches:
            for key, value in zip(batch.column("key").to_pylist(), batch.column("values")):
                value = np.frombuffer(value.as_buffer(), np.float32)
                table[key] = table[key] + value if key in table else value.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(table), pa.int32()),
                                          pa.array([v.tobytes() for v in table.values()], pa.binary())], ["key", "values"])

    out = [np.zeros(shape) for shape in shapes]
    ends = np.cumsum([0, *(height for height, _ in shapes)])
    for key, value in rows.repartition("key").mapInArrow(add, rows.schema).collect():
        k = int(np.searchsorted(ends, key, "right")) - 1
        out[k][key - ends[k]] = np.frombuffer(value)
    return out


def packed(table: np.ndarray, first: int = 0) -> pa.RecordBatch:
    some = np.flatnonzero(table.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array((some + first).astype(np.int32)),
                                       pa.array([table[i].astype(np.float32).tobytes() for i in some], pa.binary())],
                                      ["key", "values"])


def cluster(near: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Classes of the frequent words: the first few alone, the others by k-means on their weighted neighbours."""
    n = len(near)
    classes, alone = np.zeros(n, np.int64), min(8, n)
    classes[:alone] = np.arange(alone)
    rest = np.arange(alone, n)
    if not len(rest):
        return classes
    share = (near + 0.05) / (near + 0.05).sum(axis=1, keepdims=True)
    usual = (near.sum(axis=0) + 1) / (near.sum() + near.shape[1])
    x = np.maximum(np.log(share / usual), 0)[rest]
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    k = min(HEAD_CLASSES - alone, len(rest))
    middle = x[:: max(1, len(x) // k)][:k].copy()
    most = max(CLASS_WORDS, -(-len(rest) // k))
    for _ in range(12):
        like = x @ middle.T
        own, room = np.full(len(x), -1), np.full(k, most)
        for i in range(len(x)):  # the most frequent choose first
            for c in np.argsort(-like[i], kind="stable"):
                if room[c]:
                    own[i], room[c] = c, room[c] - 1
                    break
        for c in range(k):
            if (own == c).any():
                middle[c] = x[own == c].mean(axis=0)
        middle /= np.linalg.norm(middle, axis=1, keepdims=True) + 1e-9
    classes[rest] = alone + own
    return classes


def neighbours(docs: DataFrame, lookup: Lookup, words: int) -> np.ndarray:
    """How often each frequent word has each of the most frequent ones up to two tokens away."""
    shared = docs.sparkSession.sparkContext.broadcast(lookup)

    def run(batches):
        table = np.zeros(words * CONTEXT, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets):
                hashed, _, _, starts = tokens(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                place = shared.value(hashed).astype(np.int64)
                place[place >= words] = -1
                for k in (1, 2):
                    before = shifted(place, starts, k, -1)
                    for x, y in ((place, before), (before, place)):
                        good = (x >= 0) & (y >= 0) & (y < CONTEXT)
                        table += np.bincount(x[good] * CONTEXT + y[good], minlength=len(table))
        yield packed(table.reshape(words, CONTEXT))

    rows = docs.select("text").mapInArrow(run, "key int, values binary")
    out = summed(rows, (words, CONTEXT))[0]
    shared.destroy()
    return out


def start_model(docs: DataFrame, counts: DataFrame) -> Model:
    """The unigram model, with classes."""
    total, distinct, singles = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"),
                                          F.count(F.when(F.col("c") == 1, 1))).first()
    word, c = head_words(counts, HEAD)
    n = min(WORDS, len(word))
    own = word[:n]
    classes = cluster(neighbours(docs, Lookup(own), n), c[:n]) if n else np.zeros(0, np.int64)
    order = np.argsort(classes, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    smooth = c[:n] + 0.5
    mass = np.bincount(classes, smooth, CLASSES).astype(np.float64)
    spark = counts.sparkSession
    few = spark.createDataFrame([(int(x),) for x in own.view(np.int64)], "word long")
    for tail, m in (counts.join(F.broadcast(few), "word", "left_anti").groupBy("tail")
                    .agg(F.sum(F.col("c") + 0.5)).collect()):
        mass[tail] = m
    mass[UNKNOWN] = singles + 0.5  # unknown words come about as often as words seen once
    with np.errstate(divide="ignore"):
        bias = np.maximum(np.log(mass) - np.log(mass.sum()), -30).astype(np.float32)
    return Model(word, Lookup(own), c, total, distinct, classes, order, place,
                 np.searchsorted(classes[order], np.arange(HEAD_CLASSES + 1)), bias,
                 np.zeros((CLASSES, 1 << BUCKET_BITS), np.float32), np.log(smooth[order]).astype(np.float32),
                 np.zeros((CLASSES, n), np.float32), mass)


def prepared(model: Model, lookup: Lookup, data: np.ndarray, offsets: np.ndarray):
    hashed, tail, row, starts = tokens(data, offsets)
    head = lookup(hashed).astype(np.int64)
    frequent = (head >= 0) & (head < len(model.classes))
    classes = tail
    classes[frequent] = model.classes[head[frequent]]
    return hashed, head, frequent, classes, row, starts


def gradient(docs: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Observed and expected counts: of the class features (class x bucket) and of the word features (class x word).

    Each task adds up its split and sends one table of fixed size; the words without weights stay on the driver.
    """
    few = replace(model, words=model.words[:0], counts=model.counts[:0])
    shared, high, n = docs.sparkSession.sparkContext.broadcast(few), 1 << BUCKET_BITS, len(model.classes)

    def run(batches):
        m = shared.value
        tables = class_tables(m)
        seen, meant = np.zeros(CLASSES * high), np.zeros((CLASSES, high))
        far_seen, far_meant = np.zeros(CLASSES ** 3), np.zeros((CLASSES, CLASSES ** 2))
        word_seen = np.zeros(CLASSES * n)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets, STEP):
                hashed, head, frequent, classes, _, starts = prepared(m, m.near, data[offsets[a]: offsets[b]],
                                                                      offsets[a: b + 1] - offsets[a])
                buckets, far, before = features(hashed, classes, starts)
                for k in buckets:
                    np.add.at(seen, classes * high + k, 1.0)
                np.add.at(far_seen, classes * CLASSES ** 2 + far, 1.0)
                for at, p in class_shares(tables, buckets, far):
                    for k in buckets:
                        add_columns(meant, k[at], p)
                    add_columns(far_meant, far[at], p)
                if n:
                    np.add.at(word_seen, (before * n)[frequent] + m.place[head[frequent]], 1.0)
        both = [seen.reshape(CLASSES, high), meant]
        for total, pairs in zip(both, (far_seen, far_meant)):
            pairs = pairs.reshape(CLASSES, CLASSES, CLASSES)
            for at, axis in zip(FAR, (2, 1)):
                np.add.at(total.T, at, pairs.sum(axis=axis).T)
        yield packed(np.hstack([x.T for x in both]))
        if n:
            yield packed(word_seen.reshape(CLASSES, n), high)

    rows = docs.select("text").mapInArrow(run, "key int, values binary")
    table, word_seen = summed(rows, (high, 2 * CLASSES), (CLASSES, n))
    shared.destroy()
    table = table.T
    # a word's expected count needs no pass of its own: its class's count after each class, times its probability there
    word_meant = np.exp(word_table(model))
    for a, b in zip(model.cuts[:-1], model.cuts[1:]):
        word_meant[:, a:b] *= word_seen[:, a:b].sum(axis=1, keepdims=True)
    return table[:CLASSES], table[CLASSES:], word_seen, word_meant


def trained(docs: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    slot = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(7)), F.lit(rounds))
    for turn in range(rounds):
        seen, meant, word_seen, word_meant = gradient(docs.where(slot == turn), model)
        step = np.clip((seen - meant) / (meant + SMOOTH), -0.9, 4.0)
        model.weights += (0.35 * np.sign(step) * np.log1p(np.abs(step))).astype(np.float32)
        step = np.clip((word_seen - word_meant) / (word_meant + SMOOTH), -0.9, 4.0)
        model.word_weights += (0.8 * np.sign(step) * np.log1p(np.abs(step))).astype(np.float32)
    return model


def scored(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """One row per document with sums over its tokens; words outside the head meet their counts in a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tail = "array<struct<word: long, known: double, unknown: double>>"

    def run(batches):
        m = shared.value
        log_count = np.log10(m.counts + 0.5)
        tail_mass = np.log10(np.maximum(m.tail_mass, 0.5))
        ten, inner, lookup, tables = np.log(10), word_table(m), Lookup(m.words), class_tables(m)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            columns = [[], [], [], [], []]
            for a, b in slices(offsets, STEP):
                hashed, head, frequent, classes, row, starts = prepared(m, lookup, data[offsets[a]: offsets[b]],
                                                                        offsets[a: b + 1] - offsets[a])
                buckets, far, before = features(hashed, classes, starts)
                own, unknown = (x / ten for x in class_logs(tables, buckets, far, classes))
                counted = head >= 0
                other = counted & ~frequent
                own[other] += log_count[head[other]] - tail_mass[classes[other]]
                if len(m.classes):
                    own[frequent] += inner[before[frequent], m.place[head[frequent]]] / ten
                rows = b - a
                columns[0].append(np.diff(starts))
                columns[1].append(np.bincount(row[counted], minlength=rows))
                columns[2].append(np.bincount(row[counted], log_count[head[counted]], rows))
                columns[3].append(np.bincount(row[counted], own[counted], rows))
                rest = ~counted
                columns[4].append((np.bincount(row[rest], minlength=rows), hashed[rest].view(np.int64),
                                   own[rest] - tail_mass[classes[rest]], unknown[rest]))
            if not columns[0]:
                continue
            lengths, word, known, unknown = (np.concatenate(x) for x in zip(*columns[4]))
            items = pa.StructArray.from_arrays([pa.array(word), pa.array(known), pa.array(unknown)],
                                               ["word", "known", "unknown"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"),
                 *(pa.array(np.concatenate(x).astype(t)) for x, t in
                   zip(columns[:4], (np.int64, np.int64, np.float64, np.float64))),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), items)],
                ["doc_id", "held_out", "n_tokens", "n_head", "head_base", "head_score", "rest"])

    rows = (docs.select("doc_id", "held_out", "text")
            .mapInArrow(run, f"doc_id long, held_out boolean, n_tokens long, n_head long, head_base double, "
                             f"head_score double, rest {tail}"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    shared.destroy()
    met = (rows.select("row", F.explode("rest").alias("x")).select("row", "x.*").join(counts.select("word", "c"), "word", "left")
           .select("row", F.when(F.col("c").isNotNull(), 1).otherwise(0).alias("is_known"),
                   F.log10(F.coalesce("c", F.lit(0)) + 0.5).alias("base"),
                   F.when(F.col("c").isNotNull(), F.col("known") + F.log10(F.col("c") + 0.5)).otherwise(F.col("unknown"))
                   .alias("score")))
    met = met.groupBy("row").agg(F.sum("is_known").alias("rest_known"), F.sum("base").alias("rest_base"),
                                 F.sum("score").alias("rest_score"))
    return rows.drop("rest").join(met, "row", "left").na.fill(0, ["rest_known", "rest_base", "rest_score"])


def lm_scores(docs: DataFrame) -> DataFrame:
    """Score every text with a model learnt from the documents whose crc32(doc_id as text) mod 5 is not 1.

    docs: doc_id long, text string; other columns are ignored. Returns a row per input row: doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score (smoothed unigram) and score (this model), both log10
    probabilities of the words and the end of the text. A null text counts as empty: its end alone is scored. A row
    without doc_id is not held out. Repeated rows are scored, and train, once each. Texts are scored whole, however long.
    With an empty table the result is empty; without training tokens every word is unknown.
    """
    docs = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
                       .alias("held_out"))
    train = docs.where("NOT held_out")
    counts = stored(count_words(train))
    model = trained(train, start_model(train, counts))
    norm = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    rows = scored(docs, model, counts)
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + F.col("rest_known")).alias("n_known"),
                       F.lit(int(model.total)).cast("long").alias("train_tokens"),
                       (F.col("head_base") + F.col("rest_base") - F.col("n_tokens") * norm).alias("base_score"),
                       (F.col("head_score") + F.col("rest_score")).alias("score"))
