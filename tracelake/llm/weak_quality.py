"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document. All votes are counted by pattern (at most 3 to the
power of their number), and expectation-maximisation over the pattern counts estimates how often each labeller, when
it votes, is right on good and on bad documents. Abstaining says nothing about a document. Every kind of defect is
watched by two labellers at least, because what a single one sees could as well be its own error rate. The posterior
of a document's pattern labels it, and these labels train a linear scorer on hashed word shapes, which judges all
documents.

Votes and counts come from all documents. The scorer is fitted on a bounded sample: documents whose hash is below a
limit that lets through about `SAMPLE_ROWS`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.tables import extended, slices, stored, text_bytes
from tracelake.llm.words import BLANK, hashes, mix, spans

SAMPLE_ROWS = 20_000
BUCKETS = 4096
#: Documents are rejected below this score; far below one half, because a clean document lost costs more than a bad one.
KEEP_FROM = 0.2
ABSTAIN, GOOD, BAD = 0, 1, 2
FOUND = {"votes": "long", "posterior": "double", "score": "double", "keep": "boolean"}
LOWER_CASE, UPPER_CASE, DIGIT, STOP, MARK, OTHER = range(1, 7)

KIND = np.full(256, OTHER, np.uint8)
KIND[97:123] = LOWER_CASE
KIND[65:91] = UPPER_CASE
KIND[48:58] = DIGIT
KIND[128:] = LOWER_CASE
KIND[[46, 44, 58, 59, 39, 34, 40, 41, 45, 63]] = STOP  # punctuation of prose
KIND[33] = MARK
KIND_VALUES = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: Labeller, measure, vote bad from, vote good below (between the two, or without the measure, it abstains).
LABELLERS = [
    ("symbol_words", "symbol_words", 0.15, 0.03),
    ("symbol_characters", "other_characters", 0.06, 0.01),
    ("shouting", "upper_letters", 0.35, 0.12),
    ("exclamations", "mark_words", 0.25, 0.05),
    ("bare_symbols", "bare_words", 0.05, 0.01),
    ("cells", "bars", 0.01, 0.002),
    ("stutter", "repeated_words", 0.15, 0.03),
    ("monotony", "word_repetition", 0.45, 0.30),
    ("repeated_lines", "repeated_lines", 0.30, 0.10),
]


@dataclass
class Shapes:
    """What the labellers measure and the hashed features, for the texts of one step."""

    measures: dict[str, np.ndarray]  # NaN where a text is too short for the measure
    words: np.ndarray
    buckets: np.ndarray  # feature x word
    row: np.ndarray


def distinct_per_row(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    keys = mix(keys ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    keys, new = keys[order], np.ones(len(order), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount(row[order[new]], minlength=rows)


def shapes(data: np.ndarray, offsets: np.ndarray) -> Shapes:
    rows = len(offsets) - 1
    starts, ends, first = spans(data, offsets)
    words = np.diff(first)
    row = np.repeat(np.arange(rows), words)
    kind = KIND[data]
    kind[BLANK[data]] = 0
    if len(data):
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        kind[:-1][capital] = UPPER_CASE
        kind[1:][capital] = UPPER_CASE

    def share(flags: np.ndarray, least: int) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.where(words >= least, np.bincount(row, flags, rows) / words, np.nan)

    # by the places of the bytes in question, which are few but for letters
    def per_text(places: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(places, offsets))

    def per_word(places: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(starts, places, "right") - 1, minlength=len(starts))

    hashed = hashes(data, starts, ends)
    same = np.zeros(len(hashed), bool)
    same[1:] = (hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1])
    upper_case = kind == UPPER_CASE
    letter = (kind == LOWER_CASE) | upper_case
    lettered = np.logical_or.reduceat(letter, starts) if len(starts) else np.empty(0, bool)  # between words is none
    others, marks = np.flatnonzero(kind == OTHER), np.flatnonzero(kind == MARK)
    others_of = per_word(others)
    line_at = np.zeros(len(data) + 1, bool)
    line_at[offsets] = True
    line_at[1:][data == 10] = True
    line = np.flatnonzero(line_at[:-1])
    line_end = np.concatenate([line[1:], [len(data)]]) if len(line) else line
    line_hash = hashes(data, line, np.maximum(line, line_end - (data[line_end - 1] == 10))) if len(line) else np.empty(0, np.uint64)
    line_row = np.searchsorted(offsets, line, "right") - 1
    lines = np.bincount(line_row, minlength=rows)
    with np.errstate(all="ignore"):
        upper, all_letters = per_text(np.flatnonzero(upper_case)), per_text(np.flatnonzero(letter))
        printed = np.bincount(row, ends - starts, rows)
        variety = np.log(np.maximum(distinct_per_row(hashed, row, rows), 1)) / np.log(np.maximum(words, 2))
        measures = {
            "symbol_words": share(lettered & (others_of >= 2), 3),
            "upper_letters": np.where(all_letters >= 20, upper / all_letters, np.nan),
            "mark_words": share(per_word(marks) > 0, 3),
            "bare_words": share(others_of == ends - starts, 3),
            "repeated_words": share(same, 10),
            "word_repetition": np.where(words >= 20, 1 - variety, np.nan),
            "repeated_lines": np.where(lines >= 3, 1 - distinct_per_row(line_hash, line_row, rows) / lines, np.nan),
            "other_characters": np.where(printed >= 20, per_text(others) / printed, np.nan),
            "bars": np.where(printed >= 20, per_text(np.flatnonzero(data == 124)) / printed, np.nan),
        }

    # the shape of a word: its kinds of characters with runs as one
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    new &= kind > 0
    runs, begins = kind[new], np.zeros(len(data), bool)
    begins[starts] = True
    at = np.append(np.flatnonzero(begins[new]), len(runs))
    shape = hashes(runs, at[:-1], at[1:], KIND_VALUES)
    before = np.concatenate([np.zeros(1, np.uint64), shape[:-1]])[: len(shape)] * (row == np.concatenate([[-1], row[:-1]])[: len(row)])
    tail = data[ends - 1].astype(np.uint64) * np.uint64(257) + data[np.maximum(ends - 2, starts)] if len(ends) else shape
    keys = [shape, shape * np.uint64(3) + before, mix(tail + np.uint64(1 << 40)),
            mix(same.astype(np.uint64) + np.uint64(1 << 41))]
    buckets = np.stack([(mix(k + np.uint64(i)) % np.uint64(BUCKETS)).astype(np.int64) for i, k in enumerate(keys)])
    return Shapes(measures, words, buckets, row)


def votes(found: Shapes) -> np.ndarray:
    """Votes (labeller x text)."""
    out = np.zeros((len(LABELLERS), len(found.words)), np.int64)
    for i, (_, measure, bad, good) in enumerate(LABELLERS):
        x = found.measures[measure]
        out[i][x >= bad] = BAD
        out[i][x < good] = GOOD
    return out


def pattern(found: Shapes) -> np.ndarray:
    return (votes(found) * 3 ** np.arange(len(LABELLERS))[:, None]).sum(axis=0)


def unpacked(patterns: np.ndarray) -> np.ndarray:
    """Votes (pattern x labeller)."""
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass
class Labels:
    """What expectation-maximisation found: share of bad documents, and P(vote | class)."""

    bad: float
    chance: np.ndarray  # class (good, bad) x labeller x vote, among its votes

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document with these votes is good."""
        v = unpacked(patterns)
        logs = (np.log(self.chance)[:, np.arange(len(LABELLERS)), v] * (v != ABSTAIN)).sum(axis=2)
        odds = logs[0] + np.log(1 - self.bad) - logs[1] - np.log(self.bad)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracies(self) -> dict[str, float]:
        """P(vote is right | labeller votes)."""
        right = (1 - self.bad) * self.chance[0, :, GOOD] + self.bad * self.chance[1, :, BAD]
        return {name: float(x) for (name, *_), x in zip(LABELLERS, right)}


def estimated(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> Labels:
    """Expectation-maximisation; it starts from "any bad vote is right" and stops when the posteriors settle."""
    v = unpacked(patterns)
    good = np.where((v == BAD).any(axis=1), 0.1, 0.95)
    labels = Labels(0.5, np.full((2, len(LABELLERS), 3), 1 / 3))
    for _ in range(rounds):
        for k, weight in enumerate((good * counts, (1 - good) * counts)):
            for vote in (GOOD, BAD):
                labels.chance[k, :, vote] = ((((v == vote) * weight[:, None]).sum(axis=0) + 0.5)
                                             / (((v != ABSTAIN) * weight[:, None]).sum(axis=0) + 1))
        labels.bad = float(((1 - good) * counts).sum() + 1) / (counts.sum() + 2)
        after = labels.posterior(patterns)
        moved, good = np.abs(after - good).max(initial=0), after
        if moved < 1e-6:
            break
    return labels


def surveyed(docs: DataFrame, share: float) -> DataFrame:
    """(pattern, buckets, values): votes of every document; hashed features of those in the sample."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            chosen = batch.column("chosen").to_numpy(zero_copy_only=False).astype(bool)
            codes, buckets, values = [], [], []
            for a, b in slices(offsets):
                found = shapes(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                codes.append(pattern(found))
                cuts = np.concatenate([[0], np.cumsum(found.words)])
                for i in range(b - a):
                    own = found.buckets[:, cuts[i]: cuts[i + 1]].ravel() if chosen[a + i] and found.words[i] else None
                    if own is None:
                        buckets.append(None)
                        values.append(None)
                    else:
                        keys, n = np.unique(own, return_counts=True)
                        buckets.append(keys.astype(np.int32))
                        values.append((n / found.words[i]).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(codes) if codes else [], pa.int64()), pa.array(buckets, pa.list_(pa.int32())),
                 pa.array(values, pa.list_(pa.float32()))], ["pattern", "buckets", "values"])

    chosen = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))
    return (docs.select("text", chosen.alias("chosen"))
            .mapInArrow(run, "pattern long, buckets array<int>, values array<float>"))


def fitted(sample: pa.Table, labels: Labels, steps: int = 300) -> np.ndarray:
    """Weights of the linear scorer, the last one the bias: logistic regression by Adam on soft labels."""
    weights = np.zeros(BUCKETS + 1)
    rows = sample.num_rows
    if not rows:
        return weights
    buckets, values = (sample.column(c).combine_chunks() for c in ("buckets", "values"))
    row = np.repeat(np.arange(rows), np.diff(buckets.offsets.to_numpy()))
    key, value = buckets.flatten().to_numpy(), values.flatten().to_numpy()
    goal = labels.posterior(sample.column("pattern").to_numpy())
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        logit = np.bincount(row, value * weights[key], rows) + weights[-1]
        off = 1 / (1 + np.exp(-logit)) - goal
        slope = np.append(np.bincount(key, value * off[row], BUCKETS), off.sum()) / rows + 1e-6 * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
        weights -= 0.3 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return weights


def judged(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and other columns) with votes, posterior, score and keep; columns of these names are replaced."""
    docs = docs.drop(*FOUND)
    rows = docs.count()
    found = stored(surveyed(docs, min(1.0, SAMPLE_ROWS / max(rows, 1))))
    counted = found.groupBy("pattern").count().collect()
    labels = estimated(np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], np.float64))
    weights = fitted(found.where("buckets IS NOT NULL").toArrow(), labels)
    shared = docs.sparkSession.sparkContext.broadcast((labels, weights))

    def run(batches):
        labels, weights = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            codes, score, words = [], [], []
            for a, b in slices(offsets):
                x = shapes(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a])
                total = np.bincount(x.row, weights[x.buckets].sum(axis=0), b - a)
                logit = total / np.maximum(x.words, 1) + weights[-1]
                codes.append(pattern(x))
                score.append(np.where(x.words > 0, 1 / (1 + np.exp(-np.clip(logit, -50, 50))), 0.0))
                words.append(x.words)
            if not codes:
                continue
            codes, score, words = map(np.concatenate, (codes, score, words))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(codes), pa.array(np.where(words > 0, labels.posterior(codes), 0.0)),
                 pa.array(score), pa.array((score >= KEEP_FROM) & (words > 0))], [*batch.schema.names, *FOUND])

    return docs.mapInArrow(run, extended(docs.schema, FOUND))


def quality(docs: DataFrame) -> DataFrame:
    """Quality of every document: doc_id, votes (pattern of the labellers), posterior, score, keep.

    docs: doc_id long, text string; other columns are ignored; one row per input row. score is the linear scorer's
    probability that a text is good, keep whether it is `KEEP_FROM` or more; posterior is what the votes alone say.
    Texts that are null, empty or blank have score 0 and aren't kept. Equal texts, and rows that repeat a doc_id, get
    equal results for equal texts. Texts are judged whole, however long, one at a time where they are over 1 MB. An
    empty table gives an empty result.
    """
    return judged(docs.select("doc_id", "text")).drop("text")


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier keeps. Rows whose text is null, empty or blank go;
    repeated rows are judged alike, whole texts however long. An empty table stays empty."""
    plain = {c: f"column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return judged(docs.withColumnsRenamed(plain)).where("keep").drop(*FOUND).toDF(*docs.columns)
