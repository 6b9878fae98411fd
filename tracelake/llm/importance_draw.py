"""Target-distribution importance resampling: documents drawn in proportion to how much their n-grams look like a target.

Runs of one and two words are features, hashed into buckets; a bucket's gain is the logarithm of its share in the target
texts over its share in all documents, and a document weighs the mean gain of its features. Adding Gumbel noise from a
hash of the id and taking the highest scores draws without replacement.

In a batch, n-grams are interned in an open-addressed NumPy table: their xxhash64 chooses the slot, the bytes are compared
before a slot is shared, and slots store the n-gram's bucket and count. Occurrences keep their slot ids, through which
the counting pass sums and the scoring pass gathers gains, so each distinct n-gram of a batch is hashed into its bucket once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.fill_middle import draw
from tracelake.llm.tables import stored, text_bytes
from tracelake.llm.words import LOWER, spans
from tracelake.operators.ordering import with_positions

BUCKETS, RUN, SEED, SHARE, LEAST_WORDS = 10_000, 2, 7, 25, 20
#: Words interned together; a longer text takes several tables.
BLOCK_WORDS = 1 << 16
#: N-grams from this length on are hashed one at a time.
LONG = 96
#: Bytes between words: all of ASCII but digits and letters.
GAP = np.ones(256, bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = False
GAP[128:] = False
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)


def turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, little-endian; data ends in seven spare bytes at least."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def xxhash64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxHash64 (seed 0) of byte spans; data ends in eight spare bytes at least."""
    out, length = np.empty(len(starts), np.uint64), ends - starts
    view = lanes(data)
    long_ = length >= LONG
    for i in np.flatnonzero(long_).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i]: ends[i]])
    for wide in (False, True):
        rows = np.flatnonzero(~long_ & ((length >= 32) == wide))
        if not len(rows):
            continue
        at, left = starts[rows].copy(), length[rows].copy()
        with np.errstate(over="ignore"):
            if wide:
                acc = [np.full(len(rows), v) for v in (P1 + P2, P2, np.uint64(0), np.uint64(0) - P1)]
                while True:
                    on = np.flatnonzero(left >= 32)
                    if not len(on):
                        break
                    for k in range(4):
                        acc[k][on] = turned(acc[k][on] + view[at[on] + 8 * k] * P2, 31) * P1
                    at[on] += 32
                    left[on] -= 32
                h = turned(acc[0], 1) + turned(acc[1], 7) + turned(acc[2], 12) + turned(acc[3], 18)
                for k in range(4):
                    h = (h ^ (turned(acc[k] * P2, 31) * P1)) * P1 + P4
            else:
                h = np.full(len(rows), P5)
            h = h + length[rows].astype(np.uint64)
            while True:
                on = np.flatnonzero(left >= 8)
                if not len(on):
                    break
                h[on] = turned(h[on] ^ (turned(view[at[on]] * P2, 31) * P1), 27) * P1 + P4
                at[on] += 8
                left[on] -= 8
            on = np.flatnonzero(left >= 4)
            h[on] = turned(h[on] ^ ((view[at[on]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
            at[on] += 4
            left[on] -= 4
            while True:
                on = np.flatnonzero(left > 0)
                if not len(on):
                    break
                h[on] = turned(h[on] ^ (data[at[on]].astype(np.uint64) * P5), 11) * P1
                at[on] += 1
                left[on] -= 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[rows] = h ^ (h >> np.uint64(32))
    return out


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the spans of this length from a and from b hold the same bytes."""
    view, same = lanes(data), np.ones(len(a), bool)
    whole, rest = length >> 3, ((length & 7) << 3).astype(np.uint64)
    on, k = np.arange(len(a)), 0
    while len(on):
        mask = np.where(whole[on] > k, ~np.uint64(0), (np.uint64(1) << rest[on]) - np.uint64(1))
        same[on] = ((view[a[on] + 8 * k] ^ view[b[on] + 8 * k]) & mask) == 0
        k += 1
        on = on[same[on] & ((whole[on] > k) | ((whole[on] == k) & (rest[on] > 0)))]
    return same


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """zlib's CRC-32 of byte spans."""
    out, length = np.full(len(starts), 0xFFFFFFFF, np.uint32), ends - starts
    long_ = length >= LONG
    for i in np.flatnonzero(long_).tolist():
        out[i] = ~np.uint32(zlib.crc32(data[starts[i]: ends[i]]))
    on, k = np.flatnonzero(~long_ & (length > 0)), 0
    while len(on):
        out[on] = CRC[(out[on] ^ data[starts[on] + k]) & 255] ^ (out[on] >> 8)
        k += 1
        on = on[length[on] > k]
    return ~out


class Interned:
    """Byte spans interned in an open-addressed table: `slot` of each occurrence, and bucket and count of each slot."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS, keys: np.ndarray | None = None):
        keys = xxhash64(data, starts, ends) if keys is None else keys
        bits = max(4, int(2 * max(1, len(starts)) - 1).bit_length())
        owner = np.full(1 << bits, -1, np.int64)
        mask = (1 << bits) - 1
        self.slot = (keys & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(starts))
        while len(left):
            at = self.slot[left]
            free = left[owner[at] < 0]
            owner[self.slot[free]] = free  # of several, one stays
            held = owner[at]
            same = (keys[held] == keys[left]) & (ends[held] - starts[held] == ends[left] - starts[left])
            check = np.flatnonzero(same & (held != left))
            same[check] = equal_bytes(data, starts[held[check]], starts[left[check]], (ends - starts)[left[check]])
            left = left[~same]
            self.slot[left] = (self.slot[left] + 1) & mask
        self.count = np.bincount(self.slot, minlength=mask + 1)
        used = np.flatnonzero(owner >= 0)
        self.bucket = np.zeros(mask + 1, np.int64)
        self.bucket[used] = crc32(data, starts[owner[used]], ends[owner[used]]) % buckets

    def sums(self, buckets: int = BUCKETS) -> np.ndarray:
        """Occurrences by bucket."""
        return np.bincount(self.bucket, self.count, buckets).astype(np.int64)


def blocks(data: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray], run: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """N-grams of 1 to `run` consecutive words (`spans` of data), block by block: bytes with words joined by single
    spaces, starts and ends of occurrences in them, and the text of each occurrence."""
    starts, ends, first = words
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for i in range(0, len(starts), BLOCK_WORDS):
        j = min(len(starts), i + BLOCK_WORDS + run - 1)  # the last run - 1 words only continue runs
        own, length = min(BLOCK_WORDS, j - i), ends[i:j] - starts[i:j]
        at = np.concatenate([[0], np.cumsum(length + 1)])
        joined = np.zeros(at[-1] + 8, np.uint8)
        source = np.arange(at[-1]) + np.repeat(starts[i:j] - at[:-1], length + 1)
        joined[: at[-1]] = LOWER[data[np.minimum(source, len(data) - 1)]]
        joined[at[1:] - 1] = 32
        of, begin, end = [], [], []
        for n in range(run):
            k = np.arange(min(own, j - i - n))
            k = k[text[i + k] == text[i + k + n]]
            of.append(text[i + k])
            begin.append(at[k])
            end.append(at[k + n] + length[k + n])
        yield joined, np.concatenate(begin), np.concatenate(end), np.concatenate(of)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """Occurrences of n-grams by bucket over all texts: partial sums a batch, then a sum a bucket; `buckets` rows come to
    the driver."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for joined, starts, ends, _ in blocks(data, spans(data, offsets, GAP), run):
                total += Interned(joined, starts, ends, buckets).sums(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) for each of the B buckets."""
    all_t, all_s, b = int(target.sum()), int(source.sum()), len(target)
    return np.array([math.floor(1000 * math.log((t + 1) * float(all_s + b) / ((s + 1) * float(all_t + b))))
                     for t, s in zip(target.tolist(), source.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each text's n-grams, 0 without any."""
    buckets = len(gain)

    def score(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            rows, words = batch.num_rows, spans(data, offsets, GAP)
            total, n = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for joined, starts, ends, of in blocks(data, words, run):
                table = Interned(joined, starts, ends, buckets)
                value = gain[table.bucket][table.slot]  # by slot, then by occurrence
                total += np.bincount(of, value, rows).astype(np.int64)  # sums of a block stay far below 2**53
                n += np.bincount(of, minlength=rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words[2])), pa.array(n),
                                              pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths from a hash of doc_id."""
    u = (draw("doc_id", seed, 0) + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED,
              buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of docs.

    docs: doc_id long, text string; target: text string; other columns are ignored. Words are runs of digits, letters
    and bytes from 0x80 on, with A to Z lower-cased; features are all runs of 1 to `run` words, with repeats. Of the N
    rows with `least_words` words or more, floor(share * N / 100) are drawn: the highest scores, ties to the smaller doc_id; rank
    numbers them from 1 and is null for the others. A null or empty text has no words and the weight 0. Rows that repeat
    a doc_id are scored and drawn each for itself; a null doc_id draws its noise as an empty id and comes first among ties.
    An empty target makes all gains depend on the documents alone; an empty table gives an empty result. Texts are
    counted whole, however long, BLOCK_WORDS words at a time. Only `buckets` counts pass the driver; the rank is the place in a range sort.
    """
    gain = gains(bucket_counts(target, buckets, run), bucket_counts(docs, buckets, run))
    scored = stored(weighed(docs, gain, run).withColumn("score", F.col("weight") + noise(seed))
                    .withColumn("row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= least_words
    drawn = share * scored.where(able).count() // 100
    keys = ["doc_id", "n_words", "n_features", "weight", "score"]
    placed = with_positions(scored.where(able), F.desc("score"), F.asc_nulls_first("doc_id"), "row", out="place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return (placed.select(*keys, rank.alias("rank"))
            .unionByName(scored.where(~able).select(*keys, F.lit(None).cast("long").alias("rank"))))
