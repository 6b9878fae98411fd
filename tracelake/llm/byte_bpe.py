"""Byte-level BPE: encode whole texts to token ids and decode them.

A text is cut into words by the tokenizer's pattern and every word is merged on its own, so work is done once per
distinct word. The most frequent words of the corpus (their number is bounded) are merged by Spark: a higher-order
fold over the word's array of bytes merges the adjacent pair of lowest rank, found in a rank map, until no pair is in
it; decoding concatenates the pieces of a table. Map and table are one row that groups of words meet in a broadcast join.
Their results are broadcast. The other distinct
words of a batch are merged by the same rule over arrays of token numbers, many words at a time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.tables import discard, extended, head_words, slices, stored, text_bytes, tidy
from tracelake.llm.words import BYTE_VALUES, Lookup, hashes, mix

#: Words merged by Spark and broadcast; groups of them that meet the ranks; buckets of the rank map; bytes of words that are
#: merged side by side.
FREQUENT = 1 << 17
GROUPS = 512
MAP_BUCKETS = 1 << 13
SIDE_BY_SIDE = 64
NO_RANK = 1 << 30
FOUND = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "lossless": "boolean"}

OTHER, LETTER, NUMBER, SPACE = range(4)
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def character_kinds() -> np.ndarray:
    kinds = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)],
                     np.uint8)
    kinds[WHITE_SPACE] = SPACE
    return kinds


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and len + 1 offsets of each text into them.

    The words are the matches of 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+,
    found for all texts at once: a word starts where the kind of character changes, a single blank joins the word
    after it, and a longer run of white space keeps all but its last character.
    """
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32 if len(data) < 1 << 31 else np.int64)
    if len(at) != len(code):
        raise ValueError("text is not UTF-8")
    n = len(code)
    begin = np.searchsorted(at, offsets)  # of the texts, in characters
    kind = character_kinds()[code]
    edge = np.zeros(n + 1, bool)
    edge[begin] = True
    edge[n] = True
    start = edge[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # the last of several white-space characters before something else is a word of its own or joins what follows
    last = space & ~edge[1:]
    last[:-1] &= ~space[1:]
    start |= last
    joins = last & (code == 32)
    after = np.flatnonzero(joins) + 1
    start[after] = False
    # contractions: an apostrophe at the start of a word, before the letters
    for i in np.flatnonzero((code == 39) & start).tolist():
        if i + 1 < n and not edge[i + 1]:
            one = chr(code[i + 1])
            two = one + chr(code[i + 2]) if i + 2 < n and not edge[i + 2] else ""
            size = 2 if one in "stmd" else 3 if two in ("re", "ve", "ll") else 0
            if size:
                start[i + 1] = False
                if i + size < n:
                    start[i + size] = True if kind[i + size] == LETTER else start[i + size]
    first = np.flatnonzero(start)
    starts = at[first]
    return starts, np.append(starts[1:], len(data)), np.searchsorted(first, begin)


class Ranks:
    """A rank file: lines of a token in base64 and its number."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces: list[bytes] = [b""] * (max(self.of.values()) + 1)
        for piece, rank in self.of.items():
            self.pieces[rank] = piece
        self.numbers = [b"%d" % i for i in range(len(self.pieces))]
        self.bytes = np.array([self.of[bytes([b])] for b in range(256)], np.int64)
        left, right, made = [], [], []
        for piece, rank in self.of.items():
            for k in range(1, len(piece)):
                a, b = self.of.get(piece[:k]), self.of.get(piece[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        self.pairs = Lookup(self.key(np.array(left, np.int64), np.array(right, np.int64)))
        self.made = np.append(np.array(made, np.int64), NO_RANK)  # -1, no such pair, finds the last

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mix((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the token that each pair makes."""
        return self.made[self.pairs(self.key(left, right).ravel())].reshape(left.shape)

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """Token numbers of each word."""
        out: list = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if (whole := self.of.get(word)) is not None:
                out[i] = [whole]
            elif len(word) <= SIDE_BY_SIDE:
                by_length.setdefault(len(word), []).append(i)
            else:
                out[i] = self.merged_alone(word)
        for length, rows in by_length.items():
            text = np.frombuffer(b"".join(words[i] for i in rows), np.uint8).reshape(-1, length)
            for i, ids in zip(rows, self.merged_together(self.bytes[text])):
                out[i] = ids
        return out

    def merged_together(self, ids: np.ndarray) -> list[list[int]]:
        """Merge rows of token numbers of the same length, one pair a row and turn."""
        rows, width = ids.shape
        size, out = np.full(rows, width), [None] * rows
        ids, pair = ids.astype(np.int32), np.full((rows, width), NO_RANK, np.int32)
        pair[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        which = np.arange(rows)
        columns = np.arange(width)
        while len(which):
            at = pair.argmin(axis=1)
            rank = pair[np.arange(len(which)), at]
            done = rank == NO_RANK
            if done.any():
                for i, n, found in zip(which[done].tolist(), size[done].tolist(), ids[done].tolist()):
                    out[i] = found[:n]
                live = ~done
                which, ids, pair, size, at, rank = (x[live] for x in (which, ids, pair, size, at, rank))
                if not len(which):
                    break
            row = np.arange(len(which))
            ids[row, at] = rank
            # what follows the two tokens moves up by one; the last place is never looked at again
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=columns[None, :-1] > at[:, None])
            np.copyto(pair[:, :-1], pair[:, 1:].copy(), where=columns[None, :-1] >= at[:, None])
            size -= 1
            # the pairs on either side of the new token
            has_right = at + 1 < size
            pair[row, at] = np.where(has_right, self.rank(rank, ids[row, np.minimum(at + 1, width - 1)]), NO_RANK)
            has_left = at > 0
            before = np.maximum(at - 1, 0)
            pair[row, before] = np.where(has_left, self.rank(ids[row, before], rank), pair[row, before])
            width = int(size.max())
            ids, pair, columns = ids[:, :width], pair[:, :width], columns[:width]
            pair[row, size - 1] = NO_RANK
        return out

    def merged_alone(self, word: bytes) -> list[int]:
        """Merge one long word with a heap of its pairs, in time n log n."""
        n = len(word)
        ids = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != NO_RANK]
        heapify(heap)
        while heap:
            rank, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0:
                    y = after[x]
                    made = self.of.get(self.pieces[ids[x]] + self.pieces[ids[y]])
                    if made is not None:
                        heappush(heap, (made, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    # the same by Spark: bytes are the characters U+0000 to U+00FF

    def rank_text(self) -> str:
        """The ranks as one JSON text: an array of small maps, chosen by hash."""
        buckets: list[dict[str, int]] = [{} for _ in range(MAP_BUCKETS)]
        for piece, rank in self.of.items():
            name = piece.decode("latin-1")
            buckets[xxhash.xxh64_intdigest(name.encode(), seed=42) % MAP_BUCKETS][name] = rank
        return json.dumps(buckets, separators=(",", ":"))

    def piece_text(self) -> str:
        return json.dumps([p.decode("latin-1") for p in self.pieces], separators=(",", ":"))

    def rank_map(self, text: Column | None = None) -> Column:
        """The array of maps in a column of that text, or as a literal."""
        return F.from_json(F.lit(self.rank_text()) if text is None else text, "array<map<string,int>>")

    def piece_table(self, text: Column | None = None) -> Column:
        return F.from_json(F.lit(self.piece_text()) if text is None else text, "array<string>")

    def table(self, spark: SparkSession) -> DataFrame:
        """(ranks, pieces): one row that meets others in a broadcast join. As literals they would be printed and kept, megabytes
        each, with every state of a plan, and the driver's heap grows by that."""
        row = spark.createDataFrame([(self.rank_text(), self.piece_text())], "ranks string, pieces string")
        return row.select(self.rank_map(F.col("ranks")).alias("ranks"), self.piece_table(F.col("pieces")).alias("pieces"))


def folded(word: Column, ranks: Column) -> Column:
    """array<int>: token numbers of a word given as a string of byte characters.

    The literal stands in the expression once, bound to a lambda's variable: plans are copied and printed often.
    """
    return F.get(F.transform(F.array(ranks), lambda table: folded_with(word, table)), F.lit(0))


def folded_with(word: Column, ranks: Column) -> Column:
    def rank(piece: Column) -> Column:
        bucket = F.get(ranks, F.pmod(F.xxhash64(piece), F.lit(MAP_BUCKETS)).cast("int"))
        return F.element_at(bucket, piece)

    none = NO_RANK << 16

    def turn(state: Column) -> Column:
        parts = state["parts"]
        pairs = F.transform(parts, lambda x, k: F.coalesce(rank(F.concat(x, F.get(parts, k + 1))), F.lit(NO_RANK))
                            .cast("long") * 65536 + k)

        def merge(best: Column) -> Column:
            at = (best % 65536).cast("int")
            pair = F.array(F.concat(F.get(parts, at), F.get(parts, at + 1)))
            after = F.concat(F.slice(parts, F.lit(1), at), pair, F.slice(parts, at + 3, F.size(parts)))
            ended = best >= none
            return F.struct(F.when(ended, parts).otherwise(after).alias("parts"), ended.alias("done"))

        return F.when(state["done"], state).otherwise(F.get(F.transform(F.array(F.array_min(pairs)), merge), F.lit(0)))

    # a word that is a token is that token, whichever merges lead to it
    whole = F.array(word)
    start = F.struct(F.when(rank(word).isNotNull(), whole).otherwise(F.split(word, "")).alias("parts"), F.lit(False).alias("done"))
    return F.transform(F.aggregate(F.sequence(F.lit(1), F.length(word)), start, lambda s, _: turn(s))["parts"], rank)


def unfolded(ids: Column, pieces: Column) -> Column:
    """binary: the pieces of the token numbers, concatenated."""
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""), "ISO-8859-1")


def counted(docs: DataFrame) -> DataFrame:
    """(word hash, c, bytes) of words that come twice in some batch: the frequent ones are among them."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            counts, pieces = Counter(), {}
            for a, b in slices(offsets):
                part = data[offsets[a]: offsets[b]]
                starts, ends, _ = word_spans(part, offsets[a: b + 1] - offsets[a])
                keys, first, n = np.unique(hashes(part, starts, ends, BYTE_VALUES), return_index=True, return_counts=True)
                some = (n > 1) & ((ends - starts)[first] <= SIDE_BY_SIDE)
                raw = part.tobytes()
                for key, k, c in zip(keys[some].view(np.int64).tolist(), first[some].tolist(), n[some].tolist()):
                    counts[key] += c
                    pieces[key] = raw[starts[k]: ends[k]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64()),
                 pa.array([pieces[k] for k in counts], pa.binary())], ["word", "c", "bytes"])

    return (docs.select("text").mapInArrow(run, "word long, c long, bytes binary").groupBy("word")
            .agg(F.sum("c").alias("c"), F.min("bytes").alias("bytes")))


@dataclass
class Dictionary:
    """Frequent words: lookup by hash, then token numbers as text, how many, and their decoded bytes."""

    lookup: Lookup
    texts: list[bytes]
    sizes: np.ndarray
    decoded: list[bytes]


def id_text(ids) -> bytes:
    return b" ".join([b"%d" % i for i in ids])


def dictionary(docs: DataFrame, ranks: Ranks) -> Dictionary:
    found = stored(counted(docs))
    keys, c = head_words(found, FREQUENT)
    least = int(c.min()) if len(c) else 0
    words = F.struct("word", F.decode("bytes", "ISO-8859-1").alias("text"))
    groups = (found.where(F.col("c") >= least).select(F.pmod("word", F.lit(GROUPS)).alias("part"), words.alias("x"))
              .repartition(64, "part").groupBy("part").agg(F.collect_list("x").alias("words"))
              .crossJoin(F.broadcast(ranks.table(docs.sparkSession))))
    rows = groups.select("pieces", F.transform("words", lambda x: F.struct(
        x["word"].alias("word"), folded_with(x["text"], F.col("ranks")).alias("ids"))).alias("found"))
    kept = stored(rows.select(F.transform("found", lambda x: F.struct(
        x["word"].alias("word"), x["ids"].alias("ids"), unfolded(x["ids"], F.col("pieces")).alias("decoded"))).alias("found")))
    rows = kept.select(F.inline("found")).toArrow()
    discard(found, kept)
    tidy(docs.sparkSession)
    ids = rows.column("ids").to_pylist()
    return Dictionary(Lookup(rows.column("word").to_numpy().view(np.uint64)), [id_text(x) for x in ids],
                      np.array([len(x) for x in ids], np.int64), rows.column("decoded").to_pylist())


def described(docs: DataFrame, path: str) -> DataFrame:
    """docs without text, but with n_tokens, ids_sha256, decoded_sha256 and lossless; columns of these names are replaced."""
    docs = docs.drop(*FOUND)
    spark: SparkSession = docs.sparkSession
    ranks = Ranks(path)
    shared = spark.sparkContext.broadcast((ranks, dictionary(docs, ranks)))

    def run(batches):
        ranks, known = shared.value
        number, piece = ranks.numbers.__getitem__, ranks.pieces.__getitem__
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            rows = []
            for a, b in slices(offsets, 1 << 21):
                part = data[offsets[a]: offsets[b]]
                starts, ends, first = word_spans(part, offsets[a: b + 1] - offsets[a])
                keys = hashes(part, starts, ends, BYTE_VALUES)
                place = known.lookup(keys).astype(np.int64)
                rest = np.flatnonzero(place < 0)
                new, sample, index = np.unique(keys[rest], return_index=True, return_inverse=True)
                raw = part.tobytes()
                ids = ranks.merged([raw[starts[k]: ends[k]] for k in rest[sample].tolist()])
                texts = np.array([*known.texts, *(b" ".join(map(number, x)) for x in ids), b""], object)
                decoded = np.array([*known.decoded, *(b"".join(map(piece, x)) for x in ids), b""], object)
                sizes = np.concatenate([known.sizes, np.array([len(x) for x in ids], np.int64)])
                place[rest] = len(known.texts) + index
                total = np.concatenate([[0], np.cumsum(sizes[place])])[first]
                for i in range(b - a):
                    own = place[first[i]: first[i + 1]]
                    back = b"".join(decoded[own].tolist())
                    rows.append((int(total[i + 1] - total[i]), hashlib.sha256(b" ".join(texts[own].tolist())).hexdigest(),
                                 hashlib.sha256(back).hexdigest(),
                                 back == raw[offsets[a + i] - offsets[a]: offsets[a + i + 1] - offsets[a]]))
            if rows:
                others = batch.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*others.columns, *(pa.array(c) for c in zip(*rows))], [*others.schema.names, *FOUND])

    return docs.mapInArrow(run, extended(docs.drop("text").schema, FOUND))


def encoded_texts(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text with the ranks in the file at `path`, decode the numbers and describe both.

    docs: doc_id long, text string; other columns are ignored; one row per input row, equal texts give equal rows.
    Returns doc_id, n_tokens, ids_sha256 (of the decimal numbers joined by one space), decoded_sha256 (of the decoded
    bytes) and lossless. A null text counts as empty and has no tokens. Texts are processed whole; words of more than
    `SIDE_BY_SIDE` bytes are merged one at a time. An empty table gives an empty result.
    """
    return described(docs.select("doc_id", "text"), path)
