"""Language identification by cross-parsing.

For every language a suffix automaton of labelled sample text recognises all its substrings. A text is parsed from
left to right into longest phrases that occur in the sample; phrases times the logarithm of the sample's size
estimate how many bits the text costs given that language (Ziv and Merhav), and the cheapest language wins.

Automata are stored as complete tables: for each state and symbol the next state and whether a new phrase starts.
Tasks walk many text segments through all languages in step. Texts are parsed whole, in segments of `SEGMENT`
symbols; a phrase ends where a segment does, for every language alike.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.tables import extended, slices, text_bytes
from tracelake.llm.words import LOWER

#: The bounded sample: labelled rows a language, characters of a row, symbols of a language.
SAMPLE_ROWS, ROW_CHARS, SAMPLE_SYMBOLS = 32, 4096, 24_576
SEGMENT = 2048
UNDETERMINED = "und"
#: Texts are rejected that cost so many bits a symbol in the best language, if they have so many symbols.
STRANGE, JUDGED = 6.0, 64
FOUND = {"lang_pred": "string", "score": "double", "bits": "double", "symbols": "long"}

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
SEPARATOR = ~LETTER
SEPARATOR[128:] = False


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with every run of ASCII non-letters as one space, and the offsets of the texts in them."""
    out = LOWER[data]
    if len(out):
        capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
        out[1:][capital] += 32  # accented Latin capitals
    blank = SEPARATOR[out]
    out[blank] = 32
    keep = np.ones(len(out), bool)
    if len(out):
        keep[1:] = ~(blank[1:] & blank[:-1])
        keep[offsets[:-1][offsets[:-1] < len(out)]] = True
    places = np.flatnonzero(keep)
    return out[places], np.searchsorted(places, offsets)


def automaton(codes: bytes, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of symbol codes below `width` (state x symbol, -1 for none); state 0 is the
    root and every state accepts a substring. One flat array of 32-bit numbers holds them while they are built."""
    most = max(1, 2 * len(codes))
    step, none = array("i", [-1]) * (most * width), array("i", [-1])
    link, length, states, last = none * most, array("i", [0]) * most, 1, 0
    for c in codes:
        new, states = states, states + 1
        length[new], link[new] = length[last] + 1, 0
        p = last
        while p >= 0 and step[p * width + c] < 0:
            step[p * width + c] = new
            p = link[p]
        if p >= 0:
            q = step[p * width + c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy, states = states, states + 1
                step[copy * width: (copy + 1) * width] = step[q * width: (q + 1) * width]
                link[copy], length[copy] = link[q], length[p] + 1
                while p >= 0 and step[p * width + c] == q:
                    step[p * width + c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return np.frombuffer(step, np.int32).reshape(most, width)[:states]


@dataclass
class Parser:
    languages: list[str]
    bits: np.ndarray  # a phrase's, by language
    symbol: np.ndarray  # of each byte
    table: np.ndarray  # (next row << 1 | new phrase) by row + symbol
    roots: np.ndarray

    @staticmethod
    def of(samples: dict[str, bytes]) -> Parser:
        """samples: symbols of labelled text by language."""
        languages = sorted(k for k, v in samples.items() if v)
        used = sorted(set().union(*(samples[k] for k in languages))) if languages else []
        symbol = np.full(256, len(used), np.int64)
        symbol[used] = np.arange(len(used))
        width, tables, roots, at = len(used) + 1, [], [], 0
        kind = np.int32 if 4 * width * sum(len(samples[k]) + 1 for k in languages) < 1 << 31 else np.int64
        for k in languages:
            steps = automaton(bytes(symbol[np.frombuffer(samples[k], np.uint8)].astype(np.uint8)), width).astype(kind, copy=False)
            to = (steps * width + at) << 1
            start = np.where(steps[0] >= 0, to[0], at << 1) | 1  # an unknown symbol is a phrase that leads nowhere
            table = np.where(steps >= 0, to, start)
            table[0] = start
            tables.append(table.ravel())
            roots.append(at)
            at += table.size
        return Parser(languages, np.log2([len(samples[k]) + 1 for k in languages]), symbol,
                      np.concatenate(tables) if tables else np.empty(0, kind), np.array(roots, kind))

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases (language x text) of texts given as symbols."""
        lengths = np.diff(offsets)
        parts = -(-lengths // SEGMENT)
        text = np.repeat(np.arange(len(lengths)), parts)
        place = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = offsets[:-1][text] + place * SEGMENT
        size = np.minimum(SEGMENT, offsets[1:][text] - begin)
        by = np.argsort(-size, kind="stable")
        begin, size, text = begin[by], size[by], text[by]
        coded = self.symbol[data].astype(self.table.dtype)
        state = np.repeat(self.roots[:, None], len(by), axis=1)
        found = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for t, k in enumerate(active.tolist()):
            to = self.table[state[:, :k] + coded[begin[:k] + t]]
            found[:, :k] += to & 1
            state[:, :k] = to >> 1
        return np.stack([np.bincount(text, row, len(lengths)) for row in found]) if len(found) else np.zeros((0, len(lengths)))


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    found, high = np.zeros(len(offsets) - 1, bool), np.zeros(len(offsets) - 1, bool)
    if len(full):
        found[full] = np.logical_or.reduceat(LETTER[data], offsets[full])
        high[full] = np.logical_or.reduceat(data >= 128, offsets[full])
    for i in np.flatnonzero(~found & high):
        found[i] = any(map(str.isalpha, data[offsets[i]: offsets[i + 1]].tobytes().decode("utf-8", "ignore")))
    return found


def fitted(docs: DataFrame) -> Parser:
    """Automata from at most `SAMPLE_ROWS` rows a language: short rows first, in the order of a hash of doc_id."""
    rows = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND rlike(text, '\\\\p{L}')").where(
        F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    order = Window.partitionBy("lang").orderBy(F.length("text") > ROW_CHARS, F.xxhash64("doc_id"), "doc_id")
    picked = (rows.select("doc_id", "lang", F.row_number().over(order).alias("place"))
              .where(F.col("place") <= SAMPLE_ROWS).select("doc_id", "lang"))
    texts = (rows.select("doc_id", "lang", F.substring("text", 1, ROW_CHARS).alias("text"))
             .join(F.broadcast(picked.distinct()), ["doc_id", "lang"]).distinct().collect())
    samples: dict[str, bytes] = {}
    for row in sorted(texts, key=lambda r: (r.lang, r.doc_id, r.text)):
        data, offsets = text_bytes(pa.array([row.text + " "]))
        samples[row.lang] = (samples.get(row.lang, b"") + symbols(data, offsets)[0].tobytes())[:SAMPLE_SYMBOLS]
    return Parser.of(samples)


def identified(docs: DataFrame, parser: Parser) -> DataFrame:
    """docs (text and other columns) with lang_pred, score, bits (a symbol's cost in the language found) and symbols;
    columns of these names are replaced. A null or empty text and one without letters is undetermined; repeated rows get equal
    results; an empty table gives an empty result."""
    docs = docs.drop(*FOUND)
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches):
        p = shared.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            pred, score, bits, size = [], [], [], []
            for a, b in slices(offsets, 2 << 20):
                part, ends = raw[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]
                known = has_letter(part, ends) & bool(p.languages)
                data, at = symbols(part, ends)
                cost = p.phrases(data, at) * p.bits[:, None]
                if not len(cost):
                    cost = np.zeros((1, b - a))
                first = cost.argmin(axis=0)
                least = cost[first, np.arange(b - a)]
                rest = cost.copy()
                rest[first, np.arange(b - a)] = np.inf
                second = rest.min(axis=0)
                with np.errstate(all="ignore"):
                    margin = np.where(second > 0, 1 - least / second, 0.0)
                pred += [p.languages[k] if ok else UNDETERMINED for k, ok in zip(first.tolist(), known.tolist())]
                score.append(np.where(known, margin, 0.0))
                bits.append(np.where(known, least / np.maximum(np.diff(at), 1), 0.0))
                size.append(np.diff(at))
            found = [pa.array(pred, pa.string()),
                     *(pa.array(np.concatenate(x) if x else [], t) for x, t in
                       ((score, pa.float64()), (bits, pa.float64()), (size, pa.int64())))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *FOUND])

    return docs.mapInArrow(run, extended(docs.schema, FOUND))


def languages(docs: DataFrame) -> DataFrame:
    """Predicted language of every document.

    docs: doc_id long, text string, lang string; other columns are ignored. Learns from text and lang of documents
    whose crc32(doc_id as text) mod 3 is not 1 (rows without doc_id, lang or letters teach nothing). Returns a row per
    input row: doc_id, held_out, lang_pred, score (0 to 1: by how much the best language beats the next), bits
    (cost of a symbol) and symbols. lang_pred is `und`, with score 0, if text is null or has no letter or nothing was
    learnt; ties go to the first name. Equal texts get equal results. Texts are parsed whole, however long. An empty
    table gives an empty result.
    """
    parser = fitted(docs.select("doc_id", "text", "lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return identified(docs.select("doc_id", held.alias("held_out"), "text"), parser).drop("text")


def in_known_language(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose language is determined and whose text looks like it.

    Rejected are texts that are null or have no letter, and texts of `JUDGED` symbols or more that cost `STRANGE` bits
    a symbol or more in every language learnt: more than evenly drawn letters would. Shorter texts are never rejected as
    strange, because their cost says too little. Repeated rows are judged alike, whole texts however long; an empty table
    stays empty.
    """
    renamed = docs.withColumnsRenamed({c: f"column_{i}" for i, c in enumerate(docs.columns) if c != "text"})
    found = identified(renamed, fitted(docs.select("doc_id", "text", "lang")))
    strange = (F.col("bits") >= STRANGE) & (F.col("symbols") >= JUDGED)
    return found.where((F.col("lang_pred") != UNDETERMINED) & ~strange).drop(*FOUND).toDF(*docs.columns)
