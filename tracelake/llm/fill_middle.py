"""Fill-in-the-middle transformation of texts: two cuts a text, found by SWAR words over its UTF-8 bytes.

A unit is a code point. The bytes of a batch are viewed as uint64 words; arithmetic on whole words marks the last byte
of every unit, bitwise_count gives the units a word ends, and their running sum is searched for the word that holds a
wanted unit. Inside that word a multiplication yields the marks up to each byte, and a comparison of all eight at once
selects the byte. No text is decoded, and a cut costs a binary search however long the text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.tables import slices, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, per cent of these that get the suffix first, and what draws are seeded by.
TRANSFORMED, SUFFIX_FIRST, SEED = 90, 20, 1
ONES, HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
PLAIN, PSM, SPM = 0, 1, 2


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For UTF-8 texts end to end (offsets[0] is 0): words with bit 8 * i set where byte i ends a unit, and the number of
    units that end before each word. A text's last byte ends a unit even if the bytes after it continue one."""
    padded = np.zeros(len(data) // 8 * 8 + 16, np.uint8)
    padded[: len(data)] = data
    words = padded.view("<u8")
    starts = ~((words >> np.uint64(7)) & ~(words >> np.uint64(6))) & ONES
    ends = (starts >> np.uint64(8))[:-1] | ((starts[1:] & np.uint64(1)) << np.uint64(56))
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    np.bitwise_or.at(ends, last >> 3, np.uint64(1) << ((last & 7) << 3).astype(np.uint64))
    if rest := len(data) & 7:  # the padding ends nothing
        ends[-1] &= np.uint64((1 << (8 * rest)) - 1)
    else:
        ends[-1] = 0
    return ends, np.concatenate([[0], np.cumsum(np.bitwise_count(ends), dtype=np.int64)])


def units_before(ends: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Units that end before byte `at`."""
    word, bit = at >> 3, ((at & 7) << 3).astype(np.uint64)
    return before[word] + np.bitwise_count(ends[word] & ((np.uint64(1) << bit) - np.uint64(1)))


def byte_after(ends: np.ndarray, before: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The place after the unit of this number (from 1); 0 for number 0."""
    unit = np.asarray(unit, np.int64)
    word = np.maximum(np.searchsorted(before, unit, "left") - 1, 0)
    rank = (unit - before[word]).astype(np.uint64)
    upto = ends[word] * ONES  # byte i: marks in bytes 0 to i, 8 at most
    reached = ((upto | HIGH) - rank * ONES) & HIGH
    inside = 8 - np.bitwise_count(reached).astype(np.int64)
    return np.where(unit > 0, word * 8 + inside + 1, 0)


def draw(name: str, seed: int, place: int) -> Column:
    """Group number `place` (from 0) of eight hex digits of the sha256 of `seed:id`, as a number; a null id is empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 8 * place + 1, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, transformed_share: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST,
                seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of docs.

    docs: doc_id long, text string; other columns are ignored. n is the number of code points. Draws come from a
    sha256 of seed and doc_id, so that they don't depend on partitions or order: two cuts between 0 and n, and the form.
    form is plain (output is the text) if the text is null, empty, holds a marker or isn't drawn, else psm (prefix, suffix,
    middle) or spm (suffix, prefix, middle), each part after its marker. Parts may be empty. prefix_chars and
    middle_chars count code points and are null for plain. output is the text as binary UTF-8. A null text
    gives an empty output; rows that repeat a doc_id get the same cuts if their texts are equally long; a null doc_id
    draws as an empty id. Texts are taken whole, however long, one at a time where they are over 1 MB. An empty table
    gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = (F.when((text == "") | marked | (draw("doc_id", seed, 2) % 100 >= transformed_share), PLAIN)
            .when(draw("doc_id", seed, 3) % 100 < suffix_first, SPM).otherwise(PSM))
    rows = docs.select("doc_id", text.alias("text"), draw("doc_id", seed, 0).alias("a"), draw("doc_id", seed, 1).alias("b"),
                       form.alias("form"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    names = pa.array(["plain", "psm", "spm"])

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            draws = [batch.column(c).to_numpy() for c in ("a", "b")]
            forms = batch.column("form").to_numpy()
            for i, j in slices(offsets):
                at = offsets[i: j + 1] - offsets[i]
                part = data[offsets[i]: offsets[j]]
                ends, before = unit_ends(part, at)
                first = units_before(ends, before, at)
                n = np.diff(first)
                one, two = (d[i:j] % (n + 1) for d in draws)
                low, high = np.minimum(one, two), np.maximum(one, two)
                cuts = [np.where(k > 0, byte_after(ends, before, first[:-1] + k), at[:-1]) for k in (low, high)]
                raw, out = part.tobytes(), []
                for kind, a, x, y, b in zip(forms[i:j].tolist(), at[:-1].tolist(), *(c.tolist() for c in cuts), at[1:].tolist()):
                    prefix, middle, suffix = marks[0] + raw[a:x], marks[2] + raw[x:y], marks[1] + raw[y:b]
                    out.append(raw[a:b] if kind == PLAIN else
                               prefix + suffix + middle if kind == PSM else suffix + prefix + middle)
                plain = forms[i:j] == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n), names.take(pa.array(forms[i:j])),
                     pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(out, pa.binary())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text (string) rebuilt from an output of `transformed` and its form alone.

    Parts hold no marker, and none can arise where a part meets a marker, so the first three markers are those put in.
    """
    text = F.col(output).cast("string")
    part = F.split(text, "<[PSM]>", 4)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    rebuilt = F.when(F.col(form) == "plain", text)
    for name, places in order.items():
        rebuilt = rebuilt.when(F.col(form) == name, F.concat(*(F.get(part, F.lit(k)) for k in places)))
    return rebuilt


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 (lowercase hex) of each row."""
    return transformed(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                                    F.sha2("output", 256).alias("output_sha256"),
                                    F.sha2(restored(), 256).alias("restored_sha256"))
