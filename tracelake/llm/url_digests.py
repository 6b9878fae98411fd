"""URL filter on a sorted array of digests.

Rules such as `example.net/en/` (a host with all its subdomains, and the start of a path) are kept as a sorted array
of 64-bit xxhash digests with their full strings beside it, in files by ranges of digests that every executor maps into memory. For a
URL all host suffixes with all path starts of a length that rules have are hashed and looked up together by binary
search; a hit counts once the stored string equals the one asked for.
"""

from __future__ import annotations

import io
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.session import ensure_checkpoint_dir

#: Bytes of rules in one file; more rules are cut into several files by their digests.
FILE_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def digests(texts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))


def files(rules: list[tuple[str, str]], most: int = FILE_BYTES) -> list[bytes]:
    """Files for (verdict, rule) pairs, of about `most` bytes each; of equal rules the last one holds. Files are cut
    by the sorted digests, equal digests stay together."""
    last = {rule.encode(): verdict == "block" for verdict, rule in rules}
    texts = list(last)
    keys = digests(texts)
    by = np.argsort(keys, kind="stable")
    keys, texts = keys[by], [texts[i] for i in by]
    sizes = np.cumsum([0, *(len(t) + 17 for t in texts)])
    out, a = [], 0
    while a < len(texts) or not out:
        b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + most, "right")) - 1)
        while b < len(texts) and keys[b] == keys[b - 1]:
            b += 1
        out.append(packed(keys[a:b], texts[a:b], last))
        a = b
    return out


def packed(keys: np.ndarray, texts: list[bytes], last: dict[bytes, bool]) -> bytes:
    """One file of rules in the order of their digests."""
    ends = np.cumsum([0, *map(len, texts)], dtype=np.int64)
    block = np.array([last[t] for t in texts], np.uint8)
    lengths = np.array(sorted({len(t) - (t + b"/").index(b"/") for t in texts}), np.int64)
    out = io.BytesIO()
    out.write(struct.pack("<qq", len(texts), len(lengths)))
    for part in (keys, ends, lengths, block):
        out.write(part.tobytes())
    out.write(b"".join(texts))
    return out.getvalue()


class Part:
    """A file of `packed`, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, lengths = struct.unpack("<qq", raw[:16].tobytes())
        at = 16
        self.keys = raw[at: at + 8 * n].view(np.uint64)
        self.ends = raw[at + 8 * n: at + 16 * n + 8].view(np.int64)
        at += 16 * n + 8
        self.lengths = raw[at: at + 8 * lengths].view(np.int64).tolist()
        self.block = raw[at + 8 * lengths: at + 8 * lengths + n]
        self.text = raw[at + 8 * lengths + n:]

    def found(self, texts: list[bytes]) -> list[int]:
        """Place of each text among the rules, -1 where it is none."""
        keys = digests(texts)
        first = np.searchsorted(self.keys, keys)
        out = [-1] * len(texts)
        hit = np.flatnonzero((first < len(self.keys)) & (self.keys[np.minimum(first, max(len(self.keys) - 1, 0))] == keys)
                             if len(self.keys) else np.zeros(len(keys), bool))
        for i in hit.tolist():
            k = int(first[i])
            while k < len(self.keys) and self.keys[k] == keys[i]:  # equal digests lie side by side
                if self.text[self.ends[k]: self.ends[k + 1]].tobytes() == texts[i]:
                    out[i] = k
                    break
                k += 1
        return out


class Rules:
    """All files of a set of rules."""

    def __init__(self, paths: list[str]):
        self.parts = [Part(path) for path in paths]
        self.lengths = sorted({n for part in self.parts for n in part.lengths})

    def longest(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """(rule, verdict) of the longest rule that fits each host and path; the longer host wins between equals."""
        asked, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            host, path = host.encode(), path.encode()
            starts = [path[:n] for n in self.lengths if n <= len(path)]
            at = 0
            while host and at >= 0:
                suffix = host[at:]
                asked += [suffix + start for start in starts]
                owner += [i] * len(starts)
                at = host.find(b".", at) + 1 or -1
        best: list[tuple | None] = [None] * len(hosts)
        for part in self.parts:
            for i, text, k in zip(owner, asked, part.found(asked)):
                if k >= 0:
                    size = (len(text), (text + b"/").index(b"/"))
                    if best[i] is None or size > best[i][0]:
                        best[i] = (size, text.decode(), "block" if part.block[k] else "allow")
        return [b and b[1:] for b in best]


@lru_cache(8)
def opened(names: tuple[str, ...]) -> Rules:
    return Rules([SparkFiles.get(name) for name in names])


def shipped(spark: SparkSession, rules: list[tuple[str, str]], most: int = FILE_BYTES) -> tuple[str, ...]:
    """Write the rules beside the checkpoints and have Spark copy the files to every executor; their names."""
    ensure_checkpoint_dir(spark)
    context, names = spark.sparkContext, []
    for data in files(rules, most):
        names.append(f"rules-{uuid.uuid4().hex}")
        path = context._jvm.org.apache.hadoop.fs.Path(f"{context.getCheckpointDir()}/{names[-1]}")
        out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
        try:
            out.write(data)
        finally:
            out.close()
        context.addFile(path.toString())
    return tuple(names)


def judged(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", most: int = FILE_BYTES) -> DataFrame:
    """The longest rule that fits each URL, and its verdict.

    pages: page_id long, url string; other columns are ignored; one row per input row. rules: (`block` or `allow`,
    host followed by the start of a path). Returns page_id, host, path, rule, verdict. The host lies between the first
    `://` and the next `/`, `?` or `#`, with A-Z lower-cased; the path reaches up to `?` or `#`. Both are empty if the
    url is null or has no `://`. Without a rule that fits, rule is null and verdict is `default`. Repeated urls get
    equal results; an empty table gives an empty result.
    """
    names = shipped(pages.sparkSession, rules, most)
    part = lambda k: F.coalesce(F.regexp_extract("url", AFTER_SCHEME, k), F.lit(""))
    split = pages.select("page_id", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))

    def run(batches):
        book = opened(names)
        for batch in batches:
            found = book.longest(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path")),
                 pa.array([f[0] if f else None for f in found], pa.string()),
                 pa.array([f[1] if f else default for f in found], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"])

    return split.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
