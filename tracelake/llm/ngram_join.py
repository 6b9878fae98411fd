"""Jaccard self-join of documents on their word n-grams, and the groups it links.

Only documents of similar size can link, so sizes are cut into bands. Inside a band the shingles of a document are
dealt by hash range into more groups than two linked sets can differ in elements; linked sets therefore agree in one
whole group at least, and the hash of a group (with band and number) names a tile. Tiles hold documents that share
a tenth of an average set element for element, which unrelated texts with a common passage do not.

Inside a tile, documents carry parity bitmaps of their hashed shingles. The number of differing bits is at most the
size of the symmetric difference, so it bounds the overlap from above; pairs that pass are decided on the exact
sorted arrays. In a few turns one document of each component of a tile meets a pivot, the first time every document. Then the
pairs of a tile from different components whose bitmaps allow a link are listed once and decided in slices of bounded size;
components only grow meanwhile, so no other pair can matter, and pairs that have come into one component are left out. Groups
of copies thus cost time in proportion to their members, and no link between components is lost.

One pass over the texts yields sizes, tiles and bitmaps; sorted arrays are made from the texts of those documents alone
that are in a pair to be decided.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tracelake.llm.tables import components, discard, extended, slices, stored, stored_counting, text_bytes, tidy
from tracelake.llm.words import mix, shingle_hashes

#: Rows of one side of a tile that meet in one step; larger tiles are dealt into several.
BLOCK_ROWS, OTHER_ROWS = 512, 4096
#: Turns that test one pair per document, and pairs a set that one slice of the remaining ones holds on average.
SINGLE_TURNS, PAIRS_A_SET = 1, 2
#: Turns in which components of a tile meet by one document each, before pairs are listed.
PIVOT_TURNS = 3
FILTER_BITS = 1 << 22
#: Bands of more groups work out anew where these begin.
KNOWN_GROUPS = 1 << 14
#: Keys that a range of them holds on average, and how many more a task holds before it lets go of tiles.
RANGE_KEYS, HELD_KEYS = 1 << 20, 1 << 22


class Sizes:
    """Size bands and numbers of groups for a threshold of `part` / `whole`.

    |A n B| >= (part / whole) |A u B| means |A ^ B| <= (|A| + |B|) (whole - part) / (whole + part).
    """

    def __init__(self, part: int, whole: int, largest: int = 1 << 40):
        self.part, self.whole = part, whole
        edges = [1]
        while edges[-1] < largest:
            edges.append(max(edges[-1] + 1, -(-edges[-1] * 4 // 3)))
        self.edges = np.array(edges, np.int64)
        top = self.edges[1:] - 1
        differ = (top + top * whole // part) * (whole - part) // (whole + part)
        self.differ = differ
        self.groups = differ + 1 + np.maximum(2, differ // 10)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def cut(self, band: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the groups of a band begin, but for the first, and a number for each group's name; kept while it is small."""
        if band in self.known:
            return self.known[band]
        k = int(self.groups[band])
        found = (np.arange(1, k, dtype=np.uint64) * np.uint64((1 << 64) // k),
                 mix(np.arange(k, dtype=np.uint64) + np.uint64((band + 1) << 32)))
        if k <= KNOWN_GROUPS:
            self.known[band] = found
        return found

    def bands(self, n: int) -> range:
        """Bands of the smallest partner up to the own one."""
        least = -(-n * self.part // self.whole)
        a, b = np.searchsorted(self.edges, [least, n], "right") - 1
        return range(int(a), int(b) + 1)

    def enough(self, both: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.whole * both >= self.part * (sizes - both)


def tile_keys(shingles: np.ndarray, mixed: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Names of the tiles of one set. mixed: mix(shingles).

    A set with fewer filled groups than needed also names its empty groups: two such sets may agree in those alone.
    """
    out, sums = [], np.zeros(len(mixed) + 1, np.uint64)
    np.cumsum(mixed, dtype=np.uint64, out=sums[1:])
    for band in sizes.bands(len(shingles)):
        begins, numbers = sizes.cut(band)
        at = np.empty(len(numbers) + 1, np.int64)
        at[0], at[1:-1], at[-1] = 0, np.searchsorted(shingles, begins), len(shingles)
        reached = sums[at]
        names = mix((reached[1:] - reached[:-1]) ^ numbers)
        filled = at[1:] > at[:-1]
        out.append(names[filled] if np.count_nonzero(filled) > sizes.differ[band] else names)
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def set_id(shingles: np.ndarray) -> int:
    """64-bit digest of a set."""
    total = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(shingles))]))[0].view(np.int64))


def bitmap(mixed: np.ndarray) -> np.ndarray:
    """Parity bitmap of two bits a shingle or more, as 64-bit words; halves can be folded onto each other by xor.
    mixed: mix(shingles)."""
    bits = 1 << max(8, int(2 * len(mixed) - 1).bit_length())
    flags = np.bincount((mixed & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1
    return np.packbits(flags.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def sets_of(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(batch.column("text"))
    for a, b in slices(offsets):
        yield from shingle_hashes(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], size)


def document_sets(docs: DataFrame, size: int, sizes: Sizes) -> DataFrame:
    """(doc_id, n_shingles, set_id, keys, bits) of every document; set_id is null without words."""

    def run(batches):
        for batch in batches:
            n, ids, lengths, keys, bits = [], [], [0], [], []
            for found in sets_of(batch, size):
                mixed = mix(found)
                n.append(len(found))
                ids.append(set_id(found) if len(found) else None)
                keys.append(tile_keys(found, mixed, sizes) if len(found) else np.empty(0, np.int64))
                lengths.append(len(keys[-1]))
                bits.append(bitmap(mixed).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()),
                                          pa.array(np.concatenate(keys) if keys else [], pa.int64())),
                 pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "set_id", "keys", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_id long, keys array<long>, bits binary")


def bit_filter(slots: DataFrame):
    """A broadcast of FILTER_BITS bits, packed, of which those that `slots` (slot) names are set."""
    words = (slots.groupBy(F.expr("slot div 32").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot % 32 AS INT))")).alias("bits")).collect())
    flags = np.zeros(FILTER_BITS // 32, np.int64)
    for word, bits in words:
        flags[word] = bits
    return slots.sparkSession.sparkContext.broadcast(flags.astype(np.uint32).view(np.uint8))


def dealt_keys(found: DataFrame, parts: int) -> DataFrame:
    """(part, pairs): the keys of all sets by ranges of the key, as runs of pairs of 64-bit numbers (key, set_id).

    found: (set_id, keys). Of a batch's equal sets one is told."""

    def run(batches):
        for batch in batches:
            ids, first = np.unique(batch.column("set_id").to_numpy(), return_index=True)
            lists = batch.column("keys").take(pa.array(first))
            keys, ids = lists.flatten().to_numpy().view(np.uint64), np.repeat(ids, np.diff(lists.offsets.to_numpy()))
            for a in range(0, len(keys), HELD_KEYS):
                key = keys[a: a + HELD_KEYS]
                order = np.argsort(key)
                pairs = np.stack([key[order], ids[a: a + HELD_KEYS][order].view(np.uint64)], axis=1)
                part = ((pairs[:, 0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
                runs = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 16).astype(np.int32)), pa.py_buffer(pairs)])
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), runs], ["part", "pairs"])

    return found.select("set_id", "keys").mapInArrow(run, "part long, pairs binary")


def several(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, set_ids) of the keys that at least two sets have, each pair once and in order, and the pairs of the other keys."""
    pairs = pairs[np.argsort(pairs[:, 0])]
    same = pairs[1:, 0] == pairs[:-1, 0]
    some = np.zeros(len(pairs), bool)
    some[1:] = same
    some[:-1] |= same
    key, ids = pairs[some].T
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, ids = key[new], ids[new]
    same, shared = key[1:] == key[:-1], np.zeros(len(key), bool)
    shared[1:] = same
    shared[:-1] |= same
    alone = np.concatenate([pairs[~some], np.stack([key[~shared], ids[~shared]], axis=1)])
    return key[shared], ids[shared], alone


def shared_tiles(found: DataFrame, n_keys: int) -> DataFrame:
    """(key, set_id) of the tiles that two sets at least are in, a stored table. found: (doc_id, set_id, keys), with about
    n_keys keys.

    Keys meet by ranges, as packed runs that numpy sorts. Tiles of the same sets allow the same pairs: they are named by a
    digest of their sets and kept once. What a range holds is bounded: beyond `HELD_KEYS` the tiles found so far leave under
    their own key, and later sets of theirs follow them.
    """
    usable = found.where("set_id IS NOT NULL AND doc_id IS NOT NULL")

    def rows(key: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(key), HELD_KEYS):
            yield pa.RecordBatch.from_arrays([pa.array(x[a: a + HELD_KEYS].view(np.int64)) for x in (key, ids)], ["key", "set_id"])

    def named(key: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.concatenate([starts, [len(key)]]))
        name, first = np.unique(mix(np.add.reduceat(mix(ids), starts) + n.astype(np.uint64)), return_index=True)
        n, starts = n[first], starts[first]
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        yield from rows(np.repeat(name, n), ids[at])

    def run(batches):
        part, held, many, most, left = None, [], 0, HELD_KEYS, np.empty(0, np.uint64)

        def leave(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, many, most, left
            pairs = np.concatenate(held) if held else np.empty((0, 2), np.uint64)
            gone = np.isin(pairs[:, 0], left) if len(left) else np.zeros(len(pairs), bool)
            yield from rows(*np.ascontiguousarray(pairs[gone].T))
            key, ids, alone = several(pairs[~gone])
            yield from named(key, ids) if last else rows(key, ids)
            left = np.empty(0, np.uint64) if last else np.concatenate([left, np.unique(key)])
            held, many = ([], 0) if last else ([alone], len(alone))
            most = many + HELD_KEYS

        for batch in batches:
            for p, x in zip(batch.column("part").to_pylist(), batch.column("pairs")):
                if p != part or many > most:
                    yield from leave(p != part)
                part = p
                held.append(np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 2).copy())
                many += len(held[-1])
        yield from leave(True)

    dealt = dealt_keys(usable, max(1, n_keys // RANGE_KEYS)).repartition("part").sortWithinPartitions("part")
    out = stored(dealt.mapInArrow(run, "key long, set_id long").distinct())
    tidy(found.sparkSession)
    return out


def exact_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set_id, shingles) for the sets `wanted` (doc_id, set_id) names, a stored table.

    A fixed-size bit filter of the wanted ids keeps most other texts from being moved or read twice.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    shared = bit_filter(wanted.select(slot.alias("slot")))

    def near(batches):
        mask = np.unpackbits(shared.value, bitorder="little").astype(bool)
        for batch in batches:
            at = batch.column("slot").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(mask[at])).select(["doc_id", "text"])

    def run(batches):
        for batch in batches:
            ids, wants, raw = batch.column("set_id").to_pylist(), [], []
            for want, found in zip(ids, sets_of(batch, size)):
                if len(found) and set_id(found) == want:
                    wants.append(want)
                    raw.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(wants, pa.int64()), pa.array(raw, pa.binary())], ["set_id", "shingles"])

    some = (docs.where("doc_id IS NOT NULL").select("doc_id", "text", slot.alias("slot"))
            .mapInArrow(near, "doc_id long, text string"))
    out = stored(some.join(wanted, "doc_id").mapInArrow(run, "set_id long, shingles binary").dropDuplicates(["set_id"]))
    shared.destroy()
    return out


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = min(a.shape[-1], b.shape[-1])
    return np.bitwise_count(folded(a, width) ^ folded(b, width)).sum(axis=-1, dtype=np.int64)


def bounded(pairs: DataFrame, sets: DataFrame, sizes: Sizes) -> DataFrame:
    """(a, b, most): pairs whose bitmaps allow the threshold, with the largest overlap these allow."""
    light = sets.select("set_id", "n", "bits")
    wide = (pairs.join(light.toDF("a", "na", "bits_a"), "a").join(light.toDF("b", "nb", "bits_b"), "b"))

    def run(batches):
        for batch in batches:
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            differ = np.array([differing(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                               for x, y in zip(batch.column("bits_a"), batch.column("bits_b"))], np.int64)
            most = (n - differ) // 2
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(most)], ["a", "b", "most"])
            yield out.filter(pa.array(sizes.enough(most, n)))

    return wide.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(run, "a long, b long, most long")


def decided(pairs: DataFrame, sets: DataFrame, sizes: Sizes) -> DataFrame:
    """(a, b, linked) by the exact intersection of the sorted arrays."""
    full = sets.select("set_id", "shingles")
    wide = pairs.select("a", "b").join(full.toDF("a", "left"), "a").join(full.toDF("b", "right"), "b")

    def run(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                linked.append(bool(sizes.enough(both, len(x) + len(y))))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())],
                                             ["a", "b", "linked"])

    return wide.mapInArrow(run, "a long, b long, linked boolean")


def open_pairs(tiles: DataFrame, sets: DataFrame, labels: DataFrame, sizes: Sizes) -> DataFrame:
    """(a, b, most): all pairs of a tile from different components whose bitmaps allow the threshold, each once.

    Rows outside a tile's largest component meet all others, in steps of bounded size.
    """
    rows = tiles.join(labels, "set_id", "left").select("key", "set_id", F.coalesce("label", "set_id").alias("label"))
    parts = rows.groupBy("key", "label").count()
    mixed = (parts.groupBy("key")
             .agg(F.max_by("label", F.struct("count", "label")).alias("major"), F.sum("count").alias("total"),
                  F.max("count").alias("most"), F.count("*").alias("parts")).where("parts > 1")
             .select("key", "major", F.ceil((F.col("total") - F.col("most")) / BLOCK_ROWS).cast("int").alias("nb"),
                     F.ceil(F.col("total") / OTHER_ROWS).cast("int").alias("ns")))
    rows = rows.join(mixed, "key").withColumn("outside", F.col("label") != F.col("major"))
    i, s = F.pmod(F.hash("set_id"), "nb"), F.pmod(F.xxhash64("set_id", "key"), F.col("ns").cast("long")).cast("int")
    asking = (rows.where("outside").withColumn("i", i)
              .withColumn("s", F.explode(F.sequence(F.lit(0), F.col("ns") - 1))).withColumn("asks", F.lit(True)))
    asked = (rows.withColumn("s", s).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .withColumn("asks", F.lit(False)))
    columns = ["key", "i", "s", "asks", "outside", "set_id", "label"]
    wide = (asking.select(*columns).unionByName(asked.select(*columns))
            .join(sets.select("set_id", "n", "bits"), "set_id")
            .repartition("key", "i", "s").sortWithinPartitions("key", "i", "s"))

    def meet(group: dict[str, list]) -> Iterator[tuple]:
        asks = np.array(group["asks"], bool)
        if asks.all() or not asks.any():
            return
        n, ids, label = (np.array(group[c], np.int64) for c in ("n", "set_id", "label"))
        width = min(len(b) for b in group["bits"]) // 8
        bits = np.stack([folded(np.frombuffer(b, np.uint64), width) for b in group["bits"]])
        others = np.flatnonzero(~asks)
        outside = np.array(group["outside"], bool)
        for q in np.flatnonzero(asks):
            total = n[q] + n[others]
            most = (total - np.bitwise_count(bits[q] ^ bits[others]).sum(axis=1, dtype=np.int64)) // 2
            for k in np.flatnonzero((label[others] != label[q]) & sizes.enough(most, total)):
                x, y = int(ids[q]), int(ids[others[k]])
                if not outside[others[k]] or x < y:  # of two rows that both ask, the smaller asks
                    yield min(x, y), max(x, y), int(most[k])

    def run(batches):
        held, at = None, None
        names = ["key", "i", "s", "asks", "outside", "set_id", "label", "n", "bits"]

        def out(rows):
            found = list(rows)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b", "most"])

        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in names}
            groups = list(zip(columns["key"], columns["i"], columns["s"]))
            cuts = [0, *(k for k in range(1, len(groups)) if groups[k] != groups[k - 1]), len(groups)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if groups[a] != at:
                    if held:
                        yield from out(meet(held))
                    held, at = {c: [] for c in names}, groups[a]
                for c in names:
                    held[c] += columns[c][a:b]
        if held:
            yield from out(meet(held))

    return (wide.select("key", "i", "s", "asks", "outside", "set_id", "label", "n", "bits")
            .mapInArrow(run, "a long, b long, most long").groupBy("a", "b").agg(F.min("most").alias("most")))


def pivot_pairs(tiles: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """(a, b): in every tile, one set of each component with one of the component that has most of the tile."""
    rows = tiles.join(labels, "set_id", "left").select("key", "set_id", F.coalesce("label", "set_id").alias("label"))
    parts = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.min_by("set_id", F.xxhash64("set_id", F.lit(turn))).alias("a"))
    most = (parts.groupBy("key").agg(F.max_by(F.struct("label", "a"), F.struct("n", "label")).alias("most"), F.count("*").alias("parts"))
            .where("parts > 1").select("key", F.col("most.label").alias("major"), F.col("most.a").alias("b")))
    return parts.join(most, "key").where("label <> major").select("a", "b").distinct()


def best(pairs: DataFrame) -> DataFrame:
    """For each left id the pair that promises the largest overlap."""
    return pairs.groupBy("a").agg(F.max_by("b", F.struct("most", "b")).alias("b"))


def grouped(docs: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    """The rows of `jaccard_groups` with the group as the smallest of its set_ids too; a stored table."""
    spark, sizes = docs.sparkSession, Sizes(part, whole)
    seen = Observation()
    found = stored(document_sets(docs, size, sizes).observe(seen, F.sum(F.size("keys")).alias("n")))
    tiles = shared_tiles(found, seen.get.get("n") or 0)
    usable = found.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    sets, n_sets = stored_counting(usable.select("set_id", "doc_id", F.col("n_shingles").alias("n"), "bits").dropDuplicates(["set_id"]))
    own = stored(found.select("doc_id", "n_shingles", "set_id"))
    discard(found)
    usable = own.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    tidy(spark)

    def exact(pairs: DataFrame) -> DataFrame:
        named = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
        return exact_sets(docs, sets.select("set_id", "doc_id").join(named, "set_id"), size)

    # a turn without a pair or without a link changes nothing: what would follow it is left out, as the driver keeps each query's plan
    nothing = spark.range(1).where("false")
    found = nothing.select(F.col("id").alias("a"), F.col("id").alias("label"))
    tested, tried = nothing.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(True).alias("linked")), []
    for turn in range(PIVOT_TURNS):
        first, n = stored_counting(best(bounded(pivot_pairs(tiles, found.withColumnRenamed("a", "set_id"), turn), sets, sizes)))
        tidy(spark)
        if not n:
            discard(first)
            continue
        arrays = exact(first)
        now, n = stored_counting(decided(first, arrays, sizes), F.col("linked"))
        discard(first, arrays)
        tried.append(now)
        if n:
            discard(found)
            tested = tested.unionByName(now.where("linked")) if len(tried) > 1 else now.where("linked")
            found = components(tested, "a", "b", "label")
        tidy(spark)
    left = open_pairs(tiles, sets, found.withColumnRenamed("a", "set_id"), sizes)
    if tried:
        known = reduce(DataFrame.unionByName, tried).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        left = left.join(known, ["a", "b"], "left_anti")
    left, n_left = stored_counting(left)
    discard(tiles)
    tidy(spark)
    arrays, slices_ = exact(left) if n_left else left, max(1, -(-n_left // max(1, PAIRS_A_SET * n_sets)))
    for turn in range(SINGLE_TURNS + slices_ if n_left else 0):
        labels = found.withColumnRenamed("a", "set_id")
        apart = lambda side: labels.select(F.col("set_id").alias(side), F.col("label").alias(f"label_{side}"))
        still = left.join(apart("a"), "a", "left").join(apart("b"), "b", "left").where(
            F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b", "most")
        more = best(still) if turn < SINGLE_TURNS else still.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices_)) == turn - SINGLE_TURNS)
        now, n = stored_counting(decided(more, arrays, sizes).where("linked"))
        if not n:
            discard(now)
            if turn < SINGLE_TURNS and still.isEmpty():
                break
            continue
        before, tested = tested, stored(tested.unionByName(now))
        discard(before, now, found)
        found = components(tested, "a", "b", "label")
        tidy(spark)
    labels = found.withColumnRenamed("a", "set_id")
    discard(sets, tested, left, arrays, *tried)

    groups = (usable.groupBy("set_id").agg(F.min("doc_id").alias("least"))
              .join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id")))
    least = groups.groupBy("label").agg(F.min("least").alias("smallest"))
    named = groups.join(least, "label").select("set_id", "label", "smallest")
    out = stored(own.join(named, "set_id", "left")
                 .select("doc_id", "n_shingles", "set_id", "label",
                         F.when(F.col("doc_id").isNotNull(), F.coalesce("smallest", "doc_id")).alias("component_id")))
    discard(own, found)
    return out

def jaccard_groups(docs: DataFrame, size: int = 3, part: int = 90, whole: int = 100) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of word shingles of `part` / `whole` or more.

    docs: doc_id long, text string; other columns are ignored. Returns one row per input row: doc_id,
    n_shingles (size of its set), set_id (the same for equal sets) and component_id, the smallest doc_id reachable by
    links. Texts that are null, empty or blank have no set and are their own component, as have rows without
    doc_id (component_id null). Shorter texts than a shingle are one shingle. Rows that repeat a doc_id count as
    documents of their own. Texts are compared whole, however long. An empty table gives an empty result.
    """
    return grouped(docs, size, part, whole).drop("label")


def first_of_groups(docs: DataFrame, size: int = 3, part: int = 90, whole: int = 100) -> DataFrame:
    """One row of each group of linked rows of docs, with all its columns: that with the smallest doc_id.

    Links are those of jaccard_groups: shingles of `size` words and a similarity of `part` / `whole` or more. A group's
    rows that repeat its smallest doc_id are told apart by their set, then by a hash of all their columns; the smallest
    stays. Rows without words are groups of their own, but equal ones with the same doc_id count once. Rows
    without doc_id are not compared and stay. Texts are compared whole, however long, and moved once. An empty table
    gives an empty one.
    """
    groups = grouped(docs.select("doc_id", "text"), size, part, whole).where("doc_id IS NOT NULL")
    first = F.struct("doc_id", "set_id")
    chosen = (groups.where("set_id IS NOT NULL").groupBy("label").agg(F.min(first).alias("first")).select("first.*")
              .unionByName(groups.where("set_id IS NULL").select("doc_id", "set_id").distinct()))
    again = groups.groupBy("doc_id").agg((F.count("*") > 1).alias("again"))
    wanted = chosen.select("doc_id").distinct().join(again, "doc_id")
    plain = {c: f"column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    rows = docs.withColumnsRenamed(plain)
    met = rows.join(wanted, "doc_id")

    def named(batches):
        for batch in batches:
            ids = [set_id(found) if len(found) else None for found in sets_of(batch, size)]
            yield batch.append_column("set", pa.array(ids, pa.int64()))

    several = met.where("again").drop("again")
    several = (several.mapInArrow(named, extended(several.schema, {"set": "long"}))
               .join(chosen.toDF("first_id", "first_set"),
                     (F.col("doc_id") == F.col("first_id")) & F.col("set").eqNullSafe(F.col("first_set")), "left_semi"))
    same = F.coalesce(F.col("set").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    every = Window.partitionBy("doc_id", "same").orderBy(F.xxhash64(*rows.columns), *rows.columns)
    several = (several.withColumn("same", same).withColumn("place", F.row_number().over(every)).where("place = 1"))
    return (met.where("NOT again").select(*rows.columns).unionByName(several.select(*rows.columns))
            .unionByName(rows.where("doc_id IS NULL")).toDF(*docs.columns))
