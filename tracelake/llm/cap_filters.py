"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

Vectors are turned by a structured random rotation (signs and Hadamard transforms) and cut into two halves. Each half
has random unit codewords, and a pair of codewords is a filter direction, so a few hundred codewords make
as many filters as their square. A vector's homes are its best directions. By list decoding (sorting one half's products
and cutting them for each codeword of the other) every vector finds all filters whose direction it exceeds by the
filter's threshold, and the join on filters brings it together with the vectors at home there. A vector at angle t from
one whose home has the product b comes to cos(t) b plus a normally spread rest, so thresholds lie DEPTH deviations below;
in few dimensions they are the exact lower bound, and nothing is lost.

In a filter its home vectors are compared with all that came, by blocks of a matrix product of the original vectors in
double precision. A pair that meets in several filters counts in the smallest of them only, which both vectors' homes
tell. Filters return counts and a tree of links, never pairs, so a group of copies costs rows in proportion to its members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.tables import components, stored, tidy

#: Homes of a vector, and deviations that a threshold lies below the expected product.
HOMES, DEPTH = 4, 1.75
#: Codewords of a half: about twice the root of the number of different vectors, between these bounds, so that filters hold equally
#: many vectors at every size. The table of thresholds, one number a filter, is what is broadcast: 8 MB at most.
LEAST_WORDS, MOST_WORDS = 16, 1024
#: Home vectors and other vectors of a filter that meet in one task at a time.
HOME_ROWS, OTHER_ROWS = 512, 4096
#: Vectors decoded together; pairs whose smallest filter is looked up together.
DECODED, PAIRS = 256, 1 << 16
SEED = 20240613


class Codes:
    """The rotation and the codewords of both halves, from a seed: equal in every task."""

    def __init__(self, length: int, words: int):
        self.size = 1 << max(1, int(length - 1).bit_length())
        rng = np.random.default_rng(SEED)
        self.signs = rng.choice([-1.0, 1.0], (3, self.size))
        codes = rng.normal(size=(2, words, self.size // 2))
        self.words, self.codes = words, codes / np.linalg.norm(codes, axis=2, keepdims=True) / math.sqrt(2)

    def products(self, x: np.ndarray) -> list[np.ndarray]:
        """Products of unit vectors with the codewords of each half: two arrays (vectors, words)."""
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        for signs in self.signs:
            y = y * signs
            step = 1
            while step < self.size:
                pair = y.reshape(len(x), -1, 2, step)
                y = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(len(x), -1)
                step *= 2
            y /= math.sqrt(self.size)
        half = self.size // 2
        return [y[:, :half] @ self.codes[0].T, y[:, half:] @ self.codes[1].T]

    def best(self, products: list[np.ndarray], many: int) -> tuple[np.ndarray, np.ndarray]:
        """The `many` filters with the largest products for each vector, and these products."""
        some = min(many, self.words)
        top = [np.argpartition(-p, some - 1, axis=1)[:, :some] for p in products]
        left, right = (np.take_along_axis(p, t, 1) for p, t in zip(products, top))
        sums = (left[:, :, None] + right[:, None, :]).reshape(len(left), -1)
        names = (top[0][:, :, None].astype(np.int64) * self.words + top[1][:, None, :]).reshape(len(left), -1)
        at = np.argsort(-sums, axis=1, kind="stable")[:, : min(many, sums.shape[1])]
        return np.take_along_axis(names, at, 1), np.take_along_axis(sums, at, 1)

    def decoded(self, products: list[np.ndarray], thresholds: np.ndarray) -> Iterator[np.ndarray]:
        """For each vector all filters that it exceeds."""
        least = thresholds.min()
        for one, two in zip(*products):
            by = np.argsort(-two)
            rows = np.flatnonzero(one + two[by[0]] >= least) if np.isfinite(least) else np.empty(0, np.int64)
            many = np.searchsorted(-two[by], one[rows] - least, "right")
            row = np.repeat(rows, many)
            column = by[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
            names = row * self.words + column
            yield names[one[row] + two[column] >= thresholds[names]]


def units(column: pa.Array, kind: str) -> np.ndarray:
    """Unit vectors in double precision of a binary column of vectors of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def at_home(nodes: DataFrame, codes: Codes, cosine: float, kind: str) -> DataFrame:
    """nodes with homes and, for each, the product from which on another vector counts as near it."""
    sine = math.sqrt(max(0.0, 1 - cosine * cosine))
    depth = min(1.0, DEPTH / math.sqrt(codes.size - 1))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, DECODED):
                part = batch.slice(i, DECODED)
                names, value = codes.best(codes.products(units(part.column("vec"), kind)), HOMES)
                least = cosine * value - sine * depth * np.sqrt(np.maximum(0, 1 - value * value)) - 1e-9
                ends = pa.array(np.arange(0, names.size + 1, names.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("copies"), part.column("vec"),
                     pa.ListArray.from_arrays(ends, pa.array(names.ravel())),
                     pa.ListArray.from_arrays(ends, pa.array(least.ravel()))],
                    ["node", "copies", "vec", "homes", "least"])

    return nodes.mapInArrow(run, "node long, copies long, vec binary, homes array<long>, least array<double>")


def entries(homes: DataFrame, codes: Codes, shared, kind: str) -> DataFrame:
    """(filter, node, home): every filter that a node exceeds, and whether it is at home there."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, DECODED):
                part = batch.slice(i, DECODED)
                own = part.column("homes").to_pylist()
                found = list(codes.decoded(codes.products(units(part.column("vec"), kind)), shared.value))
                many = [len(f) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), pa.array(np.repeat(part.column("node").to_numpy(), many)),
                     pa.array(np.concatenate([np.isin(f, h) for f, h in zip(found, own)]))], ["filter", "node", "home"])

    return homes.select("node", "vec", "homes").mapInArrow(run, "filter long, node long, home boolean")


def linked(rows: dict[str, np.ndarray], codes: Codes, thresholds: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one block of a filter, home vectors against all others of the block: nodes that have any, how many copies
    of others they count here, and the smallest node of their tree."""
    here, there = np.flatnonzero(rows["asks"]), np.flatnonzero(~rows["asks"])
    node, x, at = rows["node"], rows["x"], int(rows["filter"][0])
    a, b = np.nonzero(x[here] @ x[there].T >= cosine)
    a, b = here[a], there[b]
    # a pair of home vectors meets here twice, once from each side: the smaller node asks
    true = (node[a] != node[b]) & (~rows["home"][b] | (node[a] < node[b]))
    a, b = a[true], b[true]
    if not len(a):
        return (np.empty(0, np.int64),) * 3
    used, again = np.unique(np.concatenate([a, b]), return_inverse=True)
    products, homes = codes.products(x[used]), rows["homes"][used]
    name, same = np.unique(node[used], return_inverse=True)  # a home vector has two rows
    left, right = np.split(again, 2)
    links = np.zeros(len(name), np.int64)
    for i in range(0, len(a), PAIRS):
        u, v = left[i: i + PAIRS], right[i: i + PAIRS]
        first = np.ones(len(u), bool)
        for p, q in ((u, v), (v, u)):  # p's homes that q reaches
            for k in range(homes.shape[1]):
                goal = homes[p, k]
                meets = products[0][q, goal // codes.words] + products[1][q, goal % codes.words] >= thresholds[goal]
                first &= ~(meets & (goal < at))
        for p, q in ((u, v), (v, u)):
            links += np.bincount(same[p[first]], rows["copies"][used[q[first]]], len(name)).astype(np.int64)
    left, right, label = same[left], same[right], name
    while True:
        low = label.copy()
        np.minimum.at(low, left, label[right])
        np.minimum.at(low, right, label[left])
        if (low == label).all():
            return name, links, label
        label = low


def met(rows: DataFrame, codes: Codes, shared, cosine: float, kind: str) -> DataFrame:
    """(node, links, root) of the blocks (filter, i, s): copies linked to a node there, and the smallest node of its tree."""

    def run(batches):
        names = ["filter", "i", "s", "asks", "home", "node", "copies"]
        held: list[pa.RecordBatch] = []

        def block():
            table = pa.Table.from_batches(held)
            out = {c: table.column(c).to_numpy() for c in names}
            out["x"] = units(table.column("vec"), kind)
            out["homes"] = table.column("homes").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
            node, links, root = linked(out, codes, shared.value, cosine)
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], ["node", "links", "root"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("filter", "i", "s")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                name = tuple(key[:, a].tolist())
                if held and name != last:
                    yield from block()
                    held = []
                held.append(batch.slice(a, b - a))
                last = name
        if held:
            yield from block()

    return (rows.select("filter", "i", "s", "asks", "home", "node", "copies", "vec", "homes")
            .repartition("filter", "i", "s").sortWithinPartitions("filter", "i", "s")
            .mapInArrow(run, "node long, links long, root long"))


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors.

    vectors: vec_id long, embedding array<float or double>; other columns are ignored. Two vectors link if their cosine in
    double precision is `cosine` (above 0) or more. n_links counts the other rows linked directly, component_id is the
    smallest vec_id reachable by links, and kept tells whether that is the row's own. Vectors that are null, empty, zero, hold
    null or non-finite components or have another length than most link with nothing, as do rows without vec_id, whose
    component_id is null and which are kept. Equal vectors are compared once and count with their copies; rows that repeat
    a vec_id count each for itself. Pairs found are verified, and none below `cosine` links; a pair right at 0.95 in 64
    dimensions is missed rarely (a test allows 2 of 20,000 such pairs), closer ones less often, none in up to four dimensions. An
    empty table gives an empty result.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0")
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    able = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
            & F.exists("embedding", lambda x: x != 0))
    rows = vectors.select("vec_id", "embedding", F.coalesce(able, F.lit(False)).alias("able"))
    usual = (rows.where("able").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n"))
             .limit(1).collect())
    length = usual[0]["n"] if usual else 0
    rows = rows.withColumn("able", F.col("able") & (F.size("embedding") == length))
    ids = stored(rows.select("vec_id", F.when(F.col("able"), F.xxhash64("embedding")).alias("node")))
    alone = (ids.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                              F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
    if not length:
        return alone

    def packed(batches):
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"),
                                              pa.array([r.tobytes() for r in flat], pa.binary())], ["node", "copies", "vec"])

    nodes = stored(rows.where("able").groupBy(F.xxhash64("embedding").alias("node"))
                   .agg(F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
                   .mapInArrow(packed, "node long, copies long, vec binary"))
    words = min(MOST_WORDS, max(LEAST_WORDS, math.ceil(2 * math.sqrt(nodes.count()))))
    codes = Codes(length, words)
    homes = stored(at_home(nodes, codes, cosine, kind))
    least = (homes.select(F.explode(F.arrays_zip("homes", "least")).alias("h")).groupBy(F.col("h.homes").alias("filter"))
             .agg(F.min("h.least").alias("least")).toArrow())
    thresholds = np.full(words * words, np.inf)
    thresholds[least.column("filter").to_numpy()] = least.column("least").to_numpy()
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(thresholds)
    found = stored(entries(homes, codes, shared, kind))
    sizes = (found.groupBy("filter").agg(F.count("*").alias("total"), F.count_if("home").alias("homes"))
             .where("total > 1")  # one row a filter: MOST_WORDS squared at most
             .select("filter", F.ceil(F.col("homes") / HOME_ROWS).cast("int").alias("ni"),
                     F.ceil(F.col("total") / OTHER_ROWS).cast("int").alias("ns")))
    placed = found.join(F.broadcast(sizes), "filter")
    i, s = F.pmod(F.hash("node"), "ni"), F.pmod(F.xxhash64("node", "filter"), F.col("ns").cast("long")).cast("int")
    many = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = placed.where("home").withColumn("i", i).withColumn("s", many("ns")).withColumn("asks", F.lit(True))
    asked = placed.withColumn("s", s).withColumn("i", many("ni")).withColumn("asks", F.lit(False))
    wide = (asking.select("filter", "i", "s", "asks", "home", "node")
            .unionByName(asked.select("filter", "i", "s", "asks", "home", "node"))
            .join(homes.select("node", "copies", "vec", "homes"), "node"))
    links = stored(met(wide, codes, shared, cosine, kind))
    shared.destroy()
    tidy(spark)
    labels = components(links.select("node", "root"), "node", "root", "label")
    sums = links.groupBy("node").agg(F.sum("links").alias("links"))
    groups = (ids.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
              .join(sums, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    smallest = groups.groupBy("label").agg(F.min("least").alias("component_id"))
    told = groups.join(smallest, "label").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return (ids.join(told, "node").select("vec_id", "n_links", "component_id",
                                          (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone))
