"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Equal vectors are one node. Neighbour lists start from groups of nodes on the same sides of random planes and improve in
rounds: every node calls together its new neighbours, some of the old ones and of the nodes that list it as new (a join), all
of them are compared with each other there, and each takes over the better ones (a second join, by node). Rounds end
when few neighbours are new. Queries then walk the graph: their best nodes not yet
visited fetch their neighbours (a join with the lists, which carry the neighbours' vectors), and the best found go
on. Meetings and walks compare the original vectors in double precision: among many nearly equal vectors a rounded
one would order by its rounding. The result is computed anew for all that are level with the last place.

All groups are bounded: lists by their length, reverse neighbours by a sample, and members of a node by the number
of results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.tables import discard, stored, tidy

#: Length of neighbour lists; new neighbours, old ones and reverse neighbours that meet at a node; what one meeting hands each.
LIST, MEET, OLD, HANDED, ROUNDS = 32, 16, 8, 6, 8
#: Groupings at the start and members of a group; part of new neighbours at which the lists are done.
STARTS, GROUP, FEW = 6, 128, 0.005
#: Nodes a query visits in a round, rounds, and how many of the best found it keeps.
VISITS, WALKS, KEPT = 64, 6, 400
#: Scores this close to the last place, as a part of the largest, are level with it until they are computed anew.
LEVEL = 1e-9
SEED = 7


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors (float32) of a binary column whose values have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1), np.float32)
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups, a table of many at a time, of rows sorted by a long key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if keys[0] != keys[-1] else 0
        if held and (cut or held[-1].column(key)[-1].as_py() != keys[0]):
            if held[-1].column(key)[-1].as_py() != keys[0] and not cut:
                yield pa.Table.from_batches(held)
                held = []
            else:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def cuts(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def meetings(rows: DataFrame, handed: int = HANDED) -> DataFrame:
    """(node, ids, scores, fresh): what each node of a meeting hears there. rows: (m, node, vec, least)."""

    def run(batches):
        for table in groups(batches, "m"):
            m, node = table.column("m").to_numpy(), table.column("node").to_numpy()
            least, vectors = table.column("least").to_numpy(), matrix(table.column("vec")).astype(np.float64)
            names, sizes, ids, scores = [], [], [], []
            at = cuts(m)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                own, first = np.unique(node[a:b], return_index=True)
                if len(own) < 2:
                    continue
                x = vectors[a:b][first]
                like = x @ x.T
                np.fill_diagonal(like, -np.inf)
                some = min(handed, len(own) - 1)
                top = np.argpartition(-like, some - 1, axis=1)[:, :some]
                value = np.take_along_axis(like, top, 1)
                good = value > least[a:b][first][:, None]
                many = good.sum(axis=1)
                hears = many > 0
                names.append(own[hears])
                sizes.append(many[hears])
                ids.append(own[top][good])
                scores.append(value[good])
            if names:
                names, sizes, ids, scores = (np.concatenate(x) for x in (names, sizes, ids, scores))
                yield pa.RecordBatch.from_arrays([pa.array(names), *packed_lists(sizes, ids, scores, np.ones(len(ids), np.int8))],
                                                 ["node", "ids", "scores", "fresh"])

    return (rows.select("m", "node", "vec", "least").repartition("m").sortWithinPartitions("m")
            .mapInArrow(run, "node long, ids array<long>, scores array<double>, fresh array<tinyint>"))


def packed_lists(sizes: np.ndarray, *values: np.ndarray) -> list[pa.ListArray]:
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values]


def merged(rows: DataFrame, most: int) -> DataFrame:
    """The best distinct ids of each node's lists, best first, ties to the smaller id: (node, ids, scores, fresh, least).
    An id that an old list holds is not fresh."""

    def run(batches):
        for table in groups(batches, "node"):
            lists_ = [table.column(c).combine_chunks() for c in ("ids", "scores", "fresh")]
            sizes = np.diff(lists_[0].offsets.to_numpy())
            node = np.repeat(table.column("node").to_numpy(), sizes)
            ids, scores, fresh = (x.flatten().to_numpy() for x in lists_)
            by = np.lexsort((fresh, ids, node))
            node, ids, scores, fresh = (x[by] for x in (node, ids, scores, fresh))
            first = np.concatenate([[True], (ids[1:] != ids[:-1]) | (node[1:] != node[:-1])])
            node, ids, scores, fresh = (x[first] for x in (node, ids, scores, fresh))
            by = np.lexsort((ids, -scores, node))
            node, ids, scores, fresh = (x[by] for x in (node, ids, scores, fresh))
            at = cuts(node)
            place = np.arange(len(node)) - np.repeat(at[:-1], np.diff(at))
            kept = place < most
            many = np.minimum(np.diff(at), most)
            least = np.where(many == most, scores[at[:-1] + many - 1], -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[at[:-1]]), *packed_lists(many, ids[kept], scores[kept], fresh[kept]), pa.array(least)],
                ["node", "ids", "scores", "fresh", "least"])

    return (rows.repartition("node").sortWithinPartitions("node")
            .mapInArrow(run, "node long, ids array<long>, scores array<double>, fresh array<tinyint>, least double"))


def start_groups(nodes: DataFrame, count: int) -> DataFrame:
    """(m, node, vec, least): every node in STARTS groups of about GROUP nodes. A group is on the same sides of random planes;
    a side with many nodes is dealt into several groups, so a dense one is no larger group than others."""
    bits = max(0, (count // GROUP).bit_length() - 1)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("vec")).astype(np.float64)
            planes = np.random.default_rng(SEED).normal(size=(STARTS, bits, x.shape[1]))
            sides = [(x @ p.T > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), np.int64) for p in planes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(batch.column("node").to_numpy(), STARTS)), pa.array(np.repeat(np.arange(STARTS), len(x))),
                 pa.array(np.concatenate(sides).astype(np.int64))], ["node", "start", "side"])

    sided = nodes.mapInArrow(run, "node long, start long, side long")
    sizes = sided.groupBy("start", "side").agg(F.ceil(F.count("*") / (2 * GROUP)).alias("parts"))
    part = F.pmod(F.xxhash64("node", "start"), "parts")
    return (sided.join(sizes, ["start", "side"]).select("node", F.xxhash64("start", "side", part).alias("m"))
            .join(nodes, "node").withColumn("least", F.lit(float("-inf"))))


def neighbour_lists(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, ids, scores) by NN-descent. nodes: (node, vec)."""
    count = nodes.count()
    graph = stored(merged(meetings(start_groups(nodes, count), LIST), LIST))
    for turn in range(rounds):
        sides = F.arrays_zip("ids", "fresh")
        some = lambda new, many: F.slice(F.shuffle(F.transform(
            F.filter(sides, lambda x: x["fresh"] == new), lambda x: x["ids"]), F.lit(turn)), 1, many)
        calls = stored(graph.filter(F.exists("fresh", lambda x: x == 1)).select("node", some(1, MEET).alias("new"), some(0, OLD).alias("old")))
        ahead = calls.select(F.col("node").alias("m"), F.explode(F.concat("new", "old", F.array("node"))).alias("node"))
        few = Window.partitionBy("m").orderBy(F.xxhash64("node", F.lit(turn)), "node")
        back = (calls.select(F.explode("new").alias("m"), "node").withColumn("place", F.row_number().over(few))
                .where(F.col("place") <= MEET).drop("place"))
        known = nodes.join(graph.select("node", "least"), "node", "left").withColumn(
            "least", F.coalesce("least", F.lit(float("-inf"))))
        heard = meetings(ahead.unionByName(back).join(known, "node"))
        old = graph.select("node", "ids", "scores", F.transform("fresh", lambda _: F.lit(0).cast("tinyint")).alias("fresh"))
        before, graph = graph, stored(merged(old.unionByName(heard), LIST))
        discard(before, calls)
        tidy(graph.sparkSession)
        new = graph.agg(F.coalesce(F.sum(F.aggregate("fresh", F.lit(0).cast("long"), lambda t, x: t + x)), F.lit(0))).first()[0]
        if new <= FEW * LIST * count:
            break
    return graph


def walked(queries: DataFrame, nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """(q, ids, scores): the best nodes that greedy search finds for each query node. queries: (q, vec)."""

    def packed(batches):
        for table in groups(batches, "node"):
            node, ids, vec = table.column("node").to_numpy(), table.column("id").to_numpy(), matrix(table.column("vec"))
            at = cuts(node)
            pairs = list(zip(at[:-1].tolist(), at[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[at[:-1]]), pa.array([ids[a:b].tobytes() for a, b in pairs], pa.binary()),
                 pa.array([vec[a:b].tobytes() for a, b in pairs], pa.binary())], ["node", "ids", "vecs"])

    edges = graph.select("node", F.explode("ids").alias("id"))
    around = stored(edges.join(nodes.withColumnRenamed("node", "id"), "id").select("node", "id", "vec")
                    .repartition("node").sortWithinPartitions("node").mapInArrow(packed, "node long, ids binary, vecs binary"))

    def asked(batches):
        for batch in batches:
            ids, scores = [], []
            for own, near, vecs in zip(batch.column("vec"), batch.column("ids"), batch.column("vecs")):
                x = np.frombuffer(own.as_buffer(), np.float32).astype(np.float64)
                near = np.frombuffer(near.as_buffer(), np.int64)
                ids.append(near)
                scores.append(np.frombuffer(vecs.as_buffer(), np.float32).reshape(len(near), -1).astype(np.float64) @ x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("q"), lists(ids, pa.int64()), lists(scores, pa.float64()),
                 lists([np.zeros(len(i), np.int8) for i in ids], pa.int8())], ["q", "ids", "scores", "seen"])

    def pooled(batches):
        for table in groups(batches, "q"):
            q, flat = table.column("q").to_numpy(), [table.column(c).combine_chunks() for c in ("ids", "scores", "seen")]
            ends = np.concatenate([[0], np.cumsum(np.diff(flat[0].offsets.to_numpy()))])
            ids, scores, seen = (f.flatten().to_numpy() for f in flat)
            at, names, parts = cuts(q), [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                i, s, v = (x[ends[a]: ends[b]] for x in (ids, scores, seen))
                by = np.lexsort((-v, i))  # the visited one of equal ids first
                first = by[np.concatenate([[True], i[by][1:] != i[by][:-1]])] if len(by) else by
                top = first[np.lexsort((i[first], -s[first]))][:KEPT]
                v = v[top].copy()
                go = np.flatnonzero(v == 0)[:VISITS]
                v[go] = 2  # to be visited now
                names.append(q[a])
                parts.append((i[top], s[top], v))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), lists([p[0] for p in parts], pa.int64()),
                 lists([p[1] for p in parts], pa.float64()), lists([p[2] for p in parts], pa.int8())],
                ["q", "ids", "scores", "seen"])

    kind = "q long, ids array<long>, scores array<double>, seen array<tinyint>"

    def pool(rows: DataFrame) -> DataFrame:
        return stored(rows.select("q", "ids", "scores", "seen").repartition("q").sortWithinPartitions("q")
                      .mapInArrow(pooled, kind))

    state = pool(queries.join(graph.withColumnRenamed("node", "q"), "q", "left").select(
        "q", F.coalesce("ids", F.array().cast("array<long>")).alias("ids"),
        F.coalesce("scores", F.array().cast("array<double>")).alias("scores"))
        .withColumn("seen", F.transform("ids", lambda _: F.lit(0).cast("tinyint"))))
    for turn in range(WALKS):
        items = F.explode(F.arrays_zip("ids", "seen")).alias("x")
        go = state.select("q", items).where("x.seen = 2").select("q", F.col("x.ids").alias("node"))
        found = go.join(queries, "q").join(around, "node").select("q", "vec", "ids", "vecs").mapInArrow(asked, kind)
        visited = state.withColumn("seen", F.transform("seen", lambda v: F.least(v, F.lit(1).cast("tinyint"))))
        before, state = state, pool(visited.unionByName(found))
        discard(before)
        tidy(state.sparkSession)
    discard(around)
    return state.select("q", "ids", "scores")


def nearest(vectors: DataFrame, wanted: int = 20, every: int = 20) -> DataFrame:
    """The `wanted` nearest rows by inner product of every row whose vec_id is divisible by `every`.

    vectors: vec_id long, embedding array<float>; other columns are ignored. Returns query_id, rank (from 1), vec_id,
    score; fewer rows a query if there are fewer candidates. A row is no candidate of itself. Rows take no part if
    vec_id is null or the vector is null, empty, zero, holds null or non-finite components or has another length
    than most. Equal vectors tie, and the smaller vec_id comes first; equal rows count once. The search is approximate
    for different vectors and exact for copies. An empty table gives an empty result.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    good = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(
        finite & F.exists("embedding", lambda x: x != 0))
    usual = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    good = good.where(F.size("embedding") == (usual[0]["n"] if usual else 0))
    node = F.xxhash64("embedding")

    def code(batches):
        for batch in batches:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            rows = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in rows], pa.binary())],
                                             ["node", "vec"])

    ids = stored(good.select("vec_id", node.alias("node")).distinct())
    exact = stored(good.select(node.alias("node"), "embedding").dropDuplicates(["node"]))
    nodes = stored(exact.mapInArrow(code, "node long, vec binary"))
    graph = neighbour_lists(nodes)
    asking = ids.where(F.col("vec_id") % every == 0)
    queries = asking.select(F.col("node").alias("q")).distinct().join(nodes.withColumnRenamed("node", "q"), "q")
    found = walked(queries, nodes, graph)
    discard(graph)

    last = F.coalesce(F.get("scores", F.lit(wanted)), F.element_at("scores", -1))
    level = last - LEVEL * F.greatest(F.abs(last), F.abs(F.get("scores", F.lit(0))))
    near = F.filter(F.arrays_zip("ids", "scores"), lambda x: x["scores"] >= level)
    best = found.where(F.size("ids") > 0).select("q", F.explode(near.getField("ids")).alias("node"))
    pairs = best.unionByName(queries.select("q", F.col("q").alias("node"))).distinct()
    pairs = (pairs.join(exact.withColumnRenamed("embedding", "there"), "node")
             .join(exact.select(F.col("node").alias("q"), F.col("embedding").alias("here")), "q"))
    product = F.aggregate(F.zip_with("here", "there", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0),
                          lambda s, x: s + x)
    pairs = pairs.select("q", "node", product.alias("score"))
    few = Window.partitionBy("node").orderBy("vec_id")
    members = ids.withColumn("place", F.row_number().over(few)).where(F.col("place") <= wanted + 1).drop("place")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = (pairs.join(members, "node").select("q", "vec_id", "score").withColumn("place", F.row_number().over(order))
           .where(F.col("place") <= wanted + 1))
    own = Window.partitionBy("query_id").orderBy("place")
    return (asking.select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).join(top, "q")
            .where("query_id <> vec_id").withColumn("rank", F.row_number().over(own))
            .where(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score"))
