"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Equal vectors are one node (the smallest vec_id). The neighbour graph starts
from blocks: each vector is dealt to the cells of its ASSIGN nearest pivots
(one for each CELL vectors, at most PIVOTS, sampled) and compared within the
cell, in a cell of more than PART within two partings into parts of about PART.
Then NN-descent: every node introduces its neighbours (its own and up to NEAR
that name it, the nearest ones) to each other where one of the two is new, in
a Spark join of edges with vectors; each node keeps its NEAR best, until at
most the share SETTLED of all edges is new. A search walks that graph: from the
query's own node it expands the BEAM best candidates not yet expanded, all
queries at once in each hop's joins, HOPS times and then until at most the share
STILL of the neighbours asked for is new. So rounds and hops follow the data, at any size.

Ids travel; vectors, as bytes with a scale, meet them where a product is to be
taken. What is found is ranked by the exact double-precision product of the
original vectors, summed in order. `search_exact` is the exact way: it compares
every query, in blocks, with every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, drop, ship, table, whole_groups

NEAR = 32
PIVOTS = 16_384
#: Vectors for each pivot.
CELL = 800
ASSIGN = 4
PART = 4_000
#: Rounds end when this share of the edges, or less, is new.
SETTLED = 0.06
BEAM = 64
#: Hops of every search at least; then they end when this share of the queries' nearest, or less, is new.
HOPS = 3
STILL = 0.05
#: Candidates of a query that are kept; the farther ones can't be among its nearest, and are never expanded.
POOL = 400
#: Candidates of a query that are ranked exactly, for each neighbour asked for.
RERANK = 2
#: Queries that the exact way compares with all rows at a time.
BLOCK = 4_096


def encode(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: a scale (float32), then signed 8-bit values."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30).astype(np.float32) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return [s.tobytes() + r.tobytes() for s, r in zip(scale, q)]


def decode(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of float32 from encode()'s bytes."""
    raw = b"".join(column.to_pylist())
    rows = len(column)
    b = np.frombuffer(raw, np.int8).reshape(rows, -1)
    return b[:, 4:].astype(np.float32) * np.ascontiguousarray(b[:, :4]).view(np.float32)


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_EDGE = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("s", pa.float32()), ("fresh", pa.bool_())])
_EDGE_SQL = "node long, other long, s float, fresh boolean"


def best_edges(a: np.ndarray, b: np.ndarray, s: np.ndarray, old: np.ndarray, near: int):
    """Of edges a -> b with scores the `near` best of each a, each b once; an old one stands for its new copies."""
    o = np.lexsort((~old, b, a))
    a, b, s, old = a[o], b[o], s[o], old[o]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, s, old = a[first], b[first], s[first], old[first]
    o = np.lexsort((b, -s, a))
    a, b, s, old = a[o], b[o], s[o], old[o]
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(a)]])))
    keep = place < near
    return a[keep], b[keep], s[keep], old[keep]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part: no null or repeated ids (of those the least vector), vectors not null, zero or of other than the most frequent dimension, all components finite."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    return rows.join(F.broadcast(most), F.size("v") == F.col("d"), "left_semi")


def _blocks(vectors: DataFrame, near: int) -> tuple[DataFrame, DataFrame]:
    """The dealt vectors (a table), and edges from blocks of them around pivots."""
    n = vectors.count()
    wanted = max(1, min(PIVOTS, n // CELL))
    picks = vectors.orderBy(F.xxhash64(F.lit(3), "node")).select("code").limit(wanted).collect()
    pivots = decode(pa.array([bytes(r["code"]) for r in picks], pa.binary())) if picks else np.zeros((0, 1), np.float32)
    pivots = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-30)
    times = min(ASSIGN, max(1, len(pivots)))

    def deal(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                cells = np.argsort(-(decode(b.column("code")) @ pivots.T), axis=1, kind="stable")[:, :times]
                at = np.repeat(np.arange(b.num_rows), times)
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel(), pa.int32()), b.column("node").take(pa.array(at)), b.column("code").take(pa.array(at))], names=["cell", "node", "code"])

    dealt = cut(vectors.select("node", "code").mapInArrow(deal, "cell int, node long, code binary"))
    sizes = dealt.groupBy("cell").count()  # at most PIVOTS rows
    # Each cell parts its vectors in its own way, and twice, so that no set of nodes stays by itself in all of them.
    many = F.ceil(F.col("count") / PART).cast("int")
    twice = dealt.join(F.broadcast(sizes), "cell").withColumn("many", many).withColumn("deal", F.explode(F.when(F.col("many") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    parts = twice.withColumn("part", (F.col("deal") * F.col("many") + F.pmod(F.xxhash64(F.lit(9), "cell", "deal", "node"), F.col("many"))).cast("int")).select("cell", "part", "node", "code")

    def compare(t: pa.Table) -> pa.Table:
        ids, x = t.column("node").to_numpy(), decode(t.column("code"))
        k = min(near, len(ids) - 1)
        out = []
        for i in range(0, len(ids) if k else 0, 500):
            s = x[i : i + 500] @ x.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
            top = np.argpartition(s, len(ids) - k, axis=1)[:, len(ids) - k :]
            a = np.repeat(ids[i : i + 500], k)
            out.append(_batch(_EDGE, a, ids[top.ravel()], np.take_along_axis(s, top, 1).ravel(), np.ones(len(a), bool)))
        return pa.Table.from_batches(out, _EDGE)

    return dealt, parts.groupBy("cell", "part").applyInArrow(compare, _EDGE_SQL)


def _keep_best(edges: DataFrame, near: int) -> DataFrame:
    """Each node's best edges, of old (not fresh) and new ones."""

    def run(batches):
        for t in whole_groups(batches, "node"):
            a, b, s, old = best_edges(t.column("node").to_numpy(), t.column("other").to_numpy(), t.column("s").to_numpy(), ~t.column("fresh").to_numpy(zero_copy_only=False), near)
            yield _batch(_EDGE, a, b, s, ~old)

    return edges.repartition("node").sortWithinPartitions("node").mapInArrow(run, _EDGE_SQL)


def _named_by(graph: DataFrame, near: int) -> DataFrame:
    """The edges turned round, of those to one node the nearest. Spark keeps no more than `near` of a node from each map task, so a node that many name is no hot key."""
    turned = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "s", "fresh")
    order = Window.partitionBy("node").orderBy(F.desc("s"), "other")
    return turned.withColumn("r", F.row_number().over(order)).where(F.col("r") <= near).drop("r")


def _introduce(graph: DataFrame, vectors: DataFrame, near: int) -> DataFrame:
    """New edges between the neighbours of each node, where they beat the worst that one of the two has."""
    lows = graph.groupBy("node").agg(F.count("*").alias("k"), F.min("s").alias("low"))
    about = vectors.join(lows, "node", "left").select(F.col("node").alias("other"), "code", F.when(F.col("k") >= near, F.col("low")).otherwise(F.lit(float("-inf"))).cast("float").alias("low"))
    members = graph.unionByName(_named_by(graph, near)).groupBy("node", "other").agg(F.max("fresh").alias("fresh"))
    met = members.join(about, "other").repartition("node").sortWithinPartitions("node")  # at most 2 * near of a node

    def run(batches):
        for t in whole_groups(batches, "node"):
            key, ids, low = t.column("node").to_numpy(), t.column("other").to_numpy(), t.column("low").to_numpy()
            fresh, x = t.column("fresh").to_numpy(zero_copy_only=False), decode(t.column("code"))
            ends = np.concatenate([np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            out, start = [], 0
            for end in ends:
                f = np.flatnonzero(fresh[start:end]) + start
                if len(f):
                    s = x[f] @ x[start:end].T
                    s[np.arange(len(f)), f - start] = -np.inf
                    i, j = np.nonzero(s > np.minimum(low[f][:, None], low[None, start:end]))
                    v, i, j = s[i, j], f[i], j + start
                    m, n = v > low[i], v > low[j]
                    out.append((np.concatenate([ids[i[m]], ids[j[n]]]), np.concatenate([ids[j[m]], ids[i[n]]]), np.concatenate([v[m], v[n]])))
                start = end
            if out:
                a, b, s = map(np.concatenate, zip(*out))
                a, b, s, _ = best_edges(a, b, s, np.zeros(len(a), bool), near)
                yield _batch(_EDGE, a, b, s, np.ones(len(a), bool))

    return met.select("node", "other", "fresh", "code", "low").mapInArrow(run, _EDGE_SQL)


def neighbour_graph(vectors: DataFrame, near: int = NEAR, settled: float = SETTLED) -> DataFrame:
    """Edges (node, other, s, fresh) to about the `near` nearest others of each node. vectors: node, code; a table."""
    dealt, blocks = _blocks(vectors, near)
    graph = cut(_keep_best(blocks, near))
    drop(dealt)
    while True:  # an edge only ever gives way to a better one, so the rounds end
        last = graph
        seen = last.withColumn("fresh", F.lit(False))
        graph = cut(_keep_best(seen.unionByName(_introduce(last, vectors, near)), near))
        drop(last)
        fresh, edges = graph.select(F.count(F.when(F.col("fresh"), 1)), F.count("*")).first()
        if fresh <= settled * edges:
            return graph


_POOL = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("s", pa.float32()), ("state", pa.int8()), ("late", pa.bool_())])
_POOL_SQL = "node long, other long, s float, state byte, late boolean"
_SCORE = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("s", pa.float32())])


def _scored(batches):
    for b in batches:
        if b.num_rows:
            yield _batch(_SCORE, b.column("node"), b.column("other"), np.einsum("ij,ij->i", decode(b.column("own")), decode(b.column("code"))))


def _merged(batches, beam: int, pool: int, k: int):
    """Of each node's candidates the `pool` best; state: 0 not expanded, 1 to be expanded now, 2 expanded, -1 just scored. late: new among the k best."""
    for t in whole_groups(batches, "node", 40_000):
        a, b, s, state = (t.column(c).to_numpy() for c in ("node", "other", "s", "state"))
        o = np.lexsort((-state, b, a))
        a, b, s, state = a[o], b[o], s[o], state[o]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, s, state = a[first], b[first], s[first], state[first]
        o = np.lexsort((b, -s, a))
        a, b, s, state = a[o], b[o], s[o], state[o]
        head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        place = np.arange(len(a)) - np.repeat(head, np.diff(np.append(head, len(a))))
        keep = place < pool
        a, b, s, state, place = a[keep], b[keep], s[keep], state[keep], place[keep]
        late = (state < 0) & (place < k)
        state = np.where(state == 1, 2, np.maximum(state, 0))
        open_ = state == 0
        head = np.flatnonzero(place == 0)
        upto = np.cumsum(open_)
        turn = upto - np.repeat(upto[head] - open_[head], np.diff(np.append(head, len(a))))
        yield _batch(_POOL, a, b, s, np.where(open_ & (turn <= beam), 1, state), late)


def walk(graph: DataFrame, vectors: DataFrame, starts: DataFrame, k: int, near: int = NEAR, beam: int = BEAM, pool: int = POOL, hops: int = HOPS, still: float = STILL) -> DataFrame:
    """(node, other, s): for each of starts' nodes the best others that a greedy search from its place in the graph finds."""
    links = cut(graph.select("node", "other").union(_named_by(graph, near).select("node", "other")).groupBy("node").agg(F.collect_set("other").alias("others")))  # at most 2 * near each
    codes = vectors.select(F.col("node").alias("other"), "code")
    own = cut(starts.join(vectors, "node").select("node", F.col("code").alias("own")))
    order = Window.partitionBy("node").orderBy(F.desc("s"), "other")  # at most `near` of a node
    found = cut(graph.join(starts, "node", "left_semi").select("node", "other", "s", F.when(F.row_number().over(order) <= beam, 1).otherwise(0).cast("byte").alias("state"), F.lit(True).alias("late")))
    for hop in count(1):  # each expands what none has, so they end
        last = found
        reached = last.where("state = 1").select("node", "other").join(links.withColumnRenamed("node", "other"), "other").select("node", F.explode("others").alias("other")).where("node <> other").distinct()
        new = reached.join(codes, "other").join(own, "node").mapInArrow(_scored, "node long, other long, s float")
        both = last.select("node", "other", "s", "state").unionByName(new.withColumn("state", F.lit(-1).cast("byte")))
        found = cut(both.repartition("node").sortWithinPartitions("node").mapInArrow(lambda batches: _merged(batches, beam, pool, k), _POOL_SQL))
        drop(last)
        late, nearest, todo = found.select(F.count(F.when(F.col("late"), 1)), F.count_distinct("node") * k, F.count(F.when(F.col("state") == 1, 1))).first()
        if not todo or hop >= hops and late <= still * nearest:
            drop(links, own)
            return found.select("node", "other", "s")


def search(df: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows found for each row where is_query (a column over vec_id) holds.

    Every row but the query's own is a candidate; ties go to the smaller
    vec_id; with fewer rows than k all are returned. Rows that usable() leaves
    out are neither queries nor candidates; df without others gives no rows.
    Other columns of df, whatever their names, are left out.
    """
    spark = df.sparkSession
    ship(spark)

    def pack(batches):
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("v").flatten()).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(encode(x), pa.binary())], names=["vec_id", "v", "code"])

    rows = cut(usable(df, key, vector).mapInArrow(pack, "vec_id long, v array<double>, code binary"))
    same = rows.groupBy("v").agg(F.min("vec_id").alias("node"), F.first("code").alias("code"))
    nodes = cut(same)
    vectors = nodes.select("node", "code")
    named = rows.join(nodes.select("v", "node"), "v").select("vec_id", "node")
    # Of equal vectors only the k + 1 smallest ids can be among a query's k nearest.
    members = named.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1).select(F.col("node").alias("other"), F.col("vec_id").alias("member"))
    queries = cut(named.where(is_query).withColumnRenamed("vec_id", "query_id"))
    starts = queries.select("node").distinct()
    found = walk(neighbour_graph(vectors), vectors, cut(starts), k)
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("s"), "other"))).where(F.col("r") <= RERANK * k).select("node", "other")
    pairs = best.union(starts.select("node", F.col("node").alias("other")))
    exact = pairs.join(nodes.select("node", F.col("v").alias("x")), "node").join(nodes.select(F.col("node").alias("other"), F.col("v").alias("y")), "other").select("node", "other", "x", "y")

    def product(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.asarray(b.column(c).flatten()).reshape(b.num_rows, -1) for c in ("x", "y"))
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("other"), pa.array(np.cumsum(x * y, axis=1)[:, -1])], names=["node", "other", "score"])

    scored = exact.mapInArrow(product, "node long, other long, score double").join(members, "other")
    short = scored.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "member"))).where(F.col("r") <= k + 1)
    ranked = queries.join(short, "node").where("query_id <> member").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "member")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("member").alias("vec_id"), "score")


def _nearest(ids: np.ndarray, x: np.ndarray, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows in batches the k nearest of each query (ids, x)."""
    n, spare = len(ids), k + 8
    best_id, best = np.full((n, 0), 0, np.int64), np.full((n, 0), 0.0)
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            keys, y = part.column("vec_id").to_numpy(), np.asarray(part.column("v").flatten()).reshape(part.num_rows, -1)
            rough = x @ y.T
            rough[ids[:, None] == keys[None]] = -np.inf
            m = min(spare, len(keys))
            top = np.argpartition(rough, len(keys) - m, axis=1)[:, len(keys) - m :]
            exact = np.stack([np.cumsum(x * y[top[:, j]], axis=1)[:, -1] for j in range(m)], axis=1)
            exact[np.take_along_axis(rough, top, 1) == -np.inf] = -np.inf
            best_id, best = np.hstack([best_id, keys[top]]), np.hstack([best, exact])
            o = np.lexsort((best_id, -best), axis=1)[:, :k]
            best_id, best = np.take_along_axis(best_id, o, 1), np.take_along_axis(best, o, 1)
    some = best > -np.inf
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, some.sum(axis=1))), pa.array(best_id[some]), pa.array(best[some])], names=["query_id", "vec_id", "score"])


def search_exact(df: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """What search() gives, but exactly: the queries, about BLOCK of them at a time, are compared with every row.

    A block's vectors go to all tasks; each task sends on the k best that it has
    seen for each. Cost grows with queries times rows, memory doesn't.
    """
    spark = df.sparkSession
    ship(spark)
    rows = cut(usable(df, key, vector))
    queries = rows.where(is_query)
    blocks = max(1, -(-queries.count() // BLOCK))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for i in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).collect()  # about BLOCK rows
        if block:
            ids, x = np.array([r["vec_id"] for r in block]), np.array([r["v"] for r in block])
            near = rows.mapInArrow(partial(_nearest, ids, x, k), "query_id long, vec_id long, score double")
            ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            out = out.unionByName(cut(ranked.select("query_id", "rank", "vec_id", "score")))
    return out


def op10_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op10_neighbours": op10_neighbours}
_PRODUCT = "list_reduce(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]), lambda s, p: s + p)"
ORACLES = {
    "op10_neighbours": f"""WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_PRODUCT} AS score FROM u a JOIN u b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""
}
