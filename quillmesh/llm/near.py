"""Groups of texts whose shingle sets have an exact Jaccard similarity of 4/5 or more, by SimHash.

Equal sets are one node. Its fingerprint is of its distinct shingles: BLOCKS
blocks of BLOCK bits and HEAD words. A pair at 0.8 differs in a share d = 0.15
of the bits and agrees in some block with probability 1 - (1 - (1 - d)^BLOCK)^BLOCKS;
by exact sums over binomials it agrees in none with 1.1e-5 at most, whatever the
sizes, but for sets of 4 and 5 shingles (7.5e-4): these have shorter blocks too
(1.6e-5). Sets of under 4 can't be similar to others at all.

Nodes that agree in a block are compared with each other in their HEAD words; at
most FAR differing bits are near (a pair at 0.8 isn't with 2e-8, of 4 and 5
shingles with 9e-6; an unrelated one is with 3e-11). That takes time as the square
of a block's nodes, but only a few words each, side by side in one task. A block's
nodes fall into groups by chains of near ones; lone ones are done with.

Each candidate is decided by its sets of 64-bit shingle hashes:
|A & B| * 9 >= (|A| + |B|) * 4. A group's nodes, if few, are joined with each
other. Of more, each is compared with the smallest one: a group of near copies,
however large, is one component after that. Only groups whose nodes are still
of several components go on: those that share nodes are one group, dealt into
chunks; each pair of chunks is compared in one task, but for nodes that are of
one component already, and only a spanning forest of its links leaves it. That is
exact, but quadratic in such a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, forget_others, map_text, release, texts
from quillmesh.llm.components import components
from quillmesh.llm.simhash import BATCH, shingle_hashes, wide_fingerprints

BLOCKS = 128
BLOCK = 14
#: Words of a fingerprint for blocks, and for the distance.
BODY = BLOCKS * BLOCK // 64
HEAD = 4
FAR = 76
#: Shingles that a set which is similar to another has at least; up to SHORT it has blocks of fewer bits too.
LEAST = 4
SHORT = 5
LESS = 2
#: Nodes (on average) whose blocks of one kind a task compares.
DEAL = 100_000
#: Nodes of a block that are compared pair by pair; of more, those that a chain has reached aren't compared again.
WIDE = 512
#: Pairs compared at a time.
PAIRS = 1 << 20
#: Nodes of a group that are joined with each other.
COLD = 8
#: Smallest nodes of larger groups that a node is compared with before its groups are known to be of one component; all else is compared if they aren't.
STARS = 4
CHUNK = 1000
#: Bytes of sets in a chunk, if it is more than one set.
CHUNK_BYTES = 8 << 20


def shingle_set(text: str, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.frombuffer(shingle_hashes(text, words), ">u8").astype(np.uint64))


def node_of(s: np.ndarray) -> int:
    """A long that stands for the set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True)


def block_keys(fps: np.ndarray) -> np.ndarray:
    """A row of BLOCKS keys for each fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(fps[:, :BODY]).astype(">u8").view(np.uint8), axis=1)
    return (bits.reshape(-1, BLOCK) @ (1 << np.arange(BLOCK, dtype=np.uint16))).astype(np.uint16).reshape(-1, BLOCKS)


def _near(x: np.ndarray, sizes: np.ndarray, i, j) -> np.ndarray:
    """Whether rows i and j are near, and of sizes that a similarity of 0.8 allows."""
    apart = np.bitwise_count(x[i] ^ x[j]).sum(axis=-1, dtype=np.int16)
    return (apart <= FAR) & (5 * np.minimum(sizes[i], sizes[j]) >= 4 * np.maximum(sizes[i], sizes[j]))


def near_chains(keys: np.ndarray, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For rows sorted by key the first row of the chain of near rows of the same key that each is of.

    x: a row of HEAD words each.
    """
    n = len(keys)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[: n or 0]
    many = np.diff(np.concatenate([starts, [n]]))
    later = np.repeat(starts + many, many) - 1 - np.arange(n)  # rows of the same key behind each
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, d = np.flatnonzero((later > 0) & (np.repeat(many, many) <= WIDE)), 1
    while len(at):
        for s in range(0, len(at), PAIRS):
            i = at[s : s + PAIRS]
            i = i[_near(x, sizes, i, i + d)]
            a.append(i)
            b.append(i + d)
        d += 1
        at = at[later[at] >= d]
    for start, m in zip(starts[many > WIDE].tolist(), many[many > WIDE].tolist()):
        rest = np.arange(start, start + m)
        while len(rest) > 1:
            first, reached, rest = rest[0], rest[:1], rest[1:]
            while len(reached) and len(rest):
                step = max(1, PAIRS // len(rest))
                hit = _near(x, sizes, reached[:step, None], rest[None, :]).any(axis=0)
                new, rest = rest[hit], rest[~hit]
                reached = np.concatenate([reached[step:], new])
                a.append(np.full(len(new), first))
                b.append(new)
    a, b, of = np.concatenate(a), np.concatenate(b), np.arange(n)
    while True:
        low = np.minimum(of[a], of[b])
        if (of[a] == low).all() and (of[b] == low).all():
            return of
        np.minimum.at(of, of[a], low)
        np.minimum.at(of, of[b], low)
        of = of[of]


def with_node(df: DataFrame, words: int = 5) -> DataFrame:
    """All columns of df (doc_id, text and others), and node."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        nodes = [node_of(shingle_set(t, words)) for t in texts(b)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, pa.int64())], names=[*b.schema.names, "node"])

    return map_text(df, run, df.withColumn("node", F.lit(0).cast("long")).schema, BATCH)


def _sketches(df: DataFrame, words: int) -> DataFrame:
    """doc_id, node, size of the set, and fingerprint (null for a set that can't be similar to another)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in texts(b)]
        sizes = np.array([len(s) for s in sets], np.int64)
        fps = iter(wide_fingerprints([s for s in sets if len(s) >= LEAST], BODY + HEAD))
        kept = pa.array([next(fps).tobytes() if n >= LEAST else None for n in sizes.tolist()], pa.binary())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([node_of(s) for s in sets], pa.int64()), pa.array(sizes), kept], names=["doc_id", "node", "size", "fp"])

    return map_text(df, run, "doc_id long, node long, size long, fp binary", BATCH)


def _blocks(nodes: DataFrame) -> DataFrame:
    """The nodes of each block, dealt to bins by the block's number and key: a row for each batch and bin, with columns of it as bytes.

    Equal keys of one block are in one bin.
    """
    parts = max(1, -(-nodes.count() // DEAL))

    def run(batches):
        forget_others()
        for b in batches:
            if not b.num_rows:
                continue
            ids, sizes = b.column("node").to_numpy(), b.column("size").to_numpy()
            fps = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint64).reshape(-1, BODY + HEAD)
            keys, x = block_keys(fps), fps[:, BODY:]
            every, short = np.arange(len(ids)), np.flatnonzero(sizes <= SHORT)
            for t in range(2 * BLOCKS):
                rows = every if t < BLOCKS else short
                key = keys[rows, t % BLOCKS] >> (0 if t < BLOCKS else LESS)
                part = key % parts
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                out = []
                for o in np.split(order, cuts) if len(order) else []:
                    r = rows[o]
                    out.append((t * parts + int(part[o[0]]), key[o].tobytes(), ids[r].tobytes(), sizes[r].astype(np.int32).tobytes(), x[r].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DEALT)], schema=_DEALT)
        release()

    return nodes.select("node", "size", "fp").mapInArrow(run, "bin long, key binary, node binary, size binary, x binary")


_DEALT = pa.schema([("bin", pa.int64()), *((c, pa.binary()) for c in ("key", "node", "size", "x"))])


def _groups(t: pa.Table) -> pa.Table:
    """key, node and size of a bin's nodes that others of their block are near to; the key is of the group's nodes, so equal groups have equal keys."""
    key, ids, sizes, x = (np.frombuffer(b"".join(t.column(c).to_pylist()), d) for c, d in (("key", np.uint16), ("node", np.int64), ("size", np.int32), ("x", np.uint64)))
    order = np.argsort(key, kind="stable")
    ids, sizes = ids[order], sizes[order]
    of = near_chains(key[order], x.reshape(-1, HEAD)[order], sizes)
    many = np.bincount(of, minlength=len(of))
    at = np.flatnonzero(many[of] > 1)
    mixed = ids[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    sums = np.zeros(len(of), np.uint64)
    np.add.at(sums, of[at], mixed ^ (mixed >> np.uint64(32)))
    return pa.table({"key": pa.array(sums[of[at]].view(np.int64)), "node": pa.array(ids[at]), "size": pa.array(sizes[at].astype(np.int64))})


def _members(t: pa.Table) -> pa.Table:
    """_groups with each group's number of nodes and its smallest node: a bin holds groups whole."""
    g = _groups(t)
    g = g.take(pa.array(np.lexsort((g.column("node").to_numpy(), g.column("key").to_numpy()))))
    _, first, of, n = np.unique(g.column("key").to_numpy(), return_index=True, return_inverse=True, return_counts=True)
    least = g.select(["node", "size"]).take(pa.array(first[of])).combine_chunks()
    both = pa.StructArray.from_arrays([pa.array(c.to_numpy()) for c in least.columns], names=least.column_names)
    return g.append_column("n", pa.array(n[of].astype(np.int64))).append_column("least", both)


def _sets(df: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """node and set (bytes) of the nodes in named, each with the doc_id of a row that has it."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in texts(b)]
        at = [i for i, (s, n) in enumerate(zip(sets, b.column("node").to_pylist())) if node_of(s) == n]  # an id may have other texts too
        return pa.RecordBatch.from_arrays([b.column("node").take(pa.array(at, pa.int64())), pa.array([sets[i].tobytes() for i in at], pa.binary())], names=["node", "set"])

    return map_text(df.join(named, "doc_id").select("node", "text"), run, "node long, set binary", BATCH).dropDuplicates(["node"])


def _wholes(open_: DataFrame) -> DataFrame:
    """key, node, size and component: groups of other blocks that share a node are one key, so its pairs are compared once.

    open_: each node once, with the least nodes of all its groups. Only these are
    joined, each with the smallest of the same node: nodes that are in the same
    groups give the same links.
    """
    links = open_.select(F.array_min("leasts").alias("a"), F.explode("leasts").alias("b"))
    whole = components(links).select("vertex", F.col("component").alias("key"))
    first = open_.select("node", "size", "component", F.array_min("leasts").alias("first"))
    return first.join(whole, F.col("first") == F.col("vertex"), "left").select(F.coalesce("key", "first").alias("key"), "node", "size", "component")


def _forest(t: pa.Table) -> pa.Table:
    """Of a group's links a spanning forest, over what its components join already."""
    ids = t.column("node").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in t.column("set").to_pylist()]
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    at = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    held = np.zeros(int(at.max()) + 1, np.int32)
    _, known, first = np.unique(t.column("component").to_numpy(), return_index=True, return_inverse=True)
    first, a, b = known[first], [], []
    for i in range(len(ids) - 1):
        if (first[i + 1 :] == first[i]).all():
            continue
        mine = at[starts[i] : starts[i + 1]]
        held[mine] = 1
        both = np.add.reduceat(held[at[starts[i + 1] :]], starts[i + 1 : -1] - starts[i + 1])
        held[mine] = 0
        near = i + 1 + np.flatnonzero(both * 9 >= (sizes[i + 1 :] + sizes[i]) * 4)
        for r in np.unique(first[near]):
            if r != first[i]:
                a.append(ids[i])
                b.append(ids[near[first[near] == r][0]])
                first[first == r] = first[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _confirmed(batches):
    for t in batches:
        good = []
        for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            good.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
        yield t.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def similar(df: DataFrame, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """Of every row with an id its doc_id and node, and of every node its smallest doc_id and component: two tables.

    Rows are of one component if a chain of similar sets joins them. Null text
    is empty, and all empty texts are one node.
    """
    df = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    docs = cut(_sketches(df, words))
    nodes = cut(docs.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("fp").alias("fp")))
    members = cut(_blocks(nodes.where("fp is not null")).groupBy("bin").applyInArrow(_members, "key long, node long, size long, n long, least struct<node: long, size: long>").distinct())
    cold, hot = members.where(F.col("n") <= COLD), members.where(F.col("n") > COLD)
    one, other = (cold.select("key", F.col("node").alias(n), F.col("size").alias(f"{n}_size")) for n in "ab")
    hubs = hot.groupBy("node", "size").agg(F.slice(F.sort_array(F.collect_set("least")), 1, STARS).alias("hubs"))
    stars = hubs.select(F.explode("hubs").alias("h"), "node", "size").select(F.col("h.node").alias("a"), F.col("h.size").alias("a_size"), F.col("node").alias("b"), F.col("size").alias("b_size"))
    both = one.join(other, "key").select("a", "a_size", "b", "b_size").unionByName(stars)
    pairs = cut(both.where("a < b and 5 * least(a_size, b_size) >= 4 * greatest(a_size, b_size)").select("a", "b").distinct())
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(hot.select("node")).distinct()
    sets = cut(_sets(df, nodes.select("node", "doc_id").join(wanted, "node"), words))
    found = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(_confirmed, "a long, b long")
    )
    parts = components(found)
    placed = cut(hot.join(parts, F.col("node") == F.col("vertex"), "left").select("key", "node", "size", F.col("least.node").alias("least"), F.coalesce("component", "node").alias("component")))
    torn = placed.groupBy("key").agg((F.min("component") != F.max("component")).alias("torn")).where("torn").select("key")
    open_ = cut(placed.join(torn, "key", "left_semi").groupBy("node", "size", "component").agg(F.collect_set("least").alias("leasts")))
    if not open_.isEmpty():
        each = cut(_wholes(open_))
        sums = each.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
        many = each.join(sums, "key").withColumn("many", F.greatest(F.ceil(F.col("n") / CHUNK), F.least("n", F.ceil(F.col("total") * 8 / CHUNK_BYTES))).cast("int")).withColumn("c", F.pmod(F.xxhash64("node"), F.col("many")).cast("int"))
        dealt = many.select("key", "node", "component", F.explode(F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda o: F.struct(F.least("c", o).alias("i"), F.greatest("c", o).alias("j")))).alias("p"))
        near = dealt.join(sets, "node").groupBy("key", "p.i", "p.j").applyInArrow(lambda t: _forest(t.select(["node", "component", "set"])), "a long, b long")
        parts = components(parts.select(F.col("vertex").alias("a"), F.col("component").alias("b")).union(near))
    named = nodes.join(parts, F.col("node") == F.col("vertex"), "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    return docs.select("doc_id", "node"), named
