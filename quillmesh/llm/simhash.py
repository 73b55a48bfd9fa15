"""SimHash near-duplicates by pigeonhole blocks.

A document's words are joined to shingles; each shingle is hashed with XXH64;
a bit of the 64-bit fingerprint is 1 if it is set in over half the hashes.

Equal fingerprints are one node (the smallest doc_id). The fingerprint is split
into four blocks of 16 bits; two that differ in at most 2 bits agree in at least
two blocks, so the six pairs of blocks as keys bring every link together, and
the Hamming distance is verified.

A bucket of up to COLD nodes is joined with itself. Larger buckets never are:
every node of such a bucket names the 64 fingerprints one bit away and its own;
two fingerprints differ in at most 2 bits just if they share such a name, and
nodes that share one are linked to the smallest of them. Both ways are exact.

`keep_one` goes the same way with wider fingerprints, for pairs of a similarity
of shingle sets of 0.8 differ in 15 % of the bits; an exact check follows (`near`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, map_text, table, texts
from quillmesh.llm.components import components

BITS = 64
#: Differing bits up to which blocks and names find every link.
FAR = 2
#: Nodes of a bucket that is joined with itself.
COLD = 64
#: Bytes of text in a batch: its hashes take some twenty times as much.
BATCH = 2 << 20
SEED = 42
#: Odd multipliers that turn a hash into others.
_ODD = np.random.default_rng(11).integers(1 << 64, size=64, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str, words: int) -> bytes:
    """XXH64 of each shingle, big-endian, one after the other; no words, none."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return b""
    joined = b" ".join(ws)
    if len(ws) <= words:
        return xxhash.xxh64_digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    h = xxhash.xxh64_digest
    return b"".join([h(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist() if words > 1 else starts.tolist(), (ends[words - 1 :] - 1).tolist())])


def _laid_out(h: np.ndarray, counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of counts (1 or more) hashes each as columns of `rows`, padded with zeros, and each run's first column."""
    groups = -(-counts // rows)
    padded = np.zeros(int(groups.sum()) * rows, np.uint64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    into = np.concatenate([[0], np.cumsum(groups)[:-1]])
    padded[np.arange(len(h)) + np.repeat(into * rows - first, counts)] = h
    return np.ascontiguousarray(padded.reshape(-1, rows).T), into


def _over_half(x: np.ndarray, into: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of such columns (of a power of two, 128 at most) the 64-bit word of the bits set in over half of its hashes."""
    # Carry-save adders sum a column's hashes bit by bit into planes.
    planes: list[list[np.ndarray]] = [list(x), *([] for _ in range(len(x).bit_length() - 1))]
    for k in range(len(planes) - 1):
        row = planes[k]
        while len(row) > 1:
            a, b = row.pop(), row.pop()
            c = row.pop() if row else None
            t = a ^ b
            if c is None:
                row.append(t)
                planes[k + 1].append(a & b)
                break
            row.insert(0, t ^ c)
            planes[k + 1].append((a & b) | (t & c))
    sums = np.zeros((x.shape[1], 64), np.uint8)
    for k, row in enumerate(planes):
        for plane in row:
            bits = np.unpackbits(plane.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            sums += bits << k
    total = np.add.reduceat(sums, into, axis=0, dtype=np.int32)
    return np.packbits(total * 2 > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For runs of counts hashes each the 64-bit words of the bits set in over half; counts are 1 or more."""
    return _over_half(*_laid_out(h, counts, 16), counts)


def wide_fingerprints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """A row of 64-bit words for each set of hashes, none of which is empty; each word is of hashes made from these."""
    out = np.zeros((len(sets), words), np.uint64)
    if sets:
        counts = np.array([len(s) for s in sets], np.int64)
        x, into = _laid_out(np.concatenate(sets), counts, 64)
        for j in range(words):
            mixed = x * _ODD[j]  # the padding stays zero
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            out[:, j] = _over_half(mixed, into, counts)
    return out


def fingerprint_words(hashes: list[bytes]) -> np.ndarray:
    """Fingerprints of documents' hashes; of none, zero."""
    counts = np.array([len(x) // 8 for x in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = _majority(np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64), counts[some])
    return out


def fingerprints(df: DataFrame, words: int = 5) -> DataFrame:
    """doc_id and fp of every row; null text is empty. Very long texts are read whole; other columns are left out."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprint_words([shingle_hashes(t, words) for t in texts(b)])
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return map_text(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long", BATCH)


def _keys() -> list:
    part = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    return [F.shiftleft(part[i], 16).bitwiseOR(part[j]) for i in range(4) for j in range(i)]


def links(nodes: DataFrame, max_distance: int = FAR) -> DataFrame:
    """Links (a, b) that join the same components as all pairs within max_distance (FAR at most) do. nodes: node, fp, all distinct; a table."""
    if not 0 <= max_distance <= FAR:
        raise ValueError(f"max_distance must be from 0 to {FAR}")
    keyed = nodes.select("node", F.posexplode(F.array(*_keys())).alias("t", "k")).select("node", F.shiftleft(F.col("t").cast("long"), 48).bitwiseOR(F.col("k")).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(keyed.join(shared.hint("merge"), "key"))  # both grow with the corpus
    cold = members.where(F.col("n") <= COLD)
    pairs = cold.select("key", F.col("node").alias("a")).join(cold.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b").distinct()
    found = (
        pairs.join(nodes.select(F.col("node").alias("a"), F.col("fp").alias("x")), "a")
        .join(nodes.select(F.col("node").alias("b"), F.col("fp").alias("y")), "b")
        .where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_distance)
        .select("a", "b")
    )
    crowd = nodes.join(members.where(F.col("n") > COLD).select("node").distinct(), "node")
    if max_distance < 2:  # then a name must be shared with the fingerprint that it is
        one = crowd.select("node", F.col("fp").alias("name"))
        near = _named(crowd, max_distance).join(one.withColumnRenamed("node", "b"), "name").where("node > b").select(F.col("node").alias("a"), "b")
    else:
        names = _named(crowd, 1)
        centre = names.groupBy("name").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("name", "b")
        near = names.join(centre, "name").where("node <> b").select(F.col("node").alias("a"), "b")
    return found.union(near)


def _named(crowd: DataFrame, far: int) -> DataFrame:
    """node and name: each node's own fingerprint and, if far, those one bit away."""
    flips = [F.lit(0).cast("long"), *(F.lit(-(1 << 63) if i == 63 else 1 << i).cast("long") for i in range(BITS if far else 0))]
    return crowd.select("node", F.explode(F.transform(F.array(*flips), lambda f: f.bitwiseXOR(F.col("fp")))).alias("name"))


def near_duplicates(df: DataFrame, words: int = 5, max_distance: int = FAR) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (the smallest doc_id reachable over links) of every row.

    Null text is empty; documents without words, empty ones too, have fingerprint
    zero and are linked like others. Rows with a null doc_id get their
    fingerprint; they link nothing, and share the component of equal
    fingerprints, if such have an id. Repeated rows stay, and tie. Very long
    texts are read whole. An empty df gives no rows. Other columns of df,
    whatever their names, are left out.
    """
    docs = cut(fingerprints(df, words))
    nodes = cut(docs.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    parts = components(links(nodes, max_distance))
    named = nodes.join(parts, F.col("node") == F.col("vertex"), "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return docs.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at 2 or fewer differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3)


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """Of each group of near duplicates (five words, exact similarity 0.8 or more) the row with the smallest id.

    Candidates come by fingerprints, blocks and Hamming distance; links that their
    exact similarity confirms make the groups.
    Rows without an id all stay; they stand for no group. Null and empty texts
    are one group, very long ones are compared whole. Of rows that repeat an id
    and a set of shingles one stays, the first by the hash of all its columns. An
    id with rows in several groups stands for a group only where no other id can,
    and then with one row for each such group. Columns keep their
    names and values, whatever they are called. An empty df gives no rows.
    """
    from quillmesh.llm.near import similar, with_node

    rows, nodes = similar(docs, words)
    key = F.col("doc_id").cast("long")
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        stays = nodes.groupBy("component").agg(F.min("doc_id").alias("_stays")).select("_stays")
        return docs.join(stays.hint("merge"), key == F.col("_stays"), "left_semi").unionByName(docs.where("doc_id is null"))
    placed = rows.distinct().join(nodes.select("node", "component"), "node")
    torn = placed.groupBy("doc_id").agg((F.min("component") != F.max("component")).alias("torn"))
    first = F.min(F.struct("torn", "doc_id", "node"))
    stays = placed.join(torn, "doc_id").groupBy("component").agg(first.alias("s")).select("s.doc_id", "s.node")
    whole = docs.where("doc_id is not null").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = with_node(whole, words).join(stays.hint("merge"), ["doc_id", "node"], "left_semi")
    one = named.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "node").orderBy(F.xxhash64("row"))))
    return one.where("r = 1").select("row.*").unionByName(docs.where("doc_id is null"))


QUERIES = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
