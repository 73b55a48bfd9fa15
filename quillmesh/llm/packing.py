"""Packing documents into sequences by patterns of lengths.

Only the histogram of piece lengths reaches the driver: at most `capacity`
counts, whatever the corpus. On it:

1. lengths are grouped into BINS bins, and every pattern of up to PART bins
   that fills a sequence is enumerated;
2. non-negative least squares fits how often each pattern repeats, so that the
   patterns' counts meet the histogram; the repeats are rounded down;
3. each pattern is filled with actual lengths that make up a sequence exactly,
   as often as it should repeat and such lengths are left;
4. what is left is packed best-fit, longest first.

The result is a list of runs: the pieces of one length with ranks from `first`
on go, one each, to the sequences from `sequence` on, all at one offset. Its
size follows the number of lengths, not of pieces. A length that holds more
than RANKED pieces is dealt into salted groups, so that many tasks rank it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, map_text, table, texts
from quillmesh.llm.word_tokens import BATCH, MEMO_NAME, encoder

BINS = 64
PART = 4
#: Pieces of one length that are ranked in one task; more are dealt into groups.
RANKED = 500_000


def patterns(bins: int, part: int) -> list[tuple[int, ...]]:
    """Every way to write bins as a sum of up to `part` positive integers, largest first."""

    def grow(left: int, most: int, n: int):
        if not left:
            yield ()
        elif n:
            for k in range(min(left, most), 0, -1):
                if k * n < left:
                    break
                for rest in grow(left - k, k, n - 1):
                    yield (k, *rest)

    return list(grow(bins, bins, part))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 with least |a x - b|, by an active set."""
    x = np.zeros(a.shape[1])
    free = np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        if not len(w) or w.max() <= tol:
            break
        free[int(w.argmax())] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (s <= 0)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + min(1.0, step) * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x = s
    return x


def plan(histogram: dict[int, int], capacity: int, bins: int = BINS, part: int = PART) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first, n, sequence, offset), and the number of sequences."""
    left = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        if not 0 < n <= capacity:
            raise ValueError(f"a length of {n} doesn't fit a sequence of {capacity}")
        left[n] += k
    stock = [n for n in range(1, capacity + 1) if left[n]]  # ascending, those with pieces left

    def take(n: int, k: int) -> None:
        left[n] -= k
        if not left[n]:
            del stock[bisect_left(stock, n)]

    done: list[tuple[int, tuple[int, ...]]] = []  # so many sequences hold these lengths
    still: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by the space left
    spaces: list[int] = []

    def put(k: int, held: tuple[int, ...]) -> None:
        space = capacity - sum(held)
        if not space:
            done.append((k, held))
            return
        if space not in still:
            still[space] = []
            insort(spaces, space)
        still[space].append((k, held))

    width = -(-capacity // bins)
    binned = np.zeros(bins + 1)
    for n in stock:
        binned[min(bins, -(-n // width))] += left[n]
    forms = [p for p in patterns(bins, part) if all(binned[k] for k in p)]
    if forms:
        a = np.zeros((bins + 1, len(forms)))
        for j, p in enumerate(forms):
            for k in p:
                a[k, j] += 1
        repeats = np.floor(nnls(a, binned) + 1e-9).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            count = int(repeats[j])
            choices = [[n for n in range(min(capacity, k * width), (k - 1) * width, -1) if left[n]] for k in forms[j][:-1]] if count else []
            for held in product(*choices) if count else ():
                last = capacity - sum(held)
                if not 0 < last <= capacity or not left[last]:
                    continue
                held = (*held, last)
                m = min(count, *(int(left[n]) // held.count(n) for n in held))
                if m:
                    for n in set(held):
                        take(n, m * held.count(n))
                    put(m, held)
                    count -= m
                    if not count:
                        break

    while stock:
        n = stock[-1]
        count = int(left[n])
        at = bisect_left(spaces, n)
        if at < len(spaces):
            space = spaces[at]
            k, held = still[space].pop()
            if not still[space]:
                del still[space], spaces[at]
            m = min(k, count)
            take(n, m)
            put(m, (*held, n))
            if k > m:
                put(k - m, held)
        else:
            each = capacity // n
            take(n, count)
            if count // each:
                put(count // each, (n,) * each)
            if count % each:
                put(1, (n,) * (count % each))
    runs, sequence, ranks = [], 0, {}
    for count, held in chain(done, *(still[s] for s in spaces)):
        offset = 0
        for n in held:
            first = ranks.get(n, 0)
            runs.append((n, first, count, sequence, offset))
            ranks[n] = first + count
            offset += n
        sequence += count
    return runs, sequence


def cut_pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit).

    Null or empty text is one piece, the end id. Null doc_ids stay null; repeated
    rows are pieces of their own. A very long text is encoded whole and cut. An
    empty df gives no rows. Columns of df besides doc_id and text are left out.
    """
    end = int(end_id).to_bytes(4, "little")
    size = 4 * capacity
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for k, ids in zip(b.column("doc_id").to_pylist(), encoder(tokenizer).encode(texts(b))):
            ids += end
            for i in range(0, len(ids), size):
                p = ids[i : i + size]
                out.append((k, i // size, i // 4, len(p) // 4, zlib.crc32(p), *([p] if with_ids else [])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], names=[n for n, _ in fields])

    slim = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_text(slim, run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""), BATCH, MEMO_NAME)


def place(rows: DataFrame, capacity: int, by: list[str]) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to capacity; `by` orders pieces of one length.

    rows is read twice, so it should be a table or a checkpoint. No rows, no
    sequences. Rows that tie in `by` are placed in any order; repeated rows are
    pieces of their own. Other columns of rows keep their names and values,
    whatever they are called, but for sequence_id and offset, which are replaced.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    slim = rows.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col("length").cast("long").alias("len"))
    histogram = {r["len"]: r["count"] for r in slim.groupBy("len").count().collect()}  # at most `capacity` rows
    large = [(n, -(-k // RANKED)) for n, k in histogram.items() if k > RANKED]
    dealt = spark.createDataFrame(large, "len long, groups int")  # at most `capacity` rows
    salt = F.pmod(F.xxhash64(*(F.col(f"row.`{c}`") for c in by)), F.col("groups")).cast("int")
    keyed = slim.join(F.broadcast(dealt), "len", "left").select("row", "len", F.coalesce(salt, F.lit(0)).alias("salt"))
    before = {(n, 0): 0 for n in histogram}
    if large:
        ahead: dict[int, int] = {}
        for r in sorted(keyed.where(F.col("len").isin([n for n, _ in large])).groupBy("len", "salt").count().collect()):  # one for each RANKED pieces
            before[r["len"], r["salt"]] = ahead.get(r["len"], 0)
            ahead[r["len"]] = before[r["len"], r["salt"]] + r["count"]
    runs, _ = plan(histogram, capacity)
    starts = spark.createDataFrame([(*k, n) for k, n in before.items()], "len long, salt int, before long")
    placed = spark.createDataFrame(runs, "run_len long, first long, n long, sequence long, at long")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("len", "salt").orderBy(*(F.col(f"row.`{c}`") for c in by))) - 1
    # Both sides follow from the lengths: a start for each and for each RANKED pieces, and a few runs for each.
    ranked = keyed.join(F.broadcast(starts), ["len", "salt"]).withColumn("rank", rank)
    fits = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    out = ranked.join(F.broadcast(placed), (F.col("len") == F.col("run_len")) & fits)
    return out.select(*(F.col(f"row.`{c}`") for c in kept), (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("at").alias("offset"))


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Every piece of every document with its sequence and its place there; nulls, empty and long texts, repeated rows and other columns as cut_pieces() and place() have them."""
    return place(cut(cut_pieces(df, tokenizer, end_id, capacity)), capacity, ["doc_id", "piece", "ids_crc32"])


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
