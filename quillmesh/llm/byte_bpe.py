"""Byte-level BPE by corpus-level merge replay.

A batch of documents is a small corpus: its distinct words are laid out once
as a linked row of byte symbols, with an inverted index from the token that a
pair of neighbours makes to the places where such pairs stand. Tokens are
taken in rank order; each merges all its places, left to right, and only the
touched neighbours are indexed anew. Words are independent of each other, so
this gives for each the merges that encoding it alone would give. (Were a merge
to make a pair of lower rank, as a vocabulary that isn't BPE-trained might, the
word is encoded alone.)

A worker remembers the ids of up to MEMO words and text parts; when full it
starts afresh, so memory is bounded and results don't depend on it. No shuffle.
"""

from __future__ import annotations

import base64
import gc
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import map_text, pieces, remember, ship, table, texts

MEMO = 360_000
MEMO_CHARS = 64
#: Distinct words whose merges are replayed together, and bytes of text or ids in a batch.
WORDS = 150_000
BATCH = 3 << 20
#: Parts text parts from each other where many are split at once, and ends a part among ids.
_PART, _END = "\0", b"\xff\xff\xff\xff"

#: White space as Unicode's White_Space property has it, for character classes.
_WS = "\t-\r \x85\xa0  -     　"
#: A space before more white space, or at the end: there text can't be parted at spaces.
_UNEVEN = re.compile(f" (?![^{_WS}])")
_RUNS = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")

_coders: dict[tuple[str, str], ByteBPE] = {}
_vocabularies: dict[str, Vocabulary] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """The bytes of ids."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.raw[np.arange(int(ends[-1]) if len(ids) else 0) + np.repeat(self.starts[ids] - (ends - sizes), sizes)]


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        none = len(self.tokens)
        self.byte_pairs = np.array([self.ranks.get(bytes([a, b]), none) for a in range(256) for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        # \s as White_Space everywhere: the regex module's own takes in U+001C to U+001F.
        spelt = pattern.replace(r"[^\s", f"[^{_WS}").replace(r"\S", f"[^{_WS}]").replace(r"\s", f"[{_WS}]")
        self.split = regex.compile(spelt).findall
        apart = spelt.replace(f"[^{_WS}", f"[^{_PART}{_WS}", 1)
        self.split_parts = regex.compile(f"{_PART}|{apart}").findall if f"[^{_WS}" in spelt else None
        self.words: dict[str, bytes] = {_PART: _END}
        self.after_space: dict[str, bytes] = {}  # by the text after the space
        self.plain: dict[str, bytes] = {}

    def _made(self, keys: list[int]) -> list[int]:
        """The token that each pair of neighbours makes (left << 32 | right), or -1."""
        pairs, ranks, tokens = self.pairs, self.ranks, self.tokens
        if len(pairs) > MEMO // 2:
            pairs.clear()
        out = list(map(pairs.get, keys))
        for i, q in enumerate(out):
            if q is None:
                k = keys[i]
                out[i] = pairs[k] = ranks.get(tokens[k >> 32] + tokens[k & 0xFFFFFFFF], -1)
        return out

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers. Words have a byte at least."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        sym = self.byte_ids[raw]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1] = -1
        prv[ends - sizes] = -1
        now = np.full(n, -1, np.int64)  # the token that the pair beginning here makes
        if n > 1:
            now[:-1] = self.byte_pairs[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        now[(nxt < 0) | (now >= len(self.tokens))] = -1
        places = np.flatnonzero(now >= 0)
        order = places[np.argsort(now[places], kind="stable")]
        found, first = np.unique(now[order], return_index=True)
        index = {r: [p] for r, p in zip(found.tolist(), np.split(order, first[1:]))} if len(order) else {}
        heap = list(index)
        heapq.heapify(heap)
        again: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            todo = index.pop(r)
            at = todo[0] if len(todo) == 1 else np.unique(np.concatenate(todo))
            at = at[now[at] == r]  # an earlier merge may have taken one of the two
            if not len(at):
                continue
            right = nxt[at]
            chained = right[:-1] == at[1:]
            if chained.any():  # as in aaaa: of overlapping places every other one
                i = np.arange(len(at))
                start = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), i, 0))
                at = at[(i - start) & 1 == 0]
                right = nxt[at]
            after = nxt[right]
            sym[at], sym[right], now[right], now[at], nxt[at] = r, -1, -1, -1, after
            inner = after >= 0
            prv[after[inner]] = at[inner]
            before = prv[at]
            touched = np.concatenate([at[inner], before[before >= 0]])
            if not len(touched):
                continue
            keys, which = np.unique(sym[touched] << 32 | sym[nxt[touched]], return_inverse=True)
            made = self._made(keys.tolist())
            now[touched] = np.array(made)[which]
            by_key = touched[np.argsort(which, kind="stable")]
            start = 0
            for q, end in zip(made, np.cumsum(np.bincount(which)).tolist()):
                if q >= 0:
                    if q < r:
                        again.update(np.searchsorted(ends, by_key[start:end], side="right").tolist())
                    if q in index:
                        index[q].append(by_key[start:end])
                    else:
                        index[q] = [by_key[start:end]]
                        heapq.heappush(heap, q)
                start = end
        kept = sym >= 0
        upto = (np.cumsum(kept)[ends - 1] * 4).tolist()
        ids = sym[kept].astype("<u4").tobytes()
        out = [ids[a:b] for a, b in zip([0, *upto[:-1]], upto)]
        for i in again:  # a merge made a pair of lower rank, which comes before the merge's other places in the word
            out[i] = self._alone(words[i])
        return out

    def _alone(self, word: bytes) -> bytes:
        """The ids of one word: the lowest pair, the first of equals, again and again."""
        parts = [int(self.byte_ids[b]) for b in word]
        while len(parts) > 1:
            made = self._made([a << 32 | b for a, b in zip(parts, parts[1:])])
            r, i = min(((q, i) for i, q in enumerate(made) if q >= 0), default=(-1, 0))
            if r < 0:
                break
            parts[i : i + 2] = [r]
        return np.array(parts, "<u4").tobytes()

    def _learn(self, parts: list[str]) -> list[bytes]:
        """The ids of text parts, by way of their distinct words."""
        joined = _PART.join(parts)
        if self.split_parts and joined.count(_PART) == len(parts) - 1:
            flat = self.split_parts(joined)
            return self._ids(flat).split(_END)
        # A text holds the separator itself, or the pattern has no class to keep it out of.
        return [b"".join(self.replay([w.encode("utf-8", "surrogatepass") for w in self.split(p)])) if p else b"" for p in parts]

    def _ids(self, flat: list[str]) -> bytes:
        found = list(map(self.words.get, flat))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = list({flat[i] for i in missing})
            got = {}
            for i in range(0, len(new), WORDS):
                some = new[i : i + WORDS]
                got.update(zip(some, self.replay([w.encode("utf-8", "surrogatepass") for w in some])))
            for i in missing:
                found[i] = got[flat[i]]
            if len(self.words) + len(got) > MEMO:
                self.words = {_PART: _END}
            self.words.update((w, ids) for w, ids in got.items() if len(w) <= MEMO_CHARS)
        return b"".join(found)

    def _memo(self, name: str, parts: list[str], lead: str) -> list[bytes]:
        memo = getattr(self, name)
        found = list(map(memo.get, parts))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = list({parts[i] for i in missing})
        got = dict(zip(new, self._learn([lead + p for p in new]))) if new else {}
        for i in missing:
            found[i] = got[parts[i]]
        if len(memo) + len(got) > MEMO // 2:
            memo.clear()
        memo.update((p, ids) for p, ids in got.items() if len(p) <= MEMO_CHARS)
        return found

    def encode(self, docs: list[str]) -> list[bytes]:
        """For each text its ids; an empty text has none."""
        spaced: list[str] = []
        plain: list[str] = []
        shape = []
        for t in docs:
            if _UNEVEN.search(t):
                runs = _RUNS.findall(t)
                plain += runs
                shape.append((len(runs), 0))
            else:
                first, *rest = t.split(" ")
                plain.append(first)
                spaced += rest
                shape.append((1, len(rest)))
        a = self._memo("plain", plain, "")
        b = self._memo("after_space", spaced, " ")
        out, i, j = [], 0, 0
        for m, n in shape:
            out.append(b"".join(a[i : i + m]) + b"".join(b[j : j + n]))
            i, j = i + m, j + n
        return out


def coder(path: str, pattern: str) -> ByteBPE:
    """The worker's coder for a rank file and the pattern that parts words."""
    if (path, pattern) not in _coders:
        gc.set_threshold(500_000, 20, 100)  # millions of strings live on in the memo; none is part of a cycle
        _coders[path, pattern] = ByteBPE(path, pattern)
    remember("byte_bpe", _coders.clear)
    return _coders[path, pattern]


def encode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row.

    Null text is empty, and an empty text has no ids; null doc_ids stay null.
    Very long texts are encoded whole. Repeated rows stay. An empty df gives no
    rows. Other columns, whatever their names, are left out.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = coder(path, pattern).encode(texts(b))
        ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(rows), "<i4")))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), ids], names=["doc_id", "ids"])

    return map_text(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, ids array<int>", BATCH, "byte_bpe")


def decode(df: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded (the bytes) of every row; null ids are none. Repeated rows stay, an empty df gives no rows, other columns are left out."""

    def run(batches):
        if path not in _vocabularies:
            _vocabularies[path] = Vocabulary(path)
        vocabulary = _vocabularies[path]
        for b in pieces(batches, "ids", BATCH // 2):
            lists = b.column("ids").fill_null([])
            ids = np.asarray(lists.flatten())
            counts = np.asarray(lists.value_lengths(), np.int64)
            ends = np.concatenate([[0], np.cumsum(vocabulary.sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
            decoded = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(vocabulary.decode(ids))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), decoded], names=["doc_id", "ids", "decoded"])

    ship(df.sparkSession)
    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    import public_tokenizers as public

    path = public.path("byte_bpe_50k.tiktoken")
    coded = decode(encode(table(spark, sf_dir, "documents"), path, public.PATTERN), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
ORACLES: dict[str, str] = {}
