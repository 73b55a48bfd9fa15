"""Quality classifier: a linear-chain conditional random field over lines.

Every line is labelled good or bad from its own features and those of the
lines before and after it. A document's quality is the mean of its lines'
forward-backward marginals, weighted by their lengths, mapped to a probability
by a logistic curve.

The field is trained on at most about LABELLED labelled documents (picked by
the hash of their ids), each line taking its document's label; the curve on
the same documents. Scoring takes whole texts, in one pass without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import crf
from quillmesh.llm.common import crc32_mod, map_text, table, texts

#: Labelled documents that the field is trained on, in expectation.
LABELLED = 4_000
THRESHOLD = 0.3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_SYMBOL = b"#$%&*+/<=>@[\\]^_`{|}~"
_CALLS = b"!?"
_STOPS = b".,;:"
_HIGH = bytes(range(128, 256))

FEATURES = ("one", "length", "upper", "digits", "symbols", "pipes", "calls", "stops", "high", "word_length", "distinct", "short_words", "closed", "opened", "repeated", "brief", "many_symbols", "shouted", "table", "looped", "doubled")
_NEAR = [FEATURES.index(f) for f in ("length", "upper", "symbols", "pipes", "calls", "distinct", "repeated", "many_symbols", "shouted", "table", "doubled")]


def line_features(text: str) -> tuple[list[tuple], list[int]]:
    """A row of features for each line that isn't blank, and its bytes; a text without such lines has one empty line."""
    lines = [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x and not x.isspace()] or [b""]
    times: dict[bytes, int] = {}
    for x in lines:
        times[x] = times.get(x, 0) + 1
    rows = []
    for x in lines:
        n = len(x)
        m = max(1, n)
        upper = n - len(x.translate(None, _UPPER))
        lower = n - len(x.translate(None, _LOWER))
        digits = (n - len(x.translate(None, _DIGIT))) / m
        symbols = (n - len(x.translate(None, _SYMBOL))) / m
        calls = (n - len(x.translate(None, _CALLS))) / m
        stops = (n - len(x.translate(None, _STOPS))) / m
        high = (n - len(x.translate(None, _HIGH))) / m
        pipes = x.count(b"|") / m
        words = x.split()
        k = max(1, len(words))
        distinct = len(set(words)) / k
        shout = upper / max(1, upper + lower)
        rows.append(
            (
                1.0,
                math.log1p(n) / 5,
                shout,
                min(1.0, digits * 5),
                min(1.0, symbols * 5),
                min(1.0, pipes * 10),
                min(1.0, calls * 5),
                min(1.0, stops * 10),
                high,
                min(2.0, n / k / 8),
                distinct if k > 20 else 1.0,
                sum(len(w) < 4 for w in words) / k,
                1.0 if x[-1:] in (b".", b"!", b"?", b'"') else 0.0,
                1.0 if x[:1].isupper() or x[:1] >= b"\x80" else 0.0,
                1.0 if times[x] > 1 else 0.0,
                1.0 if n < 20 else 0.0,
                1.0 if symbols > 0.06 else 0.0,
                1.0 if shout > 0.4 and k > 2 else 0.0,
                1.0 if pipes > 0.03 else 0.0,
                1.0 if k > 30 and distinct < 0.5 else 0.0,
                min(1.0, sum(map(eq, words, words[1:])) / k * 3),
            )
        )
    return rows, [max(1, len(x)) for x in lines]


def document_features(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (their own, then some of the line before and the line after), lines a document, and bytes a line."""
    rows, sizes, counts = [], [], []
    for t in docs:
        r, s = line_features(t)
        rows += r
        sizes += s
        counts.append(len(r))
    own = np.array(rows, np.float64).reshape(-1, len(FEATURES))
    lengths = np.array(counts, np.int64)
    ends = np.cumsum(lengths)
    before, after = np.zeros((len(own), len(_NEAR))), np.zeros((len(own), len(_NEAR)))
    before[1:], after[:-1] = own[:-1, _NEAR], own[1:, _NEAR]
    before[ends - lengths] = 0
    after[ends - 1] = 0
    return np.hstack([own, before, after]), lengths, np.array(sizes, np.float64)


@dataclass
class LineField:
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    level: float = 0.0
    share: float = 0.5

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each line's probability of being good."""
        return crf.forward_backward(x @ self.weights, self.trans, crf.Layout(lengths))[0][:, 1]

    def raw(self, docs: list[str]) -> np.ndarray:
        """The length-weighted means of the marginals."""
        x, lengths, sizes = document_features(docs)
        first = np.cumsum(lengths) - lengths
        return np.add.reduceat(self.marginals(x, lengths) * sizes, first) / np.add.reduceat(sizes, first)

    def score(self, docs: list[str]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        p = np.clip(self.raw(docs), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.level)))


def train(docs: list[str], labels: list[int]) -> LineField:
    """A field from texts and their labels (1: good). With one class only, every score is that class's smoothed share."""
    y = np.array(labels, np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    base = np.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        n = len(FEATURES) + 2 * len(_NEAR)
        return LineField(np.zeros((n, 2)), np.zeros((2, 2)), 0.0, float(base), float(share))
    x, lengths, _ = document_features(docs)
    w, t = crf.fit(x, np.repeat(y, lengths), lengths, 2)
    field = LineField(w, t, share=float(share))
    p = np.clip(field.raw(docs), 1e-6, 1 - 1e-6)
    z = np.log(p / (1 - p))

    def loss(v):
        s = v[0] * z + v[1]
        q = 1 / (1 + np.exp(-s))
        value = (np.logaddexp(0, s) - y * s).sum() + 0.5 * (v @ v)
        return value / len(y), np.array([((q - y) * z).sum() + v[0], (q - y).sum() + v[1]]) / len(y)

    v = crf.minimise(loss, np.array([0.5, 0.0]))
    field.slope, field.level = float(v[0]), float(v[1])
    return field


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> LineField:
    """Trains on about `bound` of the labelled documents that aren't held out; labels: doc_id and quality (0 or 1; null is no label; of several the least counts)."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(crc32_mod("doc_id", 5) != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = known.count()
    share = min(1.0, bound / max(1, total))
    picked = known.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")), "doc_id").select("text", "quality").collect()  # about `bound` rows
    rows = sorted((r["text"] or "", int(r["quality"])) for r in rows)
    return train([t for t, _ in rows], [q for _, q in rows])


def score(df: DataFrame, field: LineField) -> DataFrame:
    """doc_id and score of every row.

    Null text is empty, and an empty text is scored as one empty line; null
    doc_ids stay null. Very long texts are scored whole. Repeated rows stay and
    tie. An empty df gives no rows. Other columns, whatever their names, are
    left out.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(field.score(texts(b)), pa.float64())], names=["doc_id", "score"])

    return map_text(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")


def keep_good(docs: DataFrame, field: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with all their columns, whatever those are called; nulls, long texts and repeated rows as score() has them."""
    names = docs.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(field.score(texts(b)) >= threshold))

    return map_text(docs.select(*(F.col(f"`{c}`") for c in names)), run, docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    docs = table(spark, sf_dir, "documents")
    field = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, field).select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
