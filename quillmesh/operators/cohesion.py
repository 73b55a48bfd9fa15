"""Cohesion: sections, their merge, TF-IDF, cosine edges and components, per document.

A document is one row, so nothing here shuffles: built-in functions cut its
text into sections and tokens, and the algebra over a document's sections runs
in numpy over Arrow batches of whole documents. Pairs of sections are expanded
from the terms they share, a bounded number at a time, so a long document
takes time but not memory.

Relations are keyed by `doc`. `merged()` gives one row a document, with its
merged sections as an array, which the functions below it take.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as T

MIN_TOKENS = 20
#: Pairs of sections, by shared term, that are expanded at a time.
PAIRS = 2_000_000


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def _running(lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values from each list's first up to each."""
    total = np.cumsum(values)
    before = np.concatenate([[0], total])[_starts(lengths)]
    return total - np.repeat(before, lengths)


def _lists(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The lengths of lists, null ones empty, and their items."""
    return pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64), a.flatten()


def _as_lists(lengths: np.ndarray, items: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), items)


def _grouped(lengths: np.ndarray, sizes: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each section of documents with `lengths` sections: whether it opens a group, and whether it lends the group its title.

    Sections under the floor join the one before, or the first that isn't. With
    running sums the loop of merges has a closed form: the head is the first
    section at which the sum reaches the floor; a later one opens a new group
    just if it reaches the floor alone.
    """
    reached = _running(lengths, sizes) >= floor
    at = np.arange(len(sizes)) - np.repeat(_starts(lengths), lengths)
    short = _running(lengths, ~reached)
    head = np.repeat(short[np.maximum(np.cumsum(lengths) - 1, 0)] if len(sizes) else lengths, lengths)
    opens = (at == 0) | (at > head) & (sizes >= floor)
    last = at == np.repeat(lengths, lengths) - 1
    return opens, np.where(head < np.repeat(lengths, lengths), (at == head) | (at > head) & (sizes >= floor), last)


def _groups(floor: int):
    def run(sizes: pa.Array) -> pa.Array:
        lengths, items = _lists(sizes)
        opens, leads = _grouped(lengths, items.to_numpy(zero_copy_only=False).astype(np.int64), floor)
        first = np.flatnonzero(opens)
        n = np.diff(np.append(first, len(opens)))
        doc = np.repeat(np.arange(len(lengths)), lengths)
        many = np.bincount(doc[first], minlength=len(lengths)) if len(first) else np.zeros(len(lengths), np.int64)
        local = first - _starts(lengths)[doc[first]]
        lead = np.flatnonzero(leads) - _starts(lengths)[doc[np.flatnonzero(leads)]]
        return _as_lists(many, pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (lead, local, n)], names=["lead", "first", "n"]))

    return F.arrow_udf(run, "array<struct<lead: int, first: int, n: int>>")


def section_tokens(masked: Column) -> Column:
    """The tokens of each section of a text: the preamble, then one for each heading."""
    return F.transform(F.split(masked, T.HEADING, -1), T.tokens)


def _heading_lines(masked: Column) -> Column:
    """The line numbers of a text's headings; a heading is a whole line."""
    numbered = F.transform(F.split(masked, "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.filter(numbered, lambda n: n["x"].startswith("#") & n["x"].rlike(T.HEADING)), lambda n: n["i"] + 1)


def _section_arrays(rows: DataFrame, text: str) -> DataFrame:
    """doc and s, its sections in order: title, level, line, body, tokens."""
    c = F.col("_text")
    heads = F.concat(F.array(F.lit("")), F.regexp_extract_all(c, F.lit(T.HEADING), F.lit(0)))
    zipped = F.arrays_zip(F.split(c, T.HEADING, -1).alias("part"), heads.alias("head"), F.concat(F.array(F.lit(1)), _heading_lines(c)).alias("line"))

    def section(x, i):
        kind = lambda k: F.when(i > 0, F.regexp_extract(x["head"], T.HEADER_PARTS, k))
        body = F.regexp_replace(x["part"], r"\A\n+|\n+\z", "")
        return F.struct(T.strip(kind(2)).alias("title"), F.length(kind(1)).alias("level"), x["line"].alias("line"), body.alias("body"), T.tokens(x["part"]).alias("tokens"))

    return rows.select("doc", T.once(F.col(text)).alias("_text")).select("doc", T.once(F.transform(zipped, section)).alias("s"))


def sections(rows: DataFrame, text: str = "masked") -> DataFrame:
    """doc, idx, title, level, line, body and tokens of each section: the preamble, then one for each heading."""
    return _section_arrays(rows, text).select("doc", F.posexplode("s").alias("idx", "x")).select("doc", "idx", "x.*")


def merged(rows: DataFrame, floor: int = MIN_TOKENS, text: str = "masked") -> DataFrame:
    """doc and merged: an array of title, level, line, body and tokens of its sections after small ones have joined others."""
    cut = _section_arrays(rows, text)
    cut = cut.withColumn("_g", _groups(floor)(F.transform("s", lambda x: F.size(x["tokens"]))))

    def group(g):
        run, lead = F.slice("s", g["first"] + 1, g["n"]), F.get("s", g["lead"])
        return F.struct(*(lead[k].alias(k) for k in ("title", "level", "line")), F.array_join(F.transform(run, lambda x: x["body"]), "\n").alias("body"), F.flatten(F.transform(run, lambda x: x["tokens"])).alias("tokens"))

    return cut.select("doc", F.transform("_g", group).alias("merged"))


def merged_rows(docs: DataFrame) -> DataFrame:
    """doc, sec, title, level, line, body and tokens of each merged section."""
    return docs.select("doc", F.posexplode("merged").alias("sec", "x")).select("doc", "sec", "x.*")


@dataclass
class Terms:
    """Term statistics of the sections of a batch of documents; an entry is a section and a term, by document, term, section."""

    doc: np.ndarray  # of each section
    first: np.ndarray  # section of each section's document
    section: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    df: np.ndarray
    weight: np.ndarray
    words: pa.Array

    @classmethod
    def of(cls, token_lists: pa.Array, floor: int = 0) -> Terms:
        lengths, inner = _lists(token_lists)
        sizes, tokens = _lists(inner)
        if floor:
            opens, _ = _grouped(lengths, sizes, floor)
            doc = np.repeat(np.arange(len(lengths)), lengths)[opens]
            sizes = np.add.reduceat(sizes, np.flatnonzero(opens)) if len(sizes) else sizes
        else:
            doc = np.repeat(np.arange(len(lengths)), lengths)
        many = np.bincount(doc, minlength=len(lengths)) if len(doc) else np.zeros(len(lengths), np.int64)
        coded = tokens.dictionary_encode()
        codes, v = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
        of_token = np.repeat(np.arange(len(sizes)), sizes)
        pairs, tf = np.unique(of_token * v + codes, return_counts=True)
        section, term = pairs // v, pairs % v
        order = np.lexsort((section, term, doc[section]))
        section, term, tf = section[order], term[order], tf[order]
        group = doc[section] * v + term
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        runs = np.diff(np.append(head, len(group)))
        df = np.repeat(runs, runs)
        n = many[doc[section]]
        return cls(doc, np.repeat(_starts(many), many), section, term, tf, df, tf * np.log(n / df), coded.dictionary)

    def similar(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Sections a < b of a document that share a term of weight, and their cosine (six decimals); by ascending a."""
        norm = np.sqrt(np.bincount(self.section, self.weight**2, minlength=len(self.doc)))
        some = np.flatnonzero((self.df > 1) & (self.weight > 0))  # the others add nothing to a product
        section, weight, df = self.section[some], self.weight[some], self.df[some]
        at = np.arange(len(some))
        group = self.doc[section] * max(1, len(self.words)) + self.term[some]
        head = np.concatenate([[True], group[1:] != group[:-1]]) if len(some) else np.zeros(0, bool)
        later = df - 1 - (at - np.maximum.accumulate(np.where(head, at, 0))) if len(some) else at
        by = np.argsort(section, kind="stable")
        cost = np.cumsum(np.bincount(section, later, minlength=len(self.doc))).astype(np.int64)
        ends = np.searchsorted(section[by], np.arange(len(self.doc)), side="right")
        a = 0
        while a < len(self.doc):
            spent = cost[a - 1] if a else 0
            z = max(a + 1, int(np.searchsorted(cost, spent + PAIRS, side="right")))
            p = by[(ends[a - 1] if a else 0) : ends[z - 1]]
            reps = later[p]
            one = np.repeat(p, reps)
            other = one + 1 + np.arange(len(one)) - np.repeat(_starts(reps), reps)
            keys, inverse = np.unique(section[one] * len(self.doc) + section[other], return_inverse=True)
            dot = np.bincount(inverse, weight[one] * weight[other], minlength=len(keys))
            x, y = keys // len(self.doc), keys % len(self.doc)
            yield x, y, np.floor(dot / (norm[x] * norm[y]) * 1e6 + 0.5) / 1e6
            a = z

    def components(self, tau: float) -> np.ndarray:
        """For each section the first one that a chain of similarities over tau leads to."""
        label = np.arange(len(self.doc))
        for a, b, sim in self.similar():
            a, b = a[sim > tau], b[sim > tau]
            while True:
                x, y = label[a], label[b]
                apart = x != y
                if not apart.any():
                    break
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label[label] != label).any():
                    label = label[label]
        return label


def _over_terms(docs: DataFrame, schema: str, f) -> DataFrame:
    """f(doc column, Terms) -> record batches, over batches of documents."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from f(b.column("doc"), Terms.of(b.column("tokens")))

    return docs.select("doc", F.col("merged.tokens").alias("tokens")).mapInArrow(run, f"doc {kind}, {schema}")


def _batch(docs: pa.Array, at: np.ndarray, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([docs.take(pa.array(at)), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values())], names=["doc", *columns])


def terms(docs: DataFrame) -> DataFrame:
    """doc, sec, term, tf, df and w of every term of every merged section; w is tf times ln(sections / df)."""

    def run(doc, t):
        yield _batch(doc, t.doc[t.section], sec=(t.section - t.first[t.section]).astype(np.int32), term=t.words.take(pa.array(t.term)), tf=t.tf.astype(np.int64), df=t.df.astype(np.int64), w=t.weight)

    return _over_terms(docs, "sec int, term string, tf long, df long, w double", run)


def weights(docs: DataFrame) -> DataFrame:
    """doc, sec, term, w: where the weight isn't zero."""
    return terms(docs).where("w > 0").select("doc", "sec", "term", "w")


def edges(docs: DataFrame) -> DataFrame:
    """doc, a, b, sim of the pairs of merged sections (a < b) of a document that share a term of weight; six decimals."""

    def run(doc, t):
        for a, b, sim in t.similar():
            yield _batch(doc, t.doc[a], a=(a - t.first[a]).astype(np.int32), b=(b - t.first[b]).astype(np.int32), sim=sim)

    return _over_terms(docs, "a int, b int, sim double", run)


def components(docs: DataFrame, tau: float) -> DataFrame:
    """doc, sec, component (its first section): sections joined by similarities over tau."""

    def run(doc, t):
        yield _batch(doc, t.doc, sec=(np.arange(len(t.doc)) - t.first).astype(np.int32), component=(t.components(tau) - t.first).astype(np.int32))

    return _over_terms(docs, "sec int, component int", run)


def clusters(masked: Column, tau: float, floor: int = MIN_TOKENS) -> Column:
    """How many components the sections of a text fall into; 0 for null."""

    def run(tokens: pa.Array) -> pa.Array:
        t = Terms.of(tokens, floor)
        roots = t.doc[t.components(tau) == np.arange(len(t.doc))]
        return pa.array(np.bincount(roots, minlength=len(tokens)), pa.int32())

    return F.arrow_udf(run, "int")(section_tokens(masked))


def cluster_counts(rows: DataFrame, tau: float, floor: int = MIN_TOKENS, text: str = "masked") -> DataFrame:
    """doc and clusters: how many components each document's sections fall into."""
    return rows.select("doc", clusters(F.col(text), tau, floor).alias("clusters"))
