"""Recall of op10's search against brute force, where cells hold more vectors than are compared at once."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmesh.llm import ann


def clustered(n):
    rng = np.random.default_rng(n)
    return rng.normal(size=(20, 64))[rng.integers(20, size=n)] + 0.7 * rng.normal(size=(n, 64))


def as_table(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")


def nearest(ids, x, q, k=20):
    s = x @ x[q]
    s[q] = -np.inf
    return ids[np.lexsort((ids, -s))[:k]].tolist()


def recall(rows, ids, x):
    got: dict[int, set] = {}
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    return np.mean([len(got[int(ids[q])] & set(nearest(ids, x, q))) / 20 for q in np.flatnonzero(ids % 20 == 0)])


@pytest.mark.parametrize("n", [1000, 1400, 2000, 6000])
def test_recall(spark, n, monkeypatch):
    """With small cells and parts, as if the table were large, so that the graph and the walk have work to do."""
    monkeypatch.setattr(ann, "CELL", 400)
    monkeypatch.setattr(ann, "PART", 400)
    if n > 2000:
        ids, x = np.arange(n), clustered(n)
    else:
        rows = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/embeddings.parquet").orderBy("vec_id").limit(n).collect()
        ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    assert recall(ann.search(as_table(spark, ids, x), F.col("vec_id") % 20 == 0).collect(), ids, x) >= 0.9


def test_descent_and_walk_improve_on_the_blocks(spark, monkeypatch):
    """Vectors without clusters: the blocks alone find few neighbours, the rounds more, the walk nearly all."""
    monkeypatch.setattr(ann, "CELL", 200)
    monkeypatch.setattr(ann, "PART", 200)
    n = 4000
    ids, x = np.arange(n), np.random.default_rng(1).normal(size=(n, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(int(i), c) for i, c in zip(ids, ann.encode(x))], "node long, code binary").cache()

    def found(graph):
        top = Window.partitionBy("query_id").orderBy(F.desc("s"))
        rows = graph.where("node % 20 = 0").select(F.col("node").alias("query_id"), F.col("other").alias("vec_id"), "s").withColumn("r", F.row_number().over(top)).where("r <= 20")
        return recall(rows.collect(), ids, x)

    blocks = found(ann._keep_best(ann._blocks(vectors, 32)[1], 32))
    graph = ann.neighbour_graph(vectors, 32)
    descent = found(graph)
    walked = found(ann.walk(graph, vectors, vectors.where("node % 20 = 0").select("node"), 20))
    assert blocks + 0.1 < descent < walked and walked >= 0.9


def test_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 20)
    rng = np.random.default_rng(2)
    ids, x = np.arange(1500), rng.normal(size=(1500, 8))
    x[100:160] = x[100]
    rows = ann.search_exact(as_table(spark, ids, x), F.col("vec_id") % 20 == 0, k=7).collect()
    for q in range(0, 1500, 20):
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == nearest(ids, x, q, 7) and [r["rank"] for r in mine] == list(range(1, 8))
    assert ann.search_exact(as_table(spark, ids[:0], x[:0]), F.col("vec_id") % 20 == 0).count() == 0
