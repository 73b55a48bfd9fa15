"""Connected components by alternating large and small stars.

Each round hangs every vertex's larger neighbours on its smallest neighbour
(large star), then every vertex's smaller neighbours likewise (small star);
after a logarithmic number of rounds each component is one star around its
smallest vertex. Only edges travel; a vertex with many edges is aggregated
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b) of longs: vertex and component (its smallest vertex), for every vertex with an edge to another.

    Edges may repeat and run either way; loops and edges with a null end are left out.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        stars = large.join(low, F.col("u") == F.col("w"))
        small = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("w", "m")).where("u <> v").distinct()
        e = cut(small)
        now = tuple(e.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = now
