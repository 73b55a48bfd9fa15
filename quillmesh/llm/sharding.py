"""Sharding by proportional stratified interleaving.

Each source's rows are ranked in a seeded random order (by MD5 of seed and key); row r of n takes the
fractional rank (2r - 1) / 2n; all rows are sorted by it and cut into equal
runs. Every run of the order holds each source in proportion, so every shard
matches the mixture, and shard counts are at most one apart.

A source may hold most rows, so no rank is counted in one task: the random
order is split into ranges (`RANGES` of the hash, then of the fractional
rank); a row's rank is its place in its range plus the rows in earlier ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import table

#: Ranges of a source's random order, and of the fractional rank: a power of two. A range is ranked in one task.
RANGES = 4096


def shard_rows(df: DataFrame, key: str, shards: int, stratum: str = "source", seed: int = 7, order_by: list[str] | None = None) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in each shard) to df.

    Null strata are a stratum of their own, and null keys are shuffled like the
    empty text. Rows with the same key are ordered by `order_by`, else
    arbitrarily; repeated rows each get a slot. An empty df gives no rows.
    Columns of df, long texts among them, keep their names and values, whatever
    they are called; `shard` and `slot` are replaced if they exist.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("s"),
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long").alias("h"),
    ).withColumn("b", F.shiftright("h", 60 - (RANGES.bit_length() - 1)))
    ties = [F.col(f"row.`{c}`") for c in [key, *(order_by or [])]]

    by_source = Window.partitionBy("s")
    ranges = (
        rows.groupBy("s", "b")
        .agg(F.count("*").alias("n_b"))
        .withColumn("before", F.sum("n_b").over(by_source.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("n", F.sum("n_b").over(by_source))
        .select("s", "b", F.coalesce("before", F.lit(0)).alias("before"), "n")
    )
    ranked = rows.join(ranges, ["s", "b"]).withColumn("r", F.col("before") + F.row_number().over(Window.partitionBy("s", "b").orderBy("h", *ties)))
    ranked = ranked.withColumn("f", F.expr(f"(2 * r - 1) * {RANGES} div (2 * n)"))

    # How many rows fall in each range of the fractional rank follows from the sources' sizes alone.
    upto = f"((2 * n * (f + 1) + {RANGES - 1}) div {RANGES}) div 2"
    sizes = rows.groupBy("s").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") <= RANGES).select("n", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("r")).select(F.expr(f"(2 * r - 1) * {RANGES} div (2 * n)").alias("f"), F.lit(1).cast("long").alias("k"))
    large = sizes.where(F.col("n") > RANGES).select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(RANGES - 1).cast("long"))).alias("f")).select("f", F.expr(f"{upto} - {upto.replace('(f + 1)', 'f')}").alias("k"))
    cuts = (
        small.union(large)
        .groupBy("f")
        .agg(F.sum("k").alias("k"))
        .withColumn("ahead", F.coalesce(F.sum("k").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("total", F.sum("k").over(Window.partitionBy()))
        .select("f", "ahead", "total")
    )  # at most RANGES rows
    spread = Window.partitionBy("f").orderBy(F.expr("(2 * r - 1) / (2 * n)"), "s", "r")
    g = ranked.withColumn("i", F.row_number().over(spread)).join(F.broadcast(cuts), "f").withColumn("g", F.col("ahead") + F.col("i") - 1)
    return g.withColumn("shard", F.expr(f"int(g * {shards} div total)")).select("row.*", "shard", F.expr(f"g - (shard * total + {shards - 1}) div {shards}").alias("slot"))


def op9_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law `rows`."""
    docs = table(spark, sf_dir, "documents")
    slim = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_rows(slim, "doc_id", 8, order_by=["size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def _crc_table() -> list[int]:
    """CRC-32 of each byte's remainder, by the reflected polynomial."""
    out = []
    for v in range(256):
        for _ in range(8):
            v = (v >> 1) ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


QUERIES = {"op9_shards": op9_shards}
ORACLES = {
    "op9_shards": f"""WITH d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, ('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, {_crc_table()}[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents),
    r AS (SELECT *, coalesce('=' || source, '') AS s, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, text_crc32) AS r, count(*) OVER (PARTITION BY source) AS n FROM d),
    g AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n), s, r) - 1 AS g, count(*) OVER () AS total FROM r)
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(g * 8 // total AS INT) AS shard, g - ((g * 8 // total) * total + 7) // 8 AS slot, NULL::INT AS grown_shard, source FROM g"""
}
