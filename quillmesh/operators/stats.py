"""Corpus statistics and diagnostics summaries, each one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("conformant", "partial", "non_conformant")
SEVERITIES = ("error", "warning")
TIERS = ("core", "profile", "hygiene")


def link_counts(wiki: DataFrame, md: DataFrame) -> DataFrame:
    """One row: total, broken and ambiguous wikilinks, total and broken Markdown links."""
    w = wiki.agg(F.count("*").alias("total_wikilinks"), F.count_if("broken").alias("broken_wikilinks"), F.count_if("ambiguous").alias("ambiguous_wikilinks"))
    m = md.agg(F.count("*").alias("total_markdown_links"), F.count_if("broken").alias("broken_markdown_links"))
    return w.crossJoin(m)  # one row each


def corpus_stats(files: DataFrame) -> DataFrame:
    """One row of totals over rows with is_reserved, okf_status, lines, chars."""
    concept = ~F.col("is_reserved")
    return files.agg(
        F.count("*").alias("total_files"),
        F.count_if(concept).alias("total_concept_files"),
        F.count_if("is_reserved").alias("total_reserved_files"),
        F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("total_lines"),
        F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("total_chars"),
        *(F.count_if(concept & (F.col("okf_status") == s)).alias(s) for s in STATUSES),
    )


def diagnostics_summary(found: DataFrame) -> DataFrame:
    """kind (severity, tier or code), value and n; severities and tiers that don't occur have 0."""
    each = found.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("severity", "tier", "code")))).alias("x")).select("x.*", F.lit(1).alias("one"))
    spark = found.sparkSession
    zero = spark.createDataFrame([*(("severity", s, 0) for s in SEVERITIES), *(("tier", t, 0) for t in TIERS)], "kind string, value string, one int")
    return each.unionByName(zero).groupBy("kind", "value").agg(F.sum("one").cast("long").alias("n"))


def root_counts(files: DataFrame, roots: list[str]) -> DataFrame:
    """root and file_count, for every declared root."""
    spark = files.sparkSession
    declared = spark.createDataFrame([(n, r) for n, r in enumerate(roots)], "root_ord int, root string")
    counts = files.groupBy("root_ord").agg(F.count("*").alias("file_count"))
    return declared.join(counts, "root_ord", "left").select("root_ord", "root", F.coalesce("file_count", F.lit(0)).alias("file_count"))


def exit_code(found: DataFrame) -> DataFrame:
    """One row: 1 if any diagnostic is an error, and how many of each severity."""
    return found.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).cast("int").alias("exit_code"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
