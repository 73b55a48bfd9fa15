"""Directory listings: one text for each directory that holds Markdown."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.files import fm_text, is_true


def directories(files: DataFrame) -> DataFrame:
    """root_ord, dir, parent, own of every directory that holds a file, directly or below; the root is ''."""
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    upto = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = files.select("root_ord", F.explode(upto).alias("dir")).distinct()
    return dirs.withColumn("own", F.substring_index("dir", "/", -1)).withColumn("parent", F.when(F.col("dir") == "", F.lit(None)).when(F.instr("dir", "/") > 0, F.regexp_replace("dir", "/[^/]*\\z", "")).otherwise(""))


def entries(rows: DataFrame, reserved: dict[str, str]) -> DataFrame:
    """root_ord, dir, name, title and description of every file that is listed; rows are parsed."""
    hidden = [reserved.get("index", "index.md"), reserved.get("log", "log.md")]
    return rows.where(~F.col("name").isin(hidden)).select("root_ord", "dir", "name", F.when(is_true("title"), fm_text("title")).otherwise(F.col("stem")).alias("title"), F.when(is_true("description"), fm_text("description")).alias("description"))


def listings(rows: DataFrame, reserved: dict[str, str], roots: int = 1) -> DataFrame:
    """root_ord, dir and expected: subdirectories, then files, each sorted without regard to case."""
    spark = rows.sparkSession
    dirs = directories(rows).unionByName(spark.createDataFrame([(n, "", "", None) for n in range(roots)], "root_ord int, dir string, own string, parent string").select("root_ord", "dir", "own", "parent")).distinct()
    sub = dirs.where("parent is not null").select("root_ord", F.col("parent").alias("dir"), F.lit(0).alias("k"), F.col("own").alias("name"), F.concat(F.lit("- ["), "own", F.lit("/]("), "own", F.lit("/index.md)")).alias("line"))
    found = entries(rows, reserved)
    tail = F.when(F.col("description").isNotNull(), F.concat(F.lit(" — "), "description")).otherwise("")
    files = found.select("root_ord", "dir", F.lit(1).alias("k"), "name", F.concat(F.lit("- ["), "title", F.lit("]("), "name", F.lit(")"), tail).alias("line"))
    lines = sub.unionByName(files).groupBy("root_ord", "dir").agg(F.sort_array(F.collect_list(F.struct("k", F.lower("name").alias("low"), "name", "line"))).alias("x"))
    text = F.when(F.size("x") > 0, F.concat(F.array_join("x.line", "\n"), F.lit("\n"))).otherwise("")
    return dirs.select("root_ord", "dir").join(lines, ["root_ord", "dir"], "left").select("root_ord", "dir", F.coalesce(text, F.lit("")).alias("expected"))


def changed(expected: DataFrame, current: DataFrame) -> DataFrame:
    """The listings whose text differs from current (root_ord, dir, content); a missing one counts as empty."""
    both = expected.join(current.select("root_ord", "dir", "content"), ["root_ord", "dir"], "left")
    return both.where(F.col("expected") != F.coalesce("content", F.lit("")))


def diff_texts(current: pa.Array, expected: pa.Array, path: pa.Array) -> pa.Array:
    out = []
    for a, b, p in zip(current.to_pylist(), expected.to_pylist(), path.to_pylist()):
        out.append("".join(difflib.unified_diff((a or "").splitlines(True), b.splitlines(True), "/dev/null" if a is None else p, p)))
    return pa.array(out, pa.string())


def unified_diff(current, expected, path) -> Column:
    """The unified diff of two text columns; a null current is a new file."""
    return F.arrow_udf(diff_texts, "string")(current, expected, path)
