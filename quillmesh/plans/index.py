"""Listings: what each directory's index should say, and which files differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import files, listing
from quillmesh.sources.config import Manifest
from quillmesh.sources.tree import as_files, read_tree, with_names


def run_index(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """path, expected and diff of every index file that differs, in path order."""
    entries = read_tree(spark, [r.path for r in manifest.roots])
    rows = as_files(entries, manifest.roots)
    name = manifest.reserved.get("index", "index.md")
    expected = listing.listings(files.parsed(rows), manifest.reserved, len(manifest.roots))
    current = with_names(entries.where(~F.col("is_dir"))).where(F.col("name") == name)
    changed = listing.changed(expected, current)
    roots = F.get(F.array(*(F.lit(r.path) for r in manifest.roots)), F.col("root_ord"))
    path = F.concat_ws("/", roots, F.when(F.col("dir") != "", F.col("dir")), F.lit(name))
    return changed.select(path.alias("path"), "expected", listing.unified_diff("content", "expected", path).alias("diff")).orderBy("path")


def write(row: Row) -> str:
    """Writes a row of run_index(); its path."""
    with open(row["path"], "w", encoding="utf-8") as f:
        f.write(row["expected"])
    return row["path"]
