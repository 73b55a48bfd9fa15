"""Links: the stem index, wikilinks against it, Markdown links against the paths."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as T

#: A column of paths (null: none) -> whether something is there.
Probe = Callable[[Column], Column]


def stem_index(files: DataFrame) -> DataFrame:
    """stem, n and first_path: how many files bear a stem, and the first in root and path order."""
    order = F.struct("root_ord", F.split("rel_path", "/"))
    return files.groupBy("stem").agg(F.count("*").alias("n"), F.min_by("rel_path", order).alias("first_path"))


def wikilinks(rows: DataFrame) -> DataFrame:
    """A row for each wikilink of parsed rows, in text order."""
    return rows.select("root_ord", "rel_path", F.posexplode(T.wikilinks(F.col("masked"))).alias("pos", "link")).select("root_ord", "rel_path", "pos", "link.*")


def resolve_wikilinks(links: DataFrame, index: DataFrame) -> DataFrame:
    """Adds resolved_path, broken and ambiguous. The index has a row for each stem; Spark broadcasts it if it is small."""
    found = links.join(index.withColumnRenamed("stem", "target"), "target", "left")
    n = F.coalesce("n", F.lit(0))
    return found.select("root_ord", "rel_path", "pos", "raw", "target", "alias", "section", F.col("first_path").alias("resolved_path"), (n == 0).alias("broken"), (n > 1).alias("ambiguous"))


def link_path(path: Column) -> Column:
    """The absolute path that a relative or root-relative link of a file (columns root and dir) means."""
    return T.normal_path(F.when(path.startswith("/"), F.concat_ws("/", "root", path)).otherwise(F.concat_ws("/", "root", "dir", path)))


def mdlinks(rows: DataFrame) -> DataFrame:
    """A row for each Markdown link of parsed rows, in text order, with the absolute path it means."""
    found = rows.select("root_ord", "root", "rel_path", "dir", F.posexplode(T.mdlinks(F.col("masked"))).alias("pos", "link"))
    return found.select("root_ord", "rel_path", "pos", "link.text", "link.target", "link.is_external", F.when(~F.col("link.is_external"), link_path(F.col("link.path"))).alias("means"))


def outside(path: Column, roots: Sequence[str]) -> Column:
    """The path if it is under none of the roots, else null."""
    under = F.lit(False)
    for r in roots:
        under = under | (path == r) | path.startswith(r.rstrip("/") + "/")
    return F.when(~under, path)


def resolve_mdlinks(links: DataFrame, paths: DataFrame, roots: Sequence[str] = (), probe: Probe | None = None) -> DataFrame:
    """Adds broken: an internal link whose path is none of paths; one outside all roots is looked up by `probe`, else missing.

    External links have scattered keys, which no path equals, so that theirs is no hot one.
    """
    known = paths.select(T.normal_path(F.col("path")).alias("_key")).distinct().withColumn("_there", F.lit(True))
    found = links.withColumn("_key", F.coalesce("means", F.concat(F.lit("-"), F.xxhash64("rel_path", "pos").cast("string")))).join(known, "_key", "left")
    missing = ~F.col("is_external") & F.col("_there").isNull()
    if probe is not None:
        found = found.withColumn("_else", probe(F.when(missing, outside(F.col("means"), roots))))
        missing = missing & ~F.col("_else")
    return found.select("root_ord", "rel_path", "pos", "text", "target", "is_external", missing.alias("broken"))
