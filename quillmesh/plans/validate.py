"""The gate: diagnostics of all enabled rules, and the exit code."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.text import excluded, newlines
from quillmesh.operators import files, links, rules, stats
from quillmesh.sources.config import Manifest, Root
from quillmesh.sources.tree import as_files, as_paths, exists, read_tree, with_names


class TargetError(ValueError):
    """A target that is under none of the manifest's roots, or isn't there."""


@dataclass
class Validation:
    diagnostics: DataFrame  # with order keys
    files: DataFrame  # parsed rows

    def stream(self) -> Iterator[dict]:
        """Every diagnostic in order, a partition at a time."""
        return (r.asDict() for r in rules.ordered(self.diagnostics).select(*rules.PUBLIC).toLocalIterator())

    def rows(self) -> list[dict]:
        return list(self.stream())

    def exit_code(self) -> int:
        return stats.exit_code(self.diagnostics).first()["exit_code"]


def _under(path, folder: str):
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def _holder(path: str, manifest: Manifest) -> Root | None:
    """The first declared root that holds a path."""
    return next((r for r in manifest.roots if path == r.path or path.startswith(r.path.rstrip("/") + "/")), None)


def check_targets(manifest: Manifest, targets: list[str]) -> None:
    for t in targets:
        if not os.path.exists(t):
            raise TargetError(f"no file or folder {t}")
        if _holder(t, manifest) is None and not any(_holder(r.path, Manifest((Root(t),), {})) for r in manifest.roots):
            raise TargetError(f"{t} is under none of the manifest's roots")


def selected(entries: DataFrame, manifest: Manifest, targets: list[str]) -> DataFrame:
    """A row for each target and file that it names or holds, under the first declared root that holds the file.

    A folder's files go through the exclusions of the first root that holds the
    folder; a file named itself is always taken. Overlapping targets repeat files.
    """
    path = F.concat_ws("/", "root", "rel_path")
    roots = [r.path for r in manifest.roots]
    holds = F.filter(F.array(*map(F.lit, roots)), lambda r: F.startswith(path, F.concat(F.rtrim(r, F.lit("/")), F.lit("/"))))
    taken = []
    for t in targets:
        holder = _holder(t, manifest)
        if os.path.isfile(t):
            taken.append(path == t)
            continue
        fits = _under(path, t) & F.col("rel_path").endswith(".md")
        if holder is not None and holder.exclude:
            fits = fits & ~excluded(F.substr(path, F.lit(len(holder.path.rstrip("/")) + 2)), list(holder.exclude))
        taken.append(fits)
    by = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in enumerate(taken))), lambda n: n.isNotNull())
    once = entries.where(~F.col("is_dir") & (F.col("root") == F.get(holds, F.lit(0))))
    rows = once.select("root_ord", "root", "rel_path", newlines(F.col("content")).alias("content"), "read_error", F.explode(by).alias("_target"))
    return with_names(rows.drop("_target"))


def run_validate(spark: SparkSession, manifest: Manifest, targets: list[str] | None = None, index: DataFrame | None = None) -> Validation:
    """Validates the manifest's roots, or targets under them; index replaces the stem index of the roots."""
    roots = [r.path for r in manifest.roots]
    chosen = [os.path.realpath(t) for t in targets or ()]
    check_targets(manifest, chosen)
    entries = read_tree(spark, roots, also=[t for t in chosen if os.path.isfile(t)])
    parsed = files.parsed(selected(entries, manifest, chosen or roots))
    stems = links.stem_index(as_files(entries, manifest.roots)) if index is None else index
    found = rules.diagnostics(parsed, manifest, stems, as_paths(entries), probe=exists)
    return Validation(found, parsed)
