"""File trees as a Python data source, and as the relations `files` and `paths`.

Spark's own file sources leave out hidden and empty files, which the rules
count; this source lists a tree on the driver (paths only) and reads file
contents on the executors, excluded files not at all.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillmesh.functions.text import excluded, newlines
from quillmesh.shipping import ship
from quillmesh.sources.config import Root

ENTRIES = "root_ord int, root string, rel_path string, is_dir boolean, content string, read_error string"
_SCHEMA = pa.schema([("root_ord", pa.int32()), ("root", pa.string()), ("rel_path", pa.string()), ("is_dir", pa.bool_()), ("content", pa.string()), ("read_error", pa.string())])
#: Paths in one partition.
SLICE = 500
#: Bytes of contents after which a batch goes to Spark.
BATCH_BYTES = 8 << 20


class Slice(InputPartition):
    def __init__(self, entries: list[tuple[int, str, str, bool]]):
        self.entries = entries


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.roots = options.get("roots", options.get("path", "")).split("\n")
        self.contents = options.get("contents", "true") == "true"
        self.also = set(filter(None, options.get("also", "").split("\n")))

    def partitions(self) -> list[Slice]:
        found = []
        for n, root in enumerate(self.roots):
            for at, dirs, names in os.walk(root):
                rel = os.path.relpath(at, root)
                for name, is_dir in [*((d, True) for d in dirs), *((f, False) for f in names)]:
                    found.append((n, root, name if rel == "." else f"{rel}/{name}", is_dir))
        found.sort(key=lambda e: (e[0], e[2].split("/")))
        return [Slice(found[i : i + SLICE]) for i in range(0, len(found), SLICE)] or [Slice([])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for n, root, rel, is_dir in partition.entries:
            content = error = None
            if self.contents and not is_dir and (rel.endswith(".md") or os.path.join(root, rel) in self.also):
                try:
                    with open(os.path.join(root, rel), "rb") as f:
                        raw = f.read()
                    size += len(raw)
                    content = raw.decode("utf-8")
                except (OSError, UnicodeDecodeError) as e:
                    error = f"{type(e).__name__}: {e}"
            rows.append((n, root, rel, is_dir, content, error))
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_SCHEMA), _SCHEMA)], schema=_SCHEMA)


class TreeSource(DataSource):
    """format("kb"): option roots (one a line) or path; contents=false lists only; `also` names files to read that aren't Markdown."""

    @classmethod
    def name(cls) -> str:
        return "kb"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, roots: list[str], contents: bool = True, also: Iterable[str] = ()) -> DataFrame:
    """Every entry under the roots, hidden and empty ones included."""
    ship(spark)
    spark.dataSource.register(TreeSource)
    return spark.read.format("kb").option("roots", "\n".join(roots)).option("contents", str(contents).lower()).option("also", "\n".join(also)).load()


def as_files(entries: DataFrame, roots: tuple[Root, ...]) -> DataFrame:
    """The Markdown files among entries, without those their root excludes."""
    keep = F.lit(True)
    for n, r in enumerate(roots):
        if r.exclude:
            keep = keep & ~((F.col("root_ord") == n) & excluded(F.col("rel_path"), list(r.exclude)))
    md = entries.where(~F.col("is_dir") & F.col("rel_path").endswith(".md") & keep)
    return with_names(md.select("root_ord", "root", "rel_path", newlines(F.col("content")).alias("content"), "read_error"))


def with_names(files: DataFrame) -> DataFrame:
    """Adds dir, name, stem and depth to rows with rel_path."""
    name = F.substring_index("rel_path", "/", -1)
    return files.withColumns(
        {
            "name": name,
            "dir": F.when(F.instr("rel_path", "/") > 0, F.regexp_replace("rel_path", "/[^/]*\\z", "")).otherwise(""),
            "stem": F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*\z", ""),
            "depth": F.size(F.split("rel_path", "/")) - 1,
        }
    )


def as_paths(entries: DataFrame) -> DataFrame:
    """The absolute path of every entry and root."""
    return entries.select(F.concat_ws("/", "root", "rel_path").alias("path")).union(entries.select("root").distinct())


def _exists(paths: pa.Array) -> pa.Array:
    return pa.array([p is not None and os.path.exists(p) for p in paths.to_pylist()], pa.bool_())


def exists(path: Column) -> Column:
    """Whether something is at a path; false for null. For paths outside the trees that were read."""
    return F.arrow_udf(_exists, "boolean")(path)
