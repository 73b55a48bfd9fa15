"""Files: root assignment, parsing, metrics and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions.header import header


def assign_root(paths: DataFrame, roots: list[str]) -> DataFrame:
    """Adds root_ord and root: the first of roots that holds the path, else the first of all."""
    holds = lambda r: (F.col("path") == r) | F.col("path").startswith(r.rstrip("/") + "/")
    number = F.lit(None).cast("int")
    for n, r in reversed(list(enumerate(roots))):
        number = F.when(holds(r), n).otherwise(number)
    found = paths.withColumn("root_ord", F.coalesce(number, F.lit(0)))
    return found.withColumn("root", F.get(F.array(*map(F.lit, roots)), F.col("root_ord")))


def parsed(files: DataFrame) -> DataFrame:
    """Adds fm (null: no header), body, masked, fm_ok and type_text."""
    rows = files.withColumn("_block", T.front_block(F.col("content"))).withColumn("fm", header(F.col("_block")))
    body = F.when(F.col("fm").isNotNull(), T.after_front(F.col("content"))).otherwise(F.col("content"))
    rows = rows.withColumn("body", body).drop("_block")
    return rows.withColumn("masked", T.mask_code(F.col("body")))


def fm_text(key: str) -> Column:
    return F.try_element_at(F.col("fm.texts"), F.lit(key))


def has_key(key: str) -> Column:
    return F.coalesce(F.array_contains("fm.keys", key), F.lit(False))


def is_true(key: str) -> Column:
    return F.coalesce(F.array_contains("fm.truthy", key), F.lit(False))


def okf_status() -> Column:
    return F.when(F.col("fm").isNull(), "non_conformant").when(is_true("type"), "conformant").otherwise("partial")


def is_reserved(names: list[str]) -> Column:
    """Named like a reserved file, whatever the case."""
    return F.lower("name").isin([n.lower() for n in names])


def metrics(rows: DataFrame, reserved: list[str]) -> DataFrame:
    """Adds lines, chars, is_reserved and okf_status."""
    return rows.withColumns({"lines": T.count_lines(F.col("content")), "chars": F.length("content"), "is_reserved": is_reserved(reserved), "okf_status": okf_status()})
