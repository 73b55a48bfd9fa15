"""Sending this package to the executors, and small inputs to all of them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    if not package.is_dir():  # it runs from a zip file: it was shipped already
        return
    to = Path(tempfile.mkdtemp(prefix="quillmesh-")) / "quillmesh-code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(to))


def spread(df: DataFrame) -> DataFrame:
    """A table read from fewer files than there are cores, dealt to all cores: a small file is one row group, which one task reads.

    A table of many files, as any large one is, stays as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df._jdf.inputFiles())  # the count alone: a large table's names stay in the JVM
    return df.repartition(cores) if files < cores else df
