"""Continuous re-validation (an extension): each micro-batch of changed files goes through the gate.

The stem index is a static relation, joined to the stream; rules that look at
one file alone run on the stream unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillmesh.operators import files, rules
from quillmesh.sources.config import Manifest


def revalidate(changes: DataFrame, manifest: Manifest, index: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query over changes (a streaming files relation); sink gets each batch's diagnostics."""

    def batch(rows: DataFrame, n: int) -> None:
        sink(rules.diagnostics(files.parsed(rows), manifest, index, None), n)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
