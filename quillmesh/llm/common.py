"""What the operators share: reading tables, cutting lineage and Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.shipping import ship, spread

#: Text taken into one working batch of a Python worker, in bytes (one longer text is a batch of its own).
BATCH_BYTES = 8 << 20

_written: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir; one of fewer files than cores is dealt to all of them."""
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI; a folder of our own only where none is set and all run on one machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillmesh-")
        spark.sparkContext.setCheckpointDir(at)
    at = at.rstrip("/")
    if at.startswith("/"):
        return f"file://{at}"
    return at.replace("file:/", "file:///", 1) if at.startswith("file:/") and not at.startswith("file:///") else at


def scratch(spark: SparkSession, kind: str = "table") -> str:
    """A new name in the shared folder; what is written there goes with drop() or at exit."""
    path = f"{shared_dir(spark)}/quillmesh-{kind}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The same rows, reread from a table in the shared folder: a short lineage that outlives any executor."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() has written, once nothing that is still to run reads them."""
    for t in tables:
        _delete(t._scratch)


def _delete(path: str) -> None:
    if path in _written:
        _written.discard(path)
        with contextlib.suppress(Exception):  # it is gone, or its store can't be reached at exit
            fs, at = pafs.FileSystem.from_uri(path)
            fs.delete_dir(at)


@atexit.register
def drop_all() -> None:
    """Delete all that is left of what cut() and scratch() have named."""
    for path in list(_written):
        _delete(path)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about `size` bytes of a column, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, int(b.num_rows * size / max(1, b.column(text).nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def map_text(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema, size: int = BATCH_BYTES, memo: str = "") -> DataFrame:
    """f over batches of bounded size, without a shuffle. memo names what f remembers in its worker; what others remembered there goes first."""

    def run(batches):
        forget_others(memo)
        for b in pieces(batches, size=size):
            yield f(b)
        release()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


#: What this worker remembers between tasks: names and what forgets it.
_memos: dict[str, Callable[[], None]] = {}


def remember(name: str, forget: Callable[[], None]) -> None:
    _memos[name] = forget


def forget_others(name: str = "") -> None:
    """Workers are used again by other stages: memory for what only an earlier stage remembered is given up."""
    for k in [k for k in _memos if k != name]:
        _memos.pop(k)()
    release()


def release() -> None:
    """Hand memory that a task no longer uses back to the system: workers live on, and others share the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about `rows` rows that never part a key's rows, from batches sorted by key (a long without nulls)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        keys = np.asarray(b.column(key))
        first = int(np.searchsorted(keys, keys[-1], side="left"))
        if first == 0 and np.asarray(held[0].column(key))[0] == keys[-1]:
            continue  # all of one key so far
        done = [*held[:-1], b.slice(0, first)]
        if first == 0:  # the last key's rows began in an earlier batch
            t = pa.Table.from_batches(held)
            at = int(np.searchsorted(t.column(key).to_numpy(), keys[-1], side="left"))
            yield t.slice(0, at)
            held = t.slice(at).to_batches()
        else:
            yield pa.Table.from_batches(done)
            held = [b.slice(first)]
        n = sum(x.num_rows for x in held)
    if held:
        yield pa.Table.from_batches(held)


def texts(batch: pa.RecordBatch) -> list[str]:
    """The batch's texts; null is empty."""
    return [t or "" for t in batch.column("text").to_pylist()]


def crc32_mod(col: str, m: int):
    return F.crc32(F.col(col).cast("string").cast("binary")) % m
