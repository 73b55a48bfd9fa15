"""Token ids in seekable zstandard files.

A file is a row of independent zstandard frames, one for each document (ids as
little-endian unsigned 32-bit integers, with zstandard's own content
checksum), then a skippable frame with the documents' keys and last a seek
table in the public seekable format: for each frame its compressed size, its
size and the low 32 bits of its content's XXH64. A reader takes the last bytes
for the table, finds a document's frame and decompresses that frame alone; any
zstandard decoder reads the whole file.

Documents are dealt by key range, so files hold ascending keys and none is
gathered in one task. Files are written under a name of their own for each
task attempt and moved into place, so lost executors leave no half file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import cut, forget_others, pieces, scratch, table, texts
from quillmesh.llm.word_tokens import BATCH, MEMO_NAME, encoder

# Fixed values of the zstandard and seekable formats.
SKIPPABLE_KEYS = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

LEVEL = 1


class StoreWriter:
    """Writes one file, a document at a time."""

    def __init__(self, sink):
        self.sink = sink
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.entries = bytearray()
        self.keys: list[int | None] = []
        self.n_ids = 0

    def add(self, key: int | None, ids: bytes) -> None:
        frame = self.zstd.compress(ids)
        self.sink.write(frame)
        self.entries += struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.keys.append(key)
        self.n_ids += len(ids) // 4

    def close(self) -> None:
        known = np.array([k is not None for k in self.keys], dtype=np.uint8).tobytes()
        keys = known + np.array([k or 0 for k in self.keys], dtype="<i8").tobytes()
        self.sink.write(struct.pack("<II", SKIPPABLE_KEYS, len(keys)) + keys)
        foot = struct.pack("<IBI", len(self.keys), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(self.entries) + len(foot)) + bytes(self.entries) + foot)
        self.sink.close()


class StoreReader:
    """Reads documents of one file by their place in it; file is a seekable object."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a seekable zstandard file with checksums")
        file.seek(end - 9 - 12 * n - 8)
        head = struct.unpack("<II", file.read(8))
        if head != (SKIPPABLE_SEEK, 12 * n + 9):
            raise ValueError("damaged seek table")
        self.frames = np.frombuffer(file.read(12 * n), dtype="<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        file.seek(int(self.offsets[-1]))
        kind, size = struct.unpack("<II", file.read(8))
        if (kind, size) != (SKIPPABLE_KEYS, 9 * n):
            raise ValueError("damaged key table")
        raw = file.read(size)
        known = np.frombuffer(raw[:n], dtype=np.uint8)
        self.keys = [int(k) if ok else None for k, ok in zip(np.frombuffer(raw[n:], dtype="<i8"), known)]
        self.zstd = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.keys)

    def read(self, i: int) -> bytes:
        """The ids of document i, verified."""
        packed, size, check = map(int, self.frames[i])
        self.file.seek(int(self.offsets[i]))
        ids = self.zstd.decompress(self.file.read(packed), max_output_size=size) if size else b""
        if len(ids) != size or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"document {i}: checksum differs")
        return ids

    def find(self, keys: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """Only the documents asked for."""
        wanted = set(keys)
        for i, k in enumerate(self.keys):
            if k in wanted:
                yield k, self.read(i)


def write_store(df: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id") -> DataFrame:
    """Encodes df.text, appends end_id to each document and writes the files.

    Returns a row for each file: file (its place in key order), path, n_docs,
    n_ids. Null or empty text is the end id alone; null keys come first; rows of
    the same key are all kept, in order of their text's hash (rows that repeat
    both tie, and are equal). A very long text is one frame like any other.
    Other columns of df, whatever their names, are left out. No rows, no files.
    What a lost task attempt leaves is a file of a hidden name, which no reader
    takes for a store.
    """
    dealt = df.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    dealt = dealt.repartitionByRange("key", "h").sortWithinPartitions("key", "h").select("key", "text")
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        forget_others(MEMO_NAME)
        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        encode, writer, at = encoder(tokenizer).encode, None, f"{root}/.{part:06d}-{uuid.uuid4().hex}"
        for b in pieces(batches, size=BATCH):
            if writer is None:
                writer = StoreWriter(fs.open_output_stream(at, compression=None))
            for k, ids in zip(b.column("key").to_pylist(), encode(texts(b))):
                writer.add(k, ids + end)
        if writer is not None:
            writer.close()
            name = f"part-{part:06d}.tok.zst"
            fs.move(at, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [part], "path": [f"{folder}/{name}"], "n_docs": [len(writer.keys)], "n_ids": [writer.n_ids]}, schema=_FILES)

    return dealt.mapInArrow(run, "file int, path string, n_docs long, n_ids long")


_FILES = pa.schema([("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_store(files: DataFrame) -> DataFrame:
    """Every document of the files that write_store() lists: doc_id, start, n_tokens and the ids' CRC-32."""
    order = Window.orderBy("file")  # a row for each file
    based = files.withColumn("base", F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = max(1, files.sparkSession.sparkContext.defaultParallelism)

    def run(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as f:
                    store, out = StoreReader(f), []
                    for i, k in enumerate(store.keys):
                        ids = store.read(i)
                        out.append((k, base, len(ids) // 4, zlib.crc32(ids)))
                        base += len(ids) // 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _DOCS.types)], schema=_DOCS)

    return based.select("path", "base").repartition(2 * n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_store(spark, sf_dir: str) -> DataFrame:
    """All documents written to seekable files and read back."""
    import public_tokenizers

    folder = scratch(spark, "tokens")
    files = cut(write_store(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), 2))
    return read_store(files)


QUERIES = {"op7_token_store": op7_token_store}
ORACLES: dict[str, str] = {}
