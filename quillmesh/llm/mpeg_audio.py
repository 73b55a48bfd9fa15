"""Media columns: MPEG audio.

`parse` reads a stream as it is found in the wild: it skips ID3v2 tags, finds
the first frame header that another of its kind follows, walks from frame to
frame by their lengths, and searches for the next good header where one is
missing. It reads ID3v1, ID3v2 and APEv2 tags and Xing, Info and VBRI tables,
verifies the CRC-16 of protected layer III frames and gives exact durations
(samples over sample rate) and the byte offset of every frame. The CRCs of
layers I and II are not verified: such frames don't count as checked.

`write` makes such a stream around a payload: MPEG-2 layer III frames of 576
samples whose granule is silent (no bits of Huffman data), so that the rest of
a frame is ancillary data, which players skip: 576 bytes of it, one for each
sample, are payload.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import map_text, pieces, ship, table, texts

# Fixed values of MPEG audio headers: kbit/s by (MPEG-1 or not, layer), Hz by version, samples of a frame.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
VERSIONS = {0: "2.5", 2: "2", 3: "1"}

UNIT = 576


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    bitrate: int
    rate: int
    channels: int
    samples: int
    size: int
    side: int  # bytes of side information (layer III)


@lru_cache(maxsize=65536)
def header(raw: bytes) -> Header | None:
    """What four bytes say, if they can be a frame's header; free-format streams are not read."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] < 0xE0:
        return None
    version, layer = VERSIONS.get(raw[1] >> 3 & 3), 4 - (raw[1] >> 1 & 3)
    kbit, hz = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or layer == 4 or kbit in (0, 15) or hz == 3 or raw[3] & 3 == 2:
        return None
    first = version == "1"
    bitrate, rate = BITRATES[first, layer][kbit] * 1000, RATES[version][hz]
    channels = 1 if raw[3] >> 6 == 3 else 2
    samples = 384 if layer == 1 else 576 if layer == 3 and not first else 1152
    pad = raw[2] >> 1 & 1
    size = (12 * bitrate // rate + pad) * 4 if layer == 1 else samples // 8 * bitrate // rate + pad
    side = 0 if layer != 3 else (17 if channels == 1 else 32) if first else (9 if channels == 1 else 17)
    return Header(version, layer, not raw[1] & 1, bitrate, rate, channels, samples, size, side)


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """The CRC of MPEG audio: polynomial 0x8005, from 0xFFFF, high bit first."""
    crc = 0xFFFF
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


@dataclass
class Media:
    version: str = ""
    layer: int = 0
    sample_rate: int = 0
    channels: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)  # of what follows header, checksum and side information
    bitrate_sum: int = 0
    bitrates: int = 0
    checked: int = 0
    failed: int = 0
    skipped: int = 0
    resyncs: int = 0
    truncated: bool = False
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)

    @property
    def seconds(self) -> float:
        return self.samples / self.sample_rate if self.sample_rate else 0.0

    def frame_at(self, sample: int) -> int | None:
        """The offset of the frame that holds a sample: all frames of a stream hold as many."""
        if not self.offsets or not 0 <= sample < self.samples:
            return None
        return self.offsets[sample * len(self.offsets) // self.samples]


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(b: bytes) -> str:
    kind, rest = (b[0], b[1:]) if b else (0, b"")
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(kind, "latin-1")
    return rest.decode(codec, "replace").rstrip("\0")


def _id3v2(data: bytes, at: int, tags: dict) -> int:
    """Reads a tag at `at`; its end."""
    major, flags = data[at + 3], data[at + 5]
    end = at + 10 + _synchsafe(data[at + 6 : at + 10])
    p = at + 10
    if flags & 0x40 and major >= 3 and p + 4 <= len(data):  # an extended header
        p += _synchsafe(data[p : p + 4]) if major == 4 else 4 + int.from_bytes(data[p : p + 4], "big")
    stop = min(end, len(data))
    while major >= 3 and p + 10 <= stop and data[p]:
        n = _synchsafe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        name, body = data[p : p + 4].decode("latin-1"), data[p + 10 : min(p + 10 + n, stop)]
        if name == "TXXX":
            key, _, value = _text(body).partition("\0")
            tags[f"TXXX:{key}"] = value
        elif name[0] == "T":
            tags[name] = _text(body)
        p += 10 + n
    return end + (10 if flags & 0x10 else 0)


def _tail_tags(data: bytes, tags: dict) -> int:
    """Reads ID3v1 and APEv2 tags; the end of what stands before them."""
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if v := data[end - 128 + a : end - 128 + b].split(b"\0")[0].decode("latin-1").rstrip():
                tags.setdefault(f"ID3v1:{name}", v)
        end -= 128
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, n, flags = struct.unpack("<III", data[end - 20 : end - 8])
        p = max(0, end - size)
        for _ in range(n):
            z = data.find(b"\0", p + 8, end - 32)
            if z < 0:
                break
            m = int.from_bytes(data[p : p + 4], "little")
            tags[f"APE:{data[p + 8 : z].decode('latin-1')}"] = data[z + 1 : z + 1 + m].decode("utf-8", "replace")
            p = z + 1 + m
        end = max(0, end - size - (32 if flags & 0x80000000 else 0))
    return end


def _vbr_table(frame: bytes, h: Header, m: Media) -> bool:
    """Reads a Xing, Info or VBRI table, if the frame holds one."""
    if h.layer != 3:
        return False
    for at in (4 + h.side, 6 + h.side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            m.table = frame[at : at + 4].decode()
            if flags & 1:
                m.table_frames, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
            if flags & 2:
                m.table_bytes, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
            if flags & 4:
                m.toc = list(frame[p : p + 100])
            return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        m.table = "VBRI"
        m.table_bytes, m.table_frames, n, scale, width, per = struct.unpack(">IIHHHH", frame[46:62])
        m.toc = [scale * int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") for i in range(n)]
        return True
    return False


def _same(a: Header, b: Header) -> bool:
    return (a.version, a.layer, a.rate) == (b.version, b.layer, b.rate)


def parse(data: bytes) -> Media:
    """Reads a stream; bytes that hold no frame give a Media without frames."""
    m = Media()
    at = 0
    while data[at : at + 3] == b"ID3" and at + 10 <= len(data):
        at = _id3v2(data, at, m.tags)
    end = _tail_tags(data, m.tags)
    kind: Header | None = None
    lost = -1  # where the search for a header began
    while at + 4 <= end:
        h = header(data[at : at + 4])
        good = h is not None and (kind is None or _same(kind, h))
        if good and (kind is None or lost >= 0):  # the next frame must bear it out
            n = at + h.size
            after = header(data[n : n + 4]) if n + 4 <= end else None
            good = n == end or after is not None and _same(h, after)
        if not good:
            lost = at if lost < 0 else lost
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        if lost >= 0:
            m.skipped, m.resyncs, lost = m.skipped + at - lost, m.resyncs + 1, -1
        if at + h.size > end:
            m.truncated = True
            break
        if kind is None:
            kind = h
            m.version, m.layer, m.sample_rate, m.channels = h.version, h.layer, h.rate, h.channels
            if _vbr_table(data[at : at + h.size], h, m):
                at += h.size
                continue
        lead = 4
        if h.protected:
            lead = 6
            if h.layer == 3:
                m.checked += 1
                m.failed += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big")
        m.offsets.append(at)
        m.sizes.append(h.size)
        m.starts.append(at + lead + h.side)
        m.samples += h.samples
        m.bitrate_sum += h.bitrate
        m.bitrates |= 1 << (data[at + 2] >> 4)
        at += h.size
    if lost >= 0:
        m.skipped += end - lost
    return m


# MPEG-2 layer III, protected, 144 kbit/s, 16 kHz, mono: 648 bytes a frame, of which 633 follow the side information.
_HEAD = bytes([0xFF, 0xF2, 0xD8, 0xC0])
_OPEN = bytes([0xFF, 0xF3, 0xD8, 0xC0])
_SIDE = bytes(9)
_LEAD = _HEAD + crc16(_HEAD[2:] + _SIDE).to_bytes(2, "big") + _SIDE
_SIZE = 648


def pad(payload: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of UNIT."""
    return payload + b"\xff" * (-len(payload) % UNIT if payload else UNIT)


def write(payload: bytes, tag: dict[str, str] | None = None) -> bytes:
    """A stream that holds a payload of a multiple of UNIT bytes."""
    n = len(payload) // UNIT
    frames = np.zeros((n, _SIZE), np.uint8)
    frames[:, : len(_LEAD)] = np.frombuffer(_LEAD, np.uint8)
    frames[:, len(_LEAD) : len(_LEAD) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    info = _OPEN + _SIDE + b"Info" + struct.pack(">III", 7, n, (n + 1) * _SIZE) + bytes(i * 256 // 100 for i in range(100))
    body = b"".join(b"TXXX" + struct.pack(">IH", len(t), 0) + t for t in (b"\x03" + f"{k}\0{v}".encode() for k, v in (tag or {}).items()))
    size = bytes(len(body) >> s & 0x7F for s in (21, 14, 7, 0))
    return b"ID3\x03\0\0" + size + body + info.ljust(_SIZE, b"\0") + frames.tobytes()


def payload(data: bytes, m: Media) -> bytes:
    """What write() stored."""
    return b"".join([data[s : s + UNIT] for s in m.starts])


def to_media(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8) and media of every row.

    Null text is empty, and an empty text is one frame of padding; null doc_ids
    stay null. Very long texts are stored whole. Repeated rows stay; equal texts
    make equal media. An empty df gives no rows. Other columns, whatever their
    names, are left out.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts(b)]
        media = [write(pad(t), {"bytes": str(len(t))}) for t in raw]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_text(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_bytes long, media binary")


_READ = "version string, layer int, sample_rate int, channels int, frames long, samples long, seconds double, checked long, failed long, skipped long, vbr string, table_frames long, offsets array<long>, payload binary"
_INFO = pa.schema(
    [
        ("version", pa.string()),
        ("layer", pa.int32()),
        ("sample_rate", pa.int32()),
        ("channels", pa.int32()),
        ("frames", pa.int64()),
        ("samples", pa.int64()),
        ("seconds", pa.float64()),
        ("checked", pa.int64()),
        ("failed", pa.int64()),
        ("skipped", pa.int64()),
        ("vbr", pa.string()),
        ("table_frames", pa.int64()),
        ("offsets", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """The other columns of df, and what parse() finds in each media value, with its payload.

    Null and empty media have no frames and an empty payload. Columns of df that
    are named like those added are replaced; all others keep names and values.
    Repeated rows stay, an empty df gives no rows.
    """
    kept = [c for c in df.columns if c != media and c not in _INFO.names]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*(F.col(f"`{c}`") for c in kept)).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, media):
            out = []
            for data in b.column(media).to_pylist():
                m = parse(data or b"")
                out.append((m.version, m.layer, m.sample_rate, m.channels, len(m.offsets), m.samples, m.seconds, m.checked, m.failed, m.skipped, m.table, m.table_frames, m.offsets, payload(data or b"", m)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(c, f.type) for c, f in zip(zip(*out), _INFO))], names=[*kept, *_INFO.names])

    ship(df.sparkSession)
    return df.select(*(F.col(f"`{c}`") for c in kept), media).mapInArrow(run, f"{fields}, {_READ}" if kept else _READ)


def op4_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    """All documents stored as MPEG audio and read back."""
    stored = to_media(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    feature = F.format_string(
        "mpeg%s.%d %dHz %dch frames=%d samples=%d seconds=%.4f crc=%d/%d skipped=%d %s=%d seek=%08x",
        "version", "layer", "sample_rate", "channels", "frames", "samples", "seconds", F.col("checked") - F.col("failed"), "checked", "skipped", "vbr", "table_frames",
        F.crc32(F.array_join(F.col("offsets").cast("array<string>"), ",").cast("binary")),
    )
    return read_media(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )


QUERIES = {"op4_mpeg_audio": op4_mpeg_audio}
ORACLES: dict[str, str] = {}
