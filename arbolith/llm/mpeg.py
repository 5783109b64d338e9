"""MPEG audio columns: resynchronised frames, tags, variable-bitrate tables, checksums, exact durations, seek offsets.

Layout written: an ID3v2.3 tag, a frame with a Xing table, one frame for each unit of payload, an ID3v1 tag. A frame is
MPEG-1 layer III, mono, 48 kHz, with its CRC; the unit lies in the frame's main data. A unit of one repeated byte goes to a
small frame as that byte, so streams are of variable bitrate.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

UNIT = 576
#: Bytes searched for the next frame at a time, and frames between two kept seek offsets.
SEEK_EVERY = 16

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (is MPEG-1, layer) and index, Hz by version and index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


@dataclass(frozen=True, slots=True)
class Header:
    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padded: bool
    mono: bool

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != 1 else 1152

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12_000 * self.bitrate // self.rate + self.padded) * 4
        return self.samples * 125 * self.bitrate // self.rate + self.padded

    @property
    def side(self) -> int:
        """Bytes of side information of layer III."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@functools.lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """A frame header, or None if these four bytes are none. Free-format bitrates are not taken."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(raw[1] >> 3 & 3)
    layer = {1: 3, 2: 2, 3: 1}.get(raw[1] >> 1 & 3)
    if version is None or layer is None or raw[2] >> 4 in (0, 15) or raw[2] >> 2 & 3 == 3 or raw[3] & 3 == 2:
        return None
    return Header(version, layer, not raw[1] & 1, BITRATES[version == 1, layer][raw[2] >> 4], RATES[version][raw[2] >> 2 & 3], bool(raw[2] & 2), raw[3] >> 6 == 3)


@functools.lru_cache(maxsize=65536)
def crc16(covered: bytes) -> int:
    """The frame checksum: polynomial 0x8005 from 0xFFFF over the header's last two bytes and the side information."""
    crc = 0xFFFF
    for byte in covered:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 * (crc >> 15)) & 0xFFFF
    return crc


@dataclass(slots=True)
class Stream:
    """What a stream holds. ``offsets``: where every SEEK_EVERY-th audio frame begins."""

    frames: int = 0
    samples: int = 0
    rate: int = 0
    layer: int = 0
    version: float = 0
    mono: bool = False
    bitrates: set[int] = field(default_factory=set)
    checked: int = 0
    broken: int = 0
    skipped: int = 0
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    places: list[tuple[int, int]] = field(default_factory=list)

    @property
    def seconds(self) -> Fraction:
        return Fraction(self.samples, self.rate) if self.rate else Fraction(0)


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Reads text frames of a tag at the start; where the audio begins."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return 0
    end = 10 + _syncsafe(data[6:10])
    at, major = 10, data[3]
    while major in (3, 4) and at + 10 <= min(end, len(data)) and data[at]:
        size = _syncsafe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : at + 10 + size]
        if name[0] == "T" and body:
            tags[name] = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\0")
        at += 10 + size
    return min(end + 10 * bool(data[5] & 0x10), len(data))


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Reads a Xing, Info or VBRI table in the frame at ``at``."""
    place = at + 4 + 2 * h.protected + h.side
    name = data[place : place + 4]
    if name in (b"Xing", b"Info"):
        flags, p = int.from_bytes(data[place + 4 : place + 8], "big"), place + 8
        if flags & 1:
            out.table_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 2:
            out.table_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            out.toc = data[p : p + 100]
    elif (name := data[at + 36 : at + 40]) == b"VBRI":
        out.table_bytes = int.from_bytes(data[at + 46 : at + 50], "big")
        out.table_frames = int.from_bytes(data[at + 50 : at + 54], "big")
    else:
        return False
    out.table = name.decode()
    return True


def parse(data: bytes) -> Stream:
    """Walks a stream of any origin. Bytes that are no frame are skipped until a header that another frame, a tag or the end follows."""
    out = Stream()
    at = _id3v2(data, out.tags)
    end = len(data)
    if end - at >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        out.tags["title"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    synced = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h.size if h else 0
        if h and not synced:
            follows = header(data[after : after + 4])
            h = h if after == end or (after < end and follows and (follows.version, follows.layer, follows.rate) == (h.version, h.layer, h.rate)) else None
        if not h or after > end:
            synced = False
            step = data.find(b"\xff", at + 1, end)
            step = step if step >= 0 else end
            out.skipped += step - at
            at = step
            continue
        first = not out.frames and not out.table
        synced = True
        if h.protected and h.layer == 3:
            out.checked += 1
            covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]
            out.broken += crc16(covered) != int.from_bytes(data[at + 4 : at + 6], "big")
        if first:
            out.rate, out.layer, out.version, out.mono = h.rate, h.layer, h.version, h.mono
            if _table(data, at, h, out):
                at = after
                continue
        if out.frames % SEEK_EVERY == 0:
            out.offsets.append(at)
        out.places.append((at, h.size))
        out.frames += 1
        out.samples += h.samples
        out.bitrates.add(h.bitrate)
        at = after
    out.skipped += max(0, end - at) if at < end else 0
    return out


def _frame(bitrate_index: int, unused: bytes = b"") -> tuple[bytes, int]:
    """Header, checksum and side information of a frame as written here, and the bytes left for main data."""
    head = bytes([0xFF, 0xFA, bitrate_index << 4 | 0x04, 0xC0])  # MPEG-1 layer III, with CRC; 48 kHz; mono
    side = bytes(17)
    start = head + crc16(head[2:] + side).to_bytes(2, "big") + side
    return start, header(head).size - len(start)


_WIDE, _NARROW = 12, 1  # 224 and 32 kbit/s: frames of 672 and 96 bytes
_MARK_ALL, _MARK_ONE = b"\x01", b"\x02"


def write(payload: bytes, title: str = "payload") -> bytes:
    """A stream of the payload, whose length is a multiple of UNIT; ``read`` gives it back."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    wide, room = _frame(_WIDE)
    narrow, small = _frame(_NARROW)
    frames = np.zeros((len(units), len(wide) + room), np.uint8)
    frames[:, : len(wide)] = np.frombuffer(wide, np.uint8)
    frames[:, len(wide)] = _MARK_ALL[0]
    frames[:, len(wide) + 1 : len(wide) + 1 + UNIT] = units
    one = (units == units[:, :1]).all(axis=1)
    raw = frames.tobytes()
    size = frames.shape[1]
    parts = [raw[k * size : (k + 1) * size] for k in range(len(units))] if one.any() else [raw]
    for k in np.flatnonzero(one).tolist():
        parts[k] = narrow + (_MARK_ONE + bytes([units[k, 0]])).ljust(small, b"\0")
    sizes = np.where(one, len(narrow) + small, size)
    starts = np.cumsum(sizes) - sizes
    total = int(sizes.sum()) + size  # with the table's own frame
    toc = bytes((256 * (starts[[len(units) * i // 100 for i in range(100)]] + size) // total).astype(np.uint8))
    table = b"Xing" + (7).to_bytes(4, "big") + len(units).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    text = b"\x03" + title.encode()
    frame = b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text
    n = len(frame)
    tag = b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frame
    last = b"TAG" + title.encode("latin-1", "replace")[:30].ljust(125, b"\0")
    return b"".join([tag, wide, table.ljust(room, b"\0"), *parts, last])


def read(data: bytes) -> tuple[bytes, Stream]:
    """The payload of a stream of ``write``, and what the stream holds."""
    stream = parse(data)
    out = []
    for at, size in stream.places:
        body = data[at + 23 : at + size]
        out.append(body[1 : 1 + UNIT] if body[:1] == _MARK_ALL else body[1:2] * UNIT)
    return b"".join(out), stream


def padded(raw: bytes) -> bytes:
    """``raw`` and bytes 255 up to a positive multiple of UNIT."""
    return raw + b"\xff" * (-len(raw) % UNIT or (UNIT if not raw else 0))


def describe(s: Stream) -> str:
    """One line for a stream: exact duration in seconds as a fraction, frames, table, checksums, seek offsets."""
    seek = hashlib.sha256(",".join(map(str, s.offsets)).encode()).hexdigest()[:16]
    return (
        f"mpeg{s.version:g} layer{s.layer} {s.rate}Hz {'mono' if s.mono else 'stereo'} frames={s.frames} samples={s.samples} seconds={s.seconds}"
        f" kbps={'/'.join(map(str, sorted(s.bitrates)))} table={s.table}:{s.table_frames}:{s.table_bytes} crc={s.checked - s.broken}/{s.checked} skipped={s.skipped} seek={len(s.offsets)}:{seek}"
    )


def store(df: DataFrame, text: str = "text", out: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and ``out``: binary, a stream of each whole text's UTF-8 bytes.

    A column named ``out`` is replaced. Null counts as empty; the payload is padded by ``padded``. Equal texts give equal
    streams. Nothing is shuffled.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).withColumn(out, F.lit(b"")).schema
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            streams = [write(padded((x or "").encode())) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(streams, pa.binary())], [*kept, out])

    return df.mapInArrow(run, schema)


#: What ``probe`` adds.
PROBED = "frames long, samples long, sample_rate int, seconds_num long, seconds_den long, crc_checked long, crc_broken long, skipped_bytes long, seek_offsets array<long>, tags map<string,string>, feature string, payload_bytes long, payload_sha256 string, tail_crc32 long"


def probe(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but ``media`` by default) and PROBED, of streams of any origin; columns of those names are replaced.

    A null or empty stream, or bytes without any frame, has 0 frames and an empty payload. The payload columns are of use for
    streams of ``store``. The exact duration is seconds_num / seconds_den.
    """
    added = [x.split()[0] for x in PROBED.split(", ")]
    kept = [c for c in (df.columns if keep is None else keep) if c not in added and (keep is not None or c != media)]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, media])])
    arrow = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def row(data: bytes) -> tuple:
        payload, s = read(data)
        seconds = s.seconds
        return (s.frames, s.samples, s.rate, seconds.numerator, seconds.denominator, s.checked, s.broken, s.skipped, s.offsets, list(s.tags.items()), describe(s), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            rows = [row(x or b"") for x in batch.column(media).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(added)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *map(pa.array, map(list, columns), arrow)], [*kept, *added])

    return df.mapInArrow(run, f"{kinds}, {PROBED}")


def op9(docs: DataFrame) -> DataFrame:
    sized = docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    stored = store(sized, keep=["doc_id", "n_bytes"])
    digested = stored.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    return probe(digested).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "seconds_num", "seconds_den", "seek_offsets")
