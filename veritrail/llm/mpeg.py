"""MPEG audio columns: bytes stored in MPEG-2 layer III frames, and a parser of such streams.

A payload is stored as one elementary stream: an ID3v2 tag, a first frame with a Xing table (frames, bytes, seek points), one
frame for each 576 payload bytes, an ID3v1 tag. Every frame is mono, 16 kHz, 144 kbit/s (648 bytes, 576 samples) with CRC;
its side information declares no coded spectrum, so a player hears silence and the main data, which players skip as
ancillary, holds the payload unchanged.

The parser takes any layer I to III stream: it skips tags, hunts for a header that is followed by another at the distance
it implies (or by the end or a tag), checks the CRCs of all three layers, reads Xing, Info and VBRI tables with their seek
points and the encoder's delay and padding, and records every frame's offset. Tags give their texts: the text frames of
ID3v2, the fields of ID3v1, the items of APE. Lost synchronisation is counted in bytes skipped and the hunt goes on
behind it. A null or empty binary has no frames; equal binaries give equal columns, in every row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.llm.shared import in_small_batches

UNIT = 576  #: payload bytes in a frame, as many as it has samples

#: Fixed values of the standard: kbit/s by (MPEG-1?, layer) and index; Hz by version and index.
_RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int  #: 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    crc: bool
    hertz: int
    size: int
    samples: int
    side: int  #: bytes of side information (layer III)
    rate: int  #: bit/s
    channels: int
    bound: int  #: the first subband whose bits both channels share (layers I and II)


@lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """A frame header from its four bytes; None if they aren't one (free-format frames aren't taken)."""
    if len(word) < 4 or word[0] != 255 or word[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hertz = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3), word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3 or word[3] & 3 == 2:
        return None
    bits, speed, pad = _RATES[version == 3, layer][rate - 1] * 1000, _HERTZ[version][hertz], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12 * bits // speed + pad) * 4 if layer == 1 else samples // 8 * bits // speed + pad
    mode, mono = word[3] >> 6, word[3] >> 6 == 3
    side = 0 if layer < 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    bound = 4 * (word[3] >> 4 & 3) + 4 if mode == 1 else 32
    return Header(version, layer, not word[1] & 1, speed, size, samples, side, bits, 1 if mono else 2, bound)


@lru_cache(maxsize=65536)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The standard's CRC of the first bits (default: all): polynomial 0x8005, start 0xFFFF."""
    crc, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data:
        crc ^= byte << 8 if left >= 8 else (byte >> 8 - left << 8 - left) << 8
        for _ in range(min(left, 8)):
            crc = crc << 1 ^ (0x8005 if crc & 0x8000 else 0)
        crc &= 0xFFFF
        left -= min(left, 8)
    return crc


#: Fixed values of the standard: allocation bits of layer II by subband, as (subbands, bits of each).
_ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}


def _allocation(head: Header) -> list[int]:
    each = head.rate // head.channels
    if head.version != 3:
        name = "low"
    elif each <= 48000:
        name = "d" if head.hertz == 32000 else "c"
    else:
        name = "a" if head.hertz == 48000 or each <= 80000 else "b"
    return [bits for n, bits in _ALLOCATIONS[name] for _ in range(n)]


def protected_bits(head: Header, body: bytes) -> int:
    """How many bits behind the CRC word it covers; body starts there."""
    if head.layer == 3:
        return 8 * head.side
    if head.layer == 1:
        return 4 * (head.channels * head.bound + 32 - head.bound)
    value, at, chosen = int.from_bytes(body[:48], "big"), 0, 0
    for band, bits in enumerate(_allocation(head)):
        shared = band >= head.bound
        for _ in range(1 if shared else head.channels):
            at += bits
            used = value >> 8 * len(body[:48]) - at & (1 << bits) - 1
            chosen += bool(used) * (head.channels if shared else 1)
    return at + 2 * chosen


def crc_holds(head: Header, frame: bytes) -> bool:
    bits = protected_bits(head, frame[6:])
    return crc16(frame[2:4] + frame[6 : 6 + (bits + 7) // 8], 16 + bits) == int.from_bytes(frame[4:6], "big")


def _frame(main: bytes) -> bytes:
    head = bytes([255, 0b11110010, 13 << 4 | 2 << 2, 0b11000000])
    side = bytes(9)
    return (head + crc16(head[2:] + side).to_bytes(2, "big") + side + main).ljust(648, b"\0")


def encode(payload: bytes) -> bytes:
    """The stream that holds a payload, which must fill whole units."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    n = len(payload) // UNIT
    table = b"Xing" + struct.pack(">III", 7, n, (n + 1) * 648) + bytes(min(255, 256 * (1 + n * k // 100) // (n + 1)) for k in range(100))
    title = b"\0payload"
    tag = b"TSSE" + struct.pack(">IH", len(title), 0) + title
    id3 = b"ID3\4\0\0" + bytes([0, 0, 0, len(tag)]) + tag
    frames = [_frame(payload[k : k + UNIT]) for k in range(0, len(payload), UNIT)]
    return b"".join([id3, _frame(table), *frames, b"TAG".ljust(128, b"\0")])


@dataclass
class Stream:
    """What a parser finds. offsets: of every audio frame; the frame with the table isn't one."""

    offsets: list[int] = field(default_factory=list)
    hertz: int = 0
    samples: int = 0
    duration: Fraction = Fraction(0)
    tags: list[str] = field(default_factory=list)
    texts: list[tuple[str, str]] = field(default_factory=list)
    delay: int = -1
    padding: int = -1
    table: str = ""
    table_frames: int = -1
    seek: list[int] = field(default_factory=list)
    checked: int = 0
    failed: int = 0
    skipped: int = 0


def _tag_size(data: bytes, at: int) -> tuple[str, int]:
    if data[at : at + 3] == b"ID3" and len(data) >= at + 10 and max(data[at + 6 : at + 10]) < 128:
        a, b, c, d = data[at + 6 : at + 10]
        return f"id3v2.{data[at + 3]}", 10 + (a << 21 | b << 14 | c << 7 | d) + (10 if data[at + 5] & 16 else 0)
    if data[at : at + 3] == b"TAG" and len(data) - at == 128:
        return "id3v1", 128
    if data[at : at + 8] == b"APETAGEX" and len(data) >= at + 32:
        return "ape", 32 + struct.unpack("<I", data[at + 12 : at + 16])[0]
    return "", 0


_ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _synchsafe(x: bytes) -> int:
    return int.from_bytes(x, "big") if max(x, default=0) > 127 else sum((b & 127) << 7 * k for k, b in enumerate(reversed(x)))


def _id3v2_texts(tag: bytes) -> list[tuple[str, str]]:
    """(frame id, text) of a tag's text frames; frames that are compressed, encrypted or cut short are passed over."""
    major, flags, body = tag[3], tag[5], tag[10:]
    if flags & 128 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 64 and major > 2:
        at = _synchsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    name, head = (3, 6) if major == 2 else (4, 10)
    out = []
    while at + head <= len(body) and body[at] != 0:
        kind, size = body[at : at + name].decode("latin-1"), body[at + name : at + 2 * name]
        length = _synchsafe(size) if major == 4 else int.from_bytes(size, "big")
        content = body[at + head : at + head + length]
        coded = major > 2 and body[at + 9] & (0x0D if major == 4 else 0xC0)
        if major == 4 and not coded and body[at + 9] & 2:
            content = content.replace(b"\xff\0", b"\xff")
        if kind[0] == "T" and len(content) == length > 1 and not coded and content[0] in _ENCODINGS:
            out.append((kind, content[1:].decode(_ENCODINGS[content[0]], "replace").rstrip("\0")))
        at += head + length
    return out


def _id3v1_texts(tag: bytes) -> list[tuple[str, str]]:
    fields = (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127))
    texts = [(k, tag[a:b].split(b"\0")[0].decode("latin-1").rstrip()) for k, a, b in fields]
    track = [("track", str(tag[126]))] if tag[125] == 0 and tag[126] else []
    return [(k, v) for k, v in texts if v] + track


def _ape_texts(tag: bytes) -> list[tuple[str, str]]:
    out, at = [], 32
    for _ in range(struct.unpack("<I", tag[16:20])[0]):
        end = tag.find(b"\0", at + 8)
        if end < 0:
            break
        size, flags = struct.unpack("<II", tag[at : at + 8])
        value = tag[end + 1 : end + 1 + size]
        if not flags & 6 and len(value) == size:  # text, not binary or a link
            out.append((tag[at + 8 : end].decode("latin-1"), value.decode("utf-8", "replace")))
        at = end + 1 + size
    return out


def tag_texts(kind: str, tag: bytes) -> list[tuple[str, str]]:
    """(name, text) of what a tag says, in its order."""
    return _id3v1_texts(tag) if kind == "id3v1" else _ape_texts(tag) if kind == "ape" else _id3v2_texts(tag)


def _follows(data: bytes, at: int) -> bool:
    return at == len(data) or bool(_tag_size(data, at)[1]) or header(data[at : at + 4]) is not None


def parse(data: bytes | None) -> Stream:
    data, out, at, first, locked = data or b"", Stream(), 0, True, False
    while at < len(data):
        tag, size = _tag_size(data, at)
        if tag:
            out.tags.append(tag)
            out.texts += tag_texts(tag, data[at : at + size])
            at += size
            continue
        head = header(data[at : at + 4])
        if not head or at + head.size > len(data) or not (locked or _follows(data, at + head.size)):
            to = data.find(b"\xff", at + 1)
            step = [x for x in (to, data.find(b"TAG", at + 1), data.find(b"ID3", at + 1)) if x >= 0]
            out.skipped += min(step, default=len(data)) - at
            at, locked = min(step, default=len(data)), False
            continue
        start = at + 4 + 2 * head.crc
        if head.crc:
            out.checked += 1
            out.failed += not crc_holds(head, data[at : at + head.size])
        if not (first and _read_table(data[at : at + head.size], start - at + head.side, out)):
            out.offsets.append(at)
            out.samples += head.samples
            out.duration += Fraction(head.samples, head.hertz)
            out.hertz = head.hertz
        first, locked = False, True
        at += head.size
    return out


def _read_table(frame: bytes, at: int, out: Stream) -> bool:
    """Take a variable-bitrate table if the frame has one."""
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        out.table = frame[at - 8 : at - 4].decode()
        if flags & 1:
            out.table_frames, at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        at += 4 * (flags >> 1 & 1)
        out.seek = list(frame[at : at + 100]) if flags & 4 else []
        at += 100 * (flags >> 2 & 1) + 4 * (flags >> 3 & 1)
        if frame[at : at + 4] in (b"LAME", b"Lavc", b"Lavf"):
            both = int.from_bytes(frame[at + 21 : at + 24], "big")
            out.delay, out.padding = both >> 12, both & 0xFFF
    elif frame[36:40] == b"VBRI":
        out.table, out.table_frames, out.delay = "VBRI", int.from_bytes(frame[50:54], "big"), int.from_bytes(frame[42:44], "big")
        entries, scale, width = (int.from_bytes(frame[k : k + 2], "big") for k in (54, 56, 58))
        out.seek = [scale * int.from_bytes(frame[62 + width * k : 62 + width * (k + 1)], "big") for k in range(entries)]
    return bool(out.table)


def payload(data: bytes, stream: Stream) -> bytes:
    """What encode() stored: the main data of every audio frame."""
    return b"".join([data[k + 15 : k + 15 + UNIT] for k in stream.offsets])


def encode_column(docs: DataFrame, source: str, out: str = "media") -> DataFrame:
    """docs with a binary column as a stream (binary), after bytes 255 up to a positive multiple of the unit; null counts as empty."""

    @F.arrow_udf(T.BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([encode(padded(v.as_py())) for v in values], pa.binary())

    return in_small_batches(docs).withColumn(out, run(F.col(source)))


def padded(data: bytes | None) -> bytes:
    data = data or b""
    return data + b"\xff" * (-len(data) % UNIT or UNIT * (not data))


PARSED = T.StructType(
    [
        T.StructField("payload", T.BinaryType()),
        T.StructField("frame_offsets", T.ArrayType(T.LongType())),
        *(T.StructField(k, T.LongType()) for k in ("hertz", "samples", "duration_num", "duration_den", "table_frames", "delay", "padding", "crc_checked", "crc_failed", "bytes_skipped")),
        T.StructField("tags", T.StringType()),
        T.StructField("tag_texts", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))),
        T.StructField("vbr_table", T.StringType()),
        T.StructField("seek_points", T.ArrayType(T.LongType())),
    ]
)
_PARSED_ARROW = pa.struct(
    [("payload", pa.binary()), ("frame_offsets", pa.list_(pa.int64()))]
    + [(k, pa.int64()) for k in ("hertz", "samples", "duration_num", "duration_den", "table_frames", "delay", "padding", "crc_checked", "crc_failed", "bytes_skipped")]
    + [("tags", pa.string()), ("tag_texts", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("vbr_table", pa.string()), ("seek_points", pa.list_(pa.int64()))]
)


def parse_column(docs: DataFrame, media: str = "media", out: str = "audio") -> DataFrame:
    """docs with a struct of what the parser finds; the duration in seconds is duration_num / duration_den exactly."""

    @F.arrow_udf(PARSED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            rows = []
            for v in values:
                data = v.as_py() or b""
                s = parse(data)
                rows.append(dict(payload=payload(data, s), frame_offsets=s.offsets, hertz=s.hertz, samples=s.samples, duration_num=s.duration.numerator, duration_den=s.duration.denominator, table_frames=s.table_frames, delay=s.delay, padding=s.padding, crc_checked=s.checked, crc_failed=s.failed, bytes_skipped=s.skipped, tags=",".join(s.tags), tag_texts=[dict(name=k, value=v) for k, v in s.texts], vbr_table=s.table, seek_points=s.seek))
            yield pa.array(rows, _PARSED_ARROW)

    return in_small_batches(docs).withColumn(out, run(F.col(media)))
