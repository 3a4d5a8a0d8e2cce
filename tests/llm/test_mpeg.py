import hashlib
import os
import zlib
from fractions import Fraction

from veritrail.llm import mpeg
from veritrail.llm.queries import op8_mpeg_media


def test_round_trip_of_any_bytes():
    for n in (0, 1, 575, 576, 577, 20_000):
        for data in (os.urandom(n), b"\xff" * n, b"\xff\xf2\xd8\xc0" * (n // 4)):
            payload = mpeg.padded(data)
            media = mpeg.encode(payload)
            s = mpeg.parse(media)
            assert mpeg.payload(media, s) == payload and len(payload) % 576 == 0 < len(payload)
            assert (s.failed, s.skipped, s.table_frames, s.table, s.tags) == (0, 0, len(payload) // 576, "Xing", ["id3v2.4", "id3v1"])
            assert s.duration == Fraction(len(payload), 16000)


def test_parser_finds_frames_again_behind_junk_and_sees_damage():
    media = mpeg.encode(mpeg.padded(b"x" * 5000))
    whole = mpeg.parse(media)
    at = whole.offsets[3]
    junk = mpeg.parse(media[:at] + b"\xff\xfb\x90junk\xff\xff" + media[at:])
    assert len(junk.offsets) == len(whole.offsets) and junk.skipped == 9
    torn = bytearray(media)
    torn[at + 7] ^= 1
    assert mpeg.parse(bytes(torn)).failed == 1
    assert mpeg.parse(b"").offsets == [] and mpeg.parse(None).offsets == []
    assert mpeg.parse(b"no audio here" * 50).offsets == []


def test_headers_of_other_layers():
    one, two = mpeg.header(bytes([255, 0xFB, 0x90, 0x00])), mpeg.header(bytes([255, 0xFF, 0x40, 0x00]))
    assert (one.layer, one.hertz, one.size, one.samples) == (3, 44100, 417, 1152)
    assert (two.layer, two.samples, two.size) == (1, 384, 136)
    assert mpeg.header(bytes([255, 0xFB, 0xF0, 0])) is None and mpeg.header(b"\xff") is None
    assert mpeg.crc16(b"123456789") == 0xAEE7


def test_query(spark, tmp_path):
    rows = [(1, None), (2, ""), (2, "é" * 400), (3, "é" * 400), (None, "x" * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_mpeg_media(spark, str(tmp_path)).collect()
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id and len((t or "").encode()) == r.n_bytes) or ""
        payload = mpeg.padded(text.encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(mpeg.encode(payload)).hexdigest()
    assert len(got) == 5 and len({r.feature for r in got if r.n_bytes == 800}) == 1
    assert mpeg.encode_column(spark.createDataFrame([], "b binary"), "b").count() == 0


def test_features_against_arithmetic_and_clashing_columns(spark):
    texts = ["", "x" * 576, "long " * 2_000_000]  # the last has 10 MB
    docs = spark.createDataFrame([(k, t.encode(), k, "old") for k, t in enumerate(texts)], "doc_id long, data binary, audio int, media string")
    got = {r.doc_id: r for r in mpeg.parse_column(mpeg.encode_column(docs, "data"), out="audio").select("doc_id", "media", "audio.*").collect()}
    for k, t in enumerate(texts):
        frames, r = len(mpeg.padded(t.encode())) // mpeg.UNIT, got[k]
        media = bytes(r.media)
        assert (r.table_frames, len(r.frame_offsets), r.crc_failed, r.bytes_skipped) == (frames, frames, 0, 0)
        assert r.samples * r.duration_den == r.duration_num * r.hertz
        assert all(media[at] == 0xFF and media[at + 1] & 0xE0 == 0xE0 for at in r.frame_offsets)
        assert all(media[at + 15 : at + 15 + 8] == mpeg.padded(t.encode())[n * mpeg.UNIT :][:8] for n, at in list(enumerate(r.frame_offsets))[:50])


def remainder(bits: str) -> int:
    """The CRC by long division, bit by bit."""
    crc = [1] * 16
    for b in bits:
        out = crc[0] ^ int(b)
        crc = [*crc[1:], 0]
        if out:
            crc = [x ^ y for x, y in zip(crc, map(int, f"{0x8005:016b}"), strict=True)]
    return int("".join(map(str, crc)), 2)


def framed(head: list[int], covered: str) -> bytes:
    size = mpeg.header(bytes(head)).size
    crc = remainder("".join(f"{b:08b}" for b in head[2:]) + covered)
    body = covered + "01" * 8
    body += "0" * (-len(body) % 8)
    return (bytes(head) + crc.to_bytes(2, "big") + int(body, 2).to_bytes(len(body) // 8, "big")).ljust(size, b"\0")


def test_checksums_of_layers_one_and_two():
    one = [255, 0b11111110, 0x40, 0b11000000]  # mono: 32 allocations of four bits
    joint = [255, 0b11111110, 0x40, 0b01010000]  # joint stereo, shared from subband 8: 40 allocations
    two = [255, 0b11111100, 0x44, 0b11000000]  # mono, 48 kHz, 64 kbit/s: 11, 12 and 4 subbands of 4, 3 and 2 bits
    low = [255, 0b11110100, 0x84, 0b01000000]  # MPEG-2 joint stereo, shared from subband 4
    frames = [
        framed(one, "0110" * 32),
        framed(joint, "0011" * 40),
        framed(two, "0001" * 3 + "0000" * 8 + "000" * 11 + "101" + "00" * 3 + "01" + "10" * 5),  # five in use, two bits more each
        framed(low, "1000" * 2 + "0000" * 6 + "000" * 6 + "001" + "00" * 19 + "11" * 4),  # both channels of subband 0, both of a shared one
    ]
    for f in frames:
        s = mpeg.parse(f * 3)
        assert (len(s.offsets), s.checked, s.failed, s.skipped) == (3, 3, 0, 0)
        torn = bytearray(f * 3)
        torn[6] ^= 0x10
        assert mpeg.parse(bytes(torn)).failed == 1


def test_texts_of_tags():
    def frame(kind, content, size, flags=b"\0\0"):
        return kind + size + flags + content

    four = frame(b"TIT2", b"\3caf\xc3\xa9\0", bytes([0, 0, 0, 7])) + frame(b"APIC", b"xyz", bytes([0, 0, 0, 3])) + frame(b"TALB", b"\1\xff\xfeA\0b\0", bytes([0, 0, 0, 7])) + bytes(20)
    assert mpeg.tag_texts("id3v2.4", b"ID3\4\0\0" + bytes([0, 0, 0, len(four)]) + four) == [("TIT2", "café"), ("TALB", "Ab")]
    two = b"TT2" + bytes([0, 0, 3]) + b"\0ab" + b"TP1" + bytes([0, 0, 9]) + b"\0cut"
    assert mpeg.tag_texts("id3v2.2", b"ID3\2\0\0" + bytes([0, 0, 0, len(two)]) + two) == [("TT2", "ab")]
    packed = frame(b"TIT2", b"\0abc", bytes([0, 0, 0, 4]), b"\0\x80") + frame(b"TPE1", b"\2\0a\0b", bytes([0, 0, 0, 5]))
    extended = bytes([0, 0, 0, 6]) + bytes(6)
    assert mpeg.tag_texts("id3v2.3", b"ID3\3\0\x40" + bytes([0, 0, 0, len(packed) + 10]) + extended + packed) == [("TPE1", "ab")]
    old = b"TAG" + b"Song".ljust(30, b"\0") + b"Who".ljust(30) + bytes(30) + b"1999" + b"note".ljust(28, b"\0") + b"\0\x07" + b"\x11"
    assert len(old) == 128 and mpeg.tag_texts("id3v1", old) == [("title", "Song"), ("artist", "Who"), ("year", "1999"), ("comment", "note"), ("track", "7")]
    item = lambda k, v, flags=0: len(v).to_bytes(4, "little") + flags.to_bytes(4, "little") + k + b"\0" + v
    items = item(b"Artist", "né".encode()) + item(b"Cover", b"\1\2", 2)
    ape = b"APETAGEX" + (2000).to_bytes(4, "little") + (len(items) + 32).to_bytes(4, "little") + (2).to_bytes(4, "little") + bytes(12) + items + bytes(32)
    assert mpeg.tag_texts("ape", ape) == [("Artist", "né")]
    media = mpeg.encode(mpeg.padded(b"x" * 600))
    got = mpeg.parse(ape + media)
    assert got.tags == ["ape", "id3v2.4", "id3v1"] and got.texts == [("Artist", "né"), ("TSSE", "payload")] and got.skipped == 0


def test_tables_give_seek_points_and_delay():
    side = bytes(32)
    head = bytes([255, 0xFB, 0x90, 0x00])
    xing = head + side + b"Info" + (15).to_bytes(4, "big") + (2).to_bytes(4, "big") + (999).to_bytes(4, "big") + bytes(range(100)) + bytes(4) + b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big")
    plain = head.ljust(417, b"\0")
    s = mpeg.parse(xing.ljust(417, b"\0") + plain * 2)
    assert (s.table, s.table_frames, s.seek, s.delay, s.padding, s.offsets) == ("Info", 2, list(range(100)), 576, 1000, [417, 834])
    numbers = [1, 5, 0]  # version, delay, quality
    vbri = head + side + b"VBRI" + b"".join(x.to_bytes(2, "big") for x in numbers) + (999).to_bytes(4, "big") + (2).to_bytes(4, "big")
    vbri += b"".join(x.to_bytes(2, "big") for x in (3, 10, 2, 1)) + b"".join(x.to_bytes(2, "big") for x in (7, 8, 9))
    s = mpeg.parse(vbri.ljust(417, b"\0") + plain * 2)
    assert (s.table, s.table_frames, s.seek, s.delay, len(s.offsets)) == ("VBRI", 2, [70, 80, 90], 5, 2)
