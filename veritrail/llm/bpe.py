"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Each byte is mapped to a printable character, each token to a piece of such characters whose score is its negative rank,
and nothing is normalised. sentencepiece then merges the best-scored pair, leftmost first, which is the merge order of the
ranks. Texts are cut by the vocabulary's pattern and every pre-token is encoded on its own; a pre-token that is itself a
token needs no merges. Ids are ranks. Decoding maps pieces back to bytes.

A null text counts as empty: no ids, no bytes. The pre-tokens' cache is bounded by entries and by their length.
"""

from __future__ import annotations

import base64
import struct
import sys
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.llm.shared import in_small_batches

#: Entries of a worker's cache, and the longest pre-token (in characters) that it keeps.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 64
TEXTS_AT_ONCE = 64
_UNKNOWN = "⁇"
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("packed ids need little-endian 32-bit integers")
#: Code points that are letters or numbers only in Unicode versions after the one the rank files' library knows; to it they are
#: neither.
_LATER = """
    558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
    10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3
    16FF4-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24
    1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F
    2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
_LATER_CLASS = "[" + "".join("-".join(f"\\U{int(x, 16):08X}" for x in part.split("-")) for part in _LATER.split()) + "]"


def byte_characters() -> str:
    """A printable character for each byte: itself where Latin-1 prints it, else from 256 on."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by rank, which must be 0, 1, ..."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(str.split, Path(path).read_text().splitlines()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3 | 5) + struct.pack("<f", value) if isinstance(value, float) else _varint(number << 3) + _varint(value)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model with piece id = rank and one unknown piece behind them."""
    chars = byte_characters()
    if {t for t in tokens if len(t) == 1} != {bytes([b]) for b in range(256)}:
        raise ValueError("every byte must be a token")
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, score) + _field(3, kind))
    pieces = [piece("".join(chars[b] for b in t), -float(rank), 1) for rank, t in enumerate(tokens)]
    absent = (1 << 64) - 1  # -1
    trainer = _field(3, 2) + _field(40, len(tokens)) + b"".join(_field(k, absent) for k in (41, 42, 43)) + _field(45, _UNKNOWN.encode())
    normalizer = _field(1, b"identity") + b"".join(_field(k, 0) for k in (3, 4, 5))
    return b"".join([*pieces, piece(_UNKNOWN, 0.0, 2), _field(2, trainer), _field(3, normalizer)])


class Codec:
    """Encoder and decoder; pickles as its tokens and pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern}

    @cached_property
    def _processor(self):
        return sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))

    @cached_property
    def _whole(self) -> dict[bytes, bytes]:
        return {t: array("I", [rank]).tobytes() for rank, t in enumerate(self.tokens)}

    @cached_property
    def _characters(self) -> str:
        return byte_characters()

    @cached_property
    def _regexes(self):
        return regex.compile(self.pattern), regex.compile(_LATER_CLASS)

    def _split(self, text: str) -> list[str]:
        pattern, later = self._regexes
        if text.isascii() or not later.search(text):
            return pattern.findall(text)
        return [text[m.start() : m.end()] for m in pattern.finditer(later.sub("\ufffd", text))]

    @cached_property
    def _cache(self) -> dict[str, bytes]:
        return {}

    def _encode_new(self, words: list[str]) -> None:
        chars, whole = self._characters, self._whole
        data = [w.encode() for w in words]
        merged = [k for k, d in enumerate(data) if d not in whole]
        found = self._processor.encode([data[k].decode("latin-1").translate(chars) for k in merged], num_threads=1)
        self._cache.update((w, whole[d]) for w, d in zip(words, data, strict=True) if d in whole)
        self._cache.update((words[k], array("I", ids).tobytes()) for k, ids in zip(merged, found, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cuts = [self._split(t or "") for t in texts]
        cache = self._cache
        new = set(chain.from_iterable(cuts)).difference(cache)
        if new:
            self._encode_new(list(new))
        ids = [b"".join([cache[w] for w in words]) for words in cuts]
        for w in new:
            if len(w) > CACHE_CHARS:
                del cache[w]
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        return ids

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


TOKENS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("packed", T.BinaryType())])


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """docs with the ids of each text's tokens, as integers and packed (little-endian, unsigned, 32 bits).

    A column of that name is replaced, all others and all rows stay.
    """
    codec = Codec(read_ranks(vocabulary), pattern)

    @F.arrow_udf(TOKENS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            packed = [x for at in range(0, len(texts), TEXTS_AT_ONCE) for x in codec.encode(texts.slice(at, TEXTS_AT_ONCE).to_pylist())]
            ends = np.cumsum([0, *(len(x) // 4 for x in packed)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.StructArray.from_arrays([ids, pa.array(packed, pa.binary())], ["ids", "packed"])

    return in_small_batches(docs).withColumn(out, run(F.col(text)))


def decode(docs: DataFrame, vocabulary: str, tokens: str = "tokens", out: str = "decoded") -> DataFrame:
    """docs with the bytes (binary) that the tokens stand for; null tokens give null."""
    codec = Codec(read_ranks(vocabulary), "")

    @F.arrow_udf(T.BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([codec.decode(x.as_py()) if x.is_valid else None for x in lists], pa.binary())

    return in_small_batches(docs).withColumn(out, run(F.col(tokens)["packed"]))
