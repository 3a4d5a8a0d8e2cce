"""Token counts by a finite-state transducer compiled from a word-end BPE tokenizer.

The transducer reads characters. Its states say what is pending: nothing, a letter run, a mark run or the start of a contraction,
and for a run the BPE state of what was read of it. That is the longest suffix which a token may continue, and for each
prefix of the word that ends within this suffix the last token of its encoding and its number of tokens less that of
the whole. This determines the encoding after any further byte: exactly one token ends there whose left neighbour, the
last token of the prefix before it, would stay apart from it. Transitions carry the tokens that a character adds to the count (a
merge takes some back) and states the correction that a word's end makes. States and transitions are compiled on first use and
are dropped together beyond MOST_MOVES, so memory is bounded.

Special strings are cut out first and count one each, as the library does by default. What lies between is composed (NFC); white
space ends every run, so a chunk of text acts on any state by its head up to the first white space, and on none by the
rest. These maps compose associatively; long texts are cut into chunks whose maps are scanned pairwise.

A null text counts as empty and has no tokens.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from veritrail.llm.bpe import byte_characters
from veritrail.llm.shared import in_small_batches

#: Transitions of a worker's transducer (about 600 bytes each, with their states), and characters of a chunk.
MOST_MOVES, CHUNK = 1_000_000, 1 << 16
_SUFFIX = "</w>"
#: Marks the last byte of a word; no byte's character.
_END = "\0"
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Words:
    """BPE of one word, as counts that grow byte by byte."""

    def __init__(self, model: dict):
        if model["end_of_word_suffix"] != _SUFFIX or model["dropout"] or model["unk_token"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError("a byte-level BPE model with word ends is needed")
        plain = lambda t: t.removesuffix(_SUFFIX) + _END if t.endswith(_SUFFIX) else t
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(plain(a), plain(b)): k for k, (a, b) in enumerate(pairs)}
        chars = byte_characters()
        self.chars = chars
        tokens = {*chars, *(c + _END for c in chars), *(a + b for a, b in self.ranks)}
        self.tokens = {t for t in tokens if self.merged(self.symbols(t)) == [t]}
        self.heads = {"", *(t.rstrip(_END)[:k] for t in self.tokens for k in range(1, len(t.rstrip(_END)) + 1))}
        self.kept: dict = {}
        self.apart = lru_cache(1 << 17)(lambda a, b: self.merged(self.symbols(a) + self.symbols(b)) == [a, b])

    @staticmethod
    def symbols(token: str) -> list[str]:
        return [*token[:-2], token[-2:]] if token.endswith(_END) else list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """Merge the pair of the lowest rank, leftmost first, until none is left."""
        while len(parts) > 1:
            rank, k = min((self.ranks.get(p, len(self.ranks)), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.ranks):
                break
            parts = [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2 :]]
        return parts

    #: A state: the pending suffix, and for its prefixes from the longest to the empty one (last token, tokens less those of the word).
    START = ("", ((None, 0),))

    def _last(self, state, text: str) -> tuple[str, int]:
        """The last token once text (the suffix and one more symbol) ends the word read, and the tokens before it."""
        suffix, ends = state
        for k in range(len(suffix) + 1):
            token = text[len(suffix) - k :]
            before, count = ends[k]
            if token in self.tokens and (before is None or self.apart(before, token)):
                return token, count
        raise AssertionError("every byte is a token")

    def read(self, state, byte: str) -> tuple[tuple, int, int]:
        """The state after one more byte, the tokens it adds, and those the word's end adds then."""
        suffix, ends = state
        token, before = self._last(state, suffix + byte)
        closing = self._last(state, suffix + byte + _END)[1]
        added, text = before + 1, suffix + byte
        keep = next(k for k in range(len(text), -1, -1) if text[len(text) - k :] in self.heads)
        keep = min(keep, len(ends))
        one = self.kept.setdefault  # equal parts of states are stored once
        ends = tuple(one(x, x) for x in ((token, 0), *((t, n - added) for t, n in ends[:keep])))
        return (one(text[len(text) - keep :], text[len(text) - keep :]), one(ends, ends)), added, closing - before

    def count(self, word: str) -> int:
        """Tokens of a whole word."""
        state, total, closing = self.START, 0, 0
        for b in word.encode():
            state, added, closing = self.read(state, self.chars[b])
            total += added
        return total + closing


class Moves(dict):
    """A state: its transitions by character, each with the tokens it adds; compiled when first taken."""

    __slots__ = ("owner", "kind", "word", "closing")

    def __missing__(self, char: str):
        return self.owner.compile(self, char)


class Transducer:
    def __init__(self, definition: str):
        parts = json.loads(definition)
        split = parts["pre_tokenizer"]["pretokenizers"][0]
        if split["pattern"]["Regex"] != _PATTERN or [n["type"] for n in parts["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("the tokenizer cuts words in another way")
        self.words = Words(parts["model"])
        library = Tokenizer.from_str(definition)
        self._lowered = lru_cache(1 << 14)(library.normalizer.normalize_str)
        self._cut = library.pre_tokenizer.pre_tokenize_str
        self._class = lru_cache(1 << 14)(self._class_of)
        self.special = regex.compile("|".join(map(regex.escape, sorted((t["content"] for t in parts["added_tokens"]), key=len, reverse=True))) or r"(?!)")
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, Moves] = {}
        self.words.kept.clear()
        self.moves = 0
        self.start = self.state("", Words.START, 0)

    def state(self, kind: str, word: tuple, closing: int) -> Moves:
        """kind: "" nothing pending, "L" letters, "P" marks, else the contraction begun. closing: tokens that an end adds."""
        key = (kind, word, closing)
        if key not in self.states:
            made = self.states[key] = Moves()
            made.owner, made.kind, made.word, made.closing = self, kind, word, closing
        return self.states[key]

    def _class_of(self, char: str) -> str:
        """L, N, P or S, as the library's own pattern sees a character."""
        n = len(self._cut(f"x{char}x"))
        return "L" if n == 1 else "S" if n == 2 else "P" if len(self._cut(f"!{char}!")) == 1 else "N"

    def compile(self, at: Moves, char: str) -> tuple[int, Moves]:
        total, state = 0, at
        for c in self._lowered(char):
            added, state = self._step(state, c)
            total += added
        self.moves += 1
        at[char] = total, state
        return at[char]

    def _push(self, kind: str, word: tuple, char: str) -> tuple[int, Moves]:
        total = closing = 0
        for b in char.encode():
            word, added, closing = self.words.read(word, self.words.chars[b])
            total += added
        return total, self.state(kind, word, closing)

    def _step(self, at: Moves, c: str) -> tuple[int, Moves]:
        kind = self._class(c)
        if at.kind == kind and kind in "LP":
            return self._push(kind, at.word, c)
        if at.kind.startswith("'"):
            begun = at.kind + c
            if begun in _CONTRACTIONS:
                return self.words.count(begun) - self._held(at), self.start
            if any(x.startswith(begun) for x in _CONTRACTIONS):
                return self._begin(at, begun)
            if at.kind == "'" and kind == "P":
                return self._push("P", at.word, c)
            if len(at.kind) > 1 and kind == "L":  # the apostrophe was a mark, its letter starts a run
                return self._push("L", at.word, c)
        added, state = self._fresh(c, kind)
        return at.closing + added, state

    def _held(self, at: Moves) -> int:
        """Tokens counted so far for a contraction begun, without its closing."""
        return self._begun(at.kind)[0]

    def _begun(self, text: str) -> tuple[int, tuple, int]:
        """Counted so far, BPE state and closing if text, an apostrophe and perhaps a letter, turns out no contraction."""
        mark, after = self._push("P", Words.START, "'")
        if len(text) == 1:
            return mark, after.word, after.closing
        letter, run = self._push("L", Words.START, text[1])
        return mark + after.closing + letter, run.word, run.closing

    def _begin(self, at: Moves, begun: str) -> tuple[int, Moves]:
        count, word, closing = self._begun(begun)
        return count - (self._held(at) if at.kind.startswith("'") else 0), self.state(begun, word, closing)

    def _fresh(self, c: str, kind: str) -> tuple[int, Moves]:
        if kind == "S":
            return 0, self.start
        if kind == "N":
            return self.words.count(c), self.start
        if c == "'":
            count, word, closing = self._begun(c)
            return count, self.state(c, word, closing)
        return self._push(kind, Words.START, c)

    def run(self, state: Moves, text: str) -> tuple[int, Moves]:
        """Tokens that text adds after a state, and the state it leads to."""
        total = 0
        for c in text:
            added, state = state[c]
            total += added
        return total, state

    def chunk_map(self, text: str) -> ChunkMap:
        space = regex.search(r"\s", text)
        if not space:
            return ChunkMap(text, None)
        return ChunkMap(text[: space.start()], self.run(self.start, text[space.end() :]))

    def compose(self, left: ChunkMap, right: ChunkMap) -> ChunkMap:
        if left.rest is None:
            return ChunkMap(left.head + right.head, right.rest)
        count, state = self.run(left.rest[1], right.head)
        count += left.rest[0]
        if right.rest is None:
            return ChunkMap(left.head, (count, state))
        return ChunkMap(left.head, (count + state.closing + right.rest[0], right.rest[1]))

    def scanned(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Map k becomes the composition of maps 0 to k, in a logarithmic number of sweeps of independent compositions."""
        step = 1
        while step < len(maps):
            maps = [*maps[:step], *(self.compose(maps[k - step], maps[k]) for k in range(step, len(maps)))]
            step *= 2
        return maps

    def count(self, text: str | None, chunk: int = CHUNK) -> int:
        if self.moves > MOST_MOVES:
            self.clear()
        total = 0
        pieces = self.special.split(text or "")
        for piece in pieces:
            piece = piece if piece.isascii() else unicodedata.normalize("NFC", piece)
            if len(piece) <= chunk:
                added, state = self.run(self.start, piece)
            else:
                whole = self.scanned([self.chunk_map(piece[k : k + chunk]) for k in range(0, len(piece), chunk)])[-1]
                added, state = self.run(self.start, whole.head)
                if whole.rest:
                    added, state = added + state.closing + whole.rest[0], whole.rest[1]
            total += added + state.closing
        return total + len(pieces) - 1


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to a state: its head runs on from it; the rest (tokens, state) is behind white space and depends on nothing."""

    head: str
    rest: tuple[int, Moves] | None


@lru_cache(maxsize=1)
def transducer_of(definition: str) -> Transducer:
    """A worker's transducer; it stays for the worker's next tasks."""
    return Transducer(definition)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the number of each text's tokens; a column of that name is replaced, all others and all rows stay."""
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())

    @F.arrow_udf(T.LongType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        transducer = transducer_of(definition.value)
        for texts in batches:
            yield pa.array([transducer.count(t.as_py()) for t in texts], pa.int64())

    return in_small_batches(docs).withColumn(out, run(F.col(text)))
