"""Quality classifier: an additive model of text features with pairwise interactions, all of it lookup tables.

Each feature is cut into quantile bins. Shallow trees over one feature's bins are boosted on the logistic loss, feature by
feature in cycles, and their sum is that feature's table. On what the single tables leave, the strongest feature pairs get
tables over a coarser grid in the same way, by trees of one cut in each direction. A score is the logistic function of the
intercept plus one table entry for each feature and pair.

Texts are scored whole; a null text counts as empty and an empty one has all features 0. The model is fitted on at most
MOST_ROWS labelled documents, those of the smallest hashes of doc_id; labels, lang, source and doc_id are no features.
Without any labelled row the model is empty and every score 0.5; with labels of one class the scores approach that class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.llm.shared import in_small_batches

#: Rows that a model is fitted on at most, bins of a feature and of each side of a pair, cycles, learning rate, pairs, smallest leaf, ridge.
MOST_ROWS, BINS, PAIR_BINS, CYCLES, PAIR_CYCLES, RATE, PAIRS, LEAF, RIDGE = 20_000, 64, 12, 250, 100, 0.1, 8, 10.0, 1.0

FEATURES = (
    "log_chars", "log_words", "word_chars", "upper", "digits", "marks", "bars", "exclamations", "other_marks", "stops", "non_ascii",
    "distinct_words", "top_word", "repeated_words", "distinct_pairs", "short_words", "marked_words", "repeated_lines", "longest_word", "worst_line",
)
_UPPER = np.array([chr(b).isupper() for b in range(128)] + [False] * 128)
_MARKS = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_SOFT = np.isin(np.arange(256), list(b".,;:'\"()-?"))
_HARD_BYTES = bytes(np.nonzero(_MARKS & ~_SOFT)[0].tolist())


def features(text: str | None) -> list[float]:
    """Shares and logarithms that describe a text."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, w = len(data), len(words)
    bag, lines = Counter(words), data.split(b"\n")
    pairs = list(zip(words, words[1:], strict=False))
    hard = _MARKS & ~_SOFT
    line_marks = [len(x) - len(x.translate(None, _HARD_BYTES)) for x in lines]
    return [
        np.log1p(len(text)),
        np.log1p(w),
        (n - counts[[9, 10, 11, 12, 13, 32]].sum()) / w,
        counts[_UPPER].sum() / n,
        counts[48:58].sum() / n,
        counts[hard].sum() / n,
        counts[ord("|")] / n,
        counts[ord("!")] / n,
        counts[_MARKS].sum() / n,
        counts[ord(".")] / w,
        counts[128:].sum() / n,
        len(bag) / w,
        max(bag.values()) / w,
        sum(a == b for a, b in pairs) / w,
        len(set(pairs)) / w,
        sum(len(x) < 4 for x in words) / w,
        sum(x[-1] in _HARD_BYTES for x in words) / w,
        1 - len(set(lines)) / len(lines),
        np.log1p(max(map(len, bag))),
        max(m / len(x) if x else 0 for m, x in zip(line_marks, lines, strict=True)),
    ]



@dataclass
class AdditiveModel:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _cut(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def _best_cut(g: np.ndarray, h: np.ndarray) -> int:
    """Bins on the left side of the best cut of a run of bins; 0 if none gains."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl * 4 >= LEAF) & (hr * 4 >= LEAF), gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE), 0)
    return int(gain.argmax()) + 1 if len(gain) and gain.max() > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values, by bin, of a tree over ordered bins."""
    k = _best_cut(g, h) if depth else 0
    if not k:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree with one cut in each direction of a grid."""
    cg, ch = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    parts = lambda c: (c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1], c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1])
    gain = sum(a**2 / (b + RIDGE) for a, b in zip(parts(cg), parts(ch), strict=True)) - g.sum() ** 2 / (h.sum() + RIDGE)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    leaf = np.zeros_like(g)
    for rows in (slice(None, i + 1), slice(i + 1, None)):
        for cols in (slice(None, j + 1), slice(j + 1, None)):
            leaf[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return float(gain.max()), leaf


def fit_model(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    if not len(y):
        return AdditiveModel()
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(rate / (1 - rate))), _cut(x, BINS), pair_edges=_cut(x, PAIR_BINS))
    codes = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for f, code in enumerate(codes):
            g, h = (np.bincount(code, v, len(model.tables[f])) for v in slopes())
            step = RATE * _tree(g, h)
            model.tables[f] += step
            margin += step[code]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]
    grid = lambda v, a, b: np.bincount(coarse[a] * sizes[b] + coarse[b], v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])
    g, h = slopes()
    gains = {(a, b): _quadrants(grid(g, a, b), grid(h, a, b))[0] for a, b in combinations(range(x.shape[1]), 2)}
    model.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_CYCLES):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = RATE * _quadrants(grid(g, a, b), grid(h, a, b))[1]
            model.pair_tables[k] += step
            margin += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training, by crc32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", most_rows: int = MOST_ROWS) -> AdditiveModel:
    """Fit on labelled documents outside the held-out third. A document with several labels counts with the lowest."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    rows = docs.select("doc_id", text).join(F.broadcast(known), "doc_id")  # at most most_rows ids
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64(text)).limit(most_rows)  # ids may repeat in docs
    sample = in_small_batches(rows).select("quality", run(text).alias("x")).toArrow()
    if not sample.num_rows:
        return AdditiveModel()
    return fit_model(np.array(sample["x"].to_pylist(), float), sample["quality"].to_numpy())


def score_quality(docs: DataFrame, model: AdditiveModel, text: str = "text", out: str = "quality_score") -> DataFrame:
    """docs with a score (0 to 1); a column of that name is replaced, all others and all rows stay."""

    @F.arrow_udf(T.DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([features(t.as_py()) for t in texts], float).reshape(-1, len(FEATURES))
            yield pa.array(model.score(x))

    return in_small_batches(docs).withColumn(out, run(F.col(text)))
