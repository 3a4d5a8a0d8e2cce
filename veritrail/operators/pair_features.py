"""Features of two predictors' vectors: how they disagree at several scales, and what the pair says before the truth is known."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DISAGREEMENT = ("rmse", "direction_agreement", "rank_spearman", "topk_jaccard", "sparsity_jaccard", "cosine_distance", "variance_ratio", "tail_divergence")
PAIR = ("predicted_magnitude", "pair_lower_bound", "first_magnitude", "second_magnitude", "model_cosine", "ensemble_mean_abs", "ensemble_max_abs", "disagreement_mean_abs", "sign_agreement", "ensemble_abs_p90", "ensemble_abs_p99", "disagreement_abs_p90", "disagreement_abs_p99", "ensemble_std", "disagreement_std")


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 within each row, equal values averaged."""
    order = np.argsort(x, axis=1, kind="stable")
    ordered = np.take_along_axis(x, order, axis=1)
    place = np.arange(x.shape[1])
    new = np.ones(x.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    first = np.maximum.accumulate(np.where(new, place, 0), axis=1)
    last = np.ones(x.shape, bool)
    last[:, :-1] = new[:, 1:]
    after = np.minimum.accumulate(np.where(last, place, x.shape[1])[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + after) / 2 + 1, axis=1)
    return out


def _rms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).mean(axis=1))


def _correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    return np.where(size > 0, (x * y).sum(axis=1) / np.where(size > 0, size, 1), np.nan)


def _top(x: np.ndarray, k: int) -> np.ndarray:
    """Which entries are the k largest of each row, later ones first among equals."""
    mask = np.zeros(x.shape, bool)
    np.put_along_axis(mask, np.argsort(x, axis=1, kind="stable")[:, x.shape[1] - k :], True, axis=1)
    return mask


def _share(both: np.ndarray, either: np.ndarray) -> np.ndarray:
    return both.sum(axis=1) / np.maximum(either.sum(axis=1), 1)


def disagreement_of(a: np.ndarray, b: np.ndarray, top: int = 50) -> np.ndarray:
    n = a.shape[1]
    active = (a != 0) & (b != 0)
    agree = np.where(active.any(axis=1), _share(active & (np.sign(a) == np.sign(b)), active), np.nan)
    changing = (a.std(axis=1) > 0) & (b.std(axis=1) > 0) & (n >= 3)
    k = min(top, n // 2)
    ta, tb = _top(np.abs(a), k), _top(np.abs(b), k)
    limit = np.median(np.abs(a - b), axis=1)[:, None]
    la, lb = np.abs(a) > limit, np.abs(b) > limit
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    seen = (na > 1e-12) & (nb > 1e-12)
    va, vb = a.var(axis=1), b.var(axis=1)
    spread = (va > 1e-12) & (vb > 1e-12)
    tail = _top((np.abs(a) + np.abs(b)) / 2, max(1, int(0.05 * n)))
    with np.errstate(all="ignore"):
        return np.column_stack(
            [
                _rms(a - b),
                agree,
                np.where(changing, _correlation(average_ranks(a), average_ranks(b)), np.nan),
                _share(ta & tb, ta | tb) if k else np.full(len(a), np.nan),
                np.where(limit[:, 0] > 0, _share(la & lb, la | lb), np.nan),
                np.where(seen, 1 - (a * b).sum(axis=1) / (na * nb), np.nan),
                np.where(spread, np.abs(np.log(va / vb)), np.nan),
                np.sqrt((np.where(tail, a - b, 0) ** 2).sum(axis=1) / tail.sum(axis=1)),
            ]
        )


def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mean, gap = (a + b) / 2, a - b
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    p = lambda x, q: np.quantile(np.abs(x), q, axis=1)
    return np.column_stack(
        [
            _rms(mean),
            _rms(gap) / 2,
            _rms(a),
            _rms(b),
            (a * b).sum(axis=1) / np.maximum(size, 1e-12),
            np.abs(mean).mean(axis=1),
            np.abs(mean).max(axis=1),
            np.abs(gap).mean(axis=1),
            (np.sign(a) == np.sign(b)).mean(axis=1),
            p(mean, 0.9),
            p(mean, 0.99),
            p(gap, 0.9),
            p(gap, 0.99),
            mean.std(axis=1),
            gap.std(axis=1),
        ]
    )


def _features(names: tuple[str, ...], of, a: Column, b: Column) -> Column:
    """A struct of names; null where a vector is null, empty or has another length than its partner; undefined features are null."""

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def run(first: pa.Array, second: pa.Array) -> pa.Array:
        sizes = [pc.list_value_length(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in (first, second)]
        out = np.full((len(first), len(names)), np.nan)
        for n in set(sizes[0][(sizes[0] == sizes[1]) & (sizes[0] > 0)].tolist()):
            at = np.flatnonzero((sizes[0] == n) & (sizes[1] == n))
            x, y = (c.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n) for c in (first, second))
            out[at] = of(x, y)
        return pa.StructArray.from_arrays([pa.array(out[:, k], from_pandas=True) for k in range(len(names))], names)

    return run(a, b)


def disagreement(a: Column, b: Column) -> Column:
    """Eight features: distance, agreement of signs and of ranks, overlap of the largest and of the active entries, angle, ratio of variances, distance of the tail."""
    return _features(DISAGREEMENT, disagreement_of, a, b)


def pair_features(a: Column, b: Column) -> Column:
    """Fifteen features of the pair's mean and difference."""
    return _features(PAIR, pair_of, a, b)
