"""Small linear models from sums over any number of rows: the normal equations are aggregated, only they are solved on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_equations(df: DataFrame, features: list[str], target: str, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wy with a constant first; features are few."""
    w = weight if weight is not None else F.lit(1.0)
    columns = [F.lit(1.0), *map(F.col, features)]
    n = len(columns)
    sums = [F.sum(w * columns[i] * columns[j]) for i in range(n) for j in range(i, n)] + [F.sum(w * c * F.col(target)) for c in columns]
    row = [float(x or 0) for x in df.agg(*(s.alias(f"s{k}") for k, s in enumerate(sums))).first()]
    gram = np.zeros((n, n))
    gram[np.triu_indices(n)] = row[: n * (n + 1) // 2]
    return gram + np.triu(gram, 1).T, np.array(row[n * (n + 1) // 2 :])


def ridge(df: DataFrame, features: list[str], target: str, penalty: float) -> np.ndarray:
    """Intercept and coefficients; the intercept is not penalised."""
    gram, cross = normal_equations(df, features, target)
    return np.linalg.solve(gram + penalty * np.diag([0.0, *[1.0] * len(features)]), cross)


def predicted(coefficients: np.ndarray, features: list[str]) -> Column:
    out = F.lit(float(coefficients[0]))
    for c, f in zip(coefficients[1:], features, strict=True):
        out = out + F.lit(float(c)) * F.col(f)
    return out


def simplex_weights(df: DataFrame, features: list[str], target: str, weight: Column | None = None) -> np.ndarray:
    """Weights of features, none negative and of sum 1, with the least squared error; all active sets are tried, features are few."""
    gram, cross = normal_equations(df, features, target, weight)
    gram, cross, n = gram[1:, 1:], cross[1:], len(features)
    best, least = np.full(n, 1 / n), np.inf
    for mask in range(1, 1 << n):
        on = [k for k in range(n) if mask >> k & 1]
        system = np.block([[gram[np.ix_(on, on)], np.ones((len(on), 1))], [np.ones((1, len(on))), np.zeros((1, 1))]])
        w = np.zeros(n)
        w[on] = np.linalg.lstsq(system, np.append(cross[on], 1.0), rcond=None)[0][:-1]
        loss = w @ gram @ w - 2 * w @ cross
        if w.min() >= -1e-12 and loss < least - 1e-12:
            best, least = w, loss
    return best
