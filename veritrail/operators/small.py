"""Statistics of small tables: study summaries and test counts of a few rows, computed inside one group."""

from __future__ import annotations

from math import ceil, exp, lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = exp(a * log(x) + b * log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def _solve(f, low: float, high: float) -> float:
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return (low + high) / 2


def beta_quantile(p: float, a: float, b: float) -> float:
    return _solve(lambda x: beta_cdf(x, a, b) - p, 0.0, 1.0)


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    return (0.0 if k == 0 else beta_quantile(alpha / 2, k, n - k + 1)), (1.0 if k == n else beta_quantile(1 - alpha / 2, k + 1, n - k))


def beta_binomial_cdf(k: int, n: int, a: float, b: float) -> float:
    beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    return sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + beta(j + a, n - j + b) - beta(a, b)) for j in range(k + 1))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a two-by-two table."""
    n, row, col = a + b + c + d, a + b, a + c
    choose = lambda x, y: lgamma(x + 1) - lgamma(y + 1) - lgamma(x - y + 1)
    chance = {k: exp(choose(col, k) + choose(n - col, row - k) - choose(n, row)) for k in range(max(0, row + col - n), min(row, col) + 1)}
    return min(1.0, sum(p for p in chance.values() if p <= chance[a] * (1 + 1e-7)))


def t_quantile(p: float, df: float) -> float:
    tail = lambda t: 1 - beta_cdf(df / (df + t * t), df / 2, 0.5) / 2
    return _solve(lambda t: tail(t) - p, 0.0, 1e4)


def normal_quantile(p: float) -> float:
    return t_quantile(p, 1e7) if p >= 0.5 else -t_quantile(1 - p, 1e7)


def least_n(rho: float, power: float = 0.8, alpha: float = 0.05) -> int:
    """Rows needed to see a correlation, by Fisher's approximation."""
    return ceil(((normal_quantile(1 - alpha / 2) + normal_quantile(power)) / (0.5 * log((1 + rho) / (1 - rho)))) ** 2 + 3)


def random_effects(y: np.ndarray, se: np.ndarray) -> dict[str, float]:
    """REML estimate of a mean over studies with a modified Knapp-Hartung interval, prediction interval, Q and I2."""
    n, v = len(y), se**2

    def restricted(tau2: float) -> float:
        w = 1 / (v + tau2)
        mu = (w * y).sum() / w.sum()
        return 0.5 * (np.log(v + tau2).sum() + log(w.sum()) + (w * (y - mu) ** 2).sum())

    low, high = 0.0, max(float(np.var(y)) * 10, 1e-6)
    ratio = (sqrt(5) - 1) / 2
    for _ in range(200):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if restricted(a) < restricted(b) else (a, high)
    tau2 = (low + high) / 2
    tau2 = 0.0 if restricted(0.0) <= restricted(tau2) else tau2
    w, fixed = 1 / (v + tau2), 1 / v
    mu = (w * y).sum() / w.sum()
    spread = max(1.0, (w * (y - mu) ** 2).sum() / (n - 1))
    error = sqrt(spread / w.sum())
    q = (fixed * (y - (fixed * y).sum() / fixed.sum()) ** 2).sum()
    t, t2 = t_quantile(0.975, n - 1), t_quantile(0.975, max(n - 2, 1))
    around = t2 * sqrt(tau2 + error**2)
    return {"n": n, "estimate": mu, "se": error, "low": mu - t * error, "high": mu + t * error, "predict_low": mu - around, "predict_high": mu + around, "tau2": tau2, "q": q, "i2": max(0.0, (q - (n - 1)) / q) if q > 0 else 0.0}


_META = ("estimate", "se", "low", "high", "predict_low", "predict_high", "tau2", "q", "i2")


def meta_analysis(studies: DataFrame, group: str, effect: str, error: str) -> DataFrame:
    """random_effects of each group of studies (a few rows each); groups of fewer than two studies give no row."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna().sort_values([effect, error])
        if len(rows) < 2:
            return pd.DataFrame(columns=[group, "n", *_META])
        return pd.DataFrame([{group: rows[group].iloc[0], **random_effects(rows[effect].to_numpy(float), rows[error].to_numpy(float))}])

    kind = dict(studies.dtypes)[group]
    return studies.select(group, effect, error).groupBy(group).applyInPandas(run, f"`{group}` {kind}, n long, " + ", ".join(f"{c} double" for c in _META))


def leave_one_out_meta(studies: DataFrame, study: str, effect: str, error: str) -> DataFrame:
    """random_effects of all studies but one, for each that is removed (column removed); studies are few, and two must remain."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna().sort_values([study])
        if len(rows) < 3:
            return pd.DataFrame(columns=["removed", "n", *_META])
        rest = [rows[rows[study] != removed] for removed in rows[study]]
        return pd.DataFrame([{"removed": removed, **random_effects(part[effect].to_numpy(float), part[error].to_numpy(float))} for removed, part in zip(rows[study], rest, strict=True)])

    kind = dict(studies.dtypes)[study]
    return studies.select(study, effect, error, F.lit(0).alias("__all")).groupBy("__all").applyInPandas(lambda rows: run(rows.drop(columns="__all")), f"removed {kind}, n long, " + ", ".join(f"{c} double" for c in _META))
