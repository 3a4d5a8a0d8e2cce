"""Models that have not seen what they score: every fit is a difference of sums.

Moments of features and target are summed up once, for each smallest set of rows that any fit leaves out; a fit's moments are the whole
less what it leaves out. All fits are rows of a table, solved where they stand, so their number does not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.ranks import average_ranks, quantiles
from veritrail.sources.storage import written


def moments(rows: DataFrame, keys: list[str], features: list[Column], target: Column) -> DataFrame:
    """(keys, m): sums of products of (1, features, target), the upper triangle row by row; rows that lack a value are left out."""
    columns = [F.lit(1.0), *(f.cast("double") for f in features), target.cast("double")]
    named = rows.select(*keys, *(c.alias(f"__x{k}") for k, c in enumerate(columns))).dropna(subset=[f"__x{k}" for k in range(len(columns))])
    x = [F.col(f"__x{k}") for k in range(len(columns))]
    return named.groupBy(*keys).agg(F.array(*(F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x)))).alias("m"))


def _less(whole: Column, part: Column) -> Column:
    return F.zip_with(whole, part, lambda a, b: a - b)


def summed_moments(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m) of a table of moments with more keys, which has a row for each cell."""
    long = cells.select(*keys, F.posexplode("m").alias("__k", "__v")).groupBy(*keys, "__k").agg(F.sum("__v").alias("__v"))
    return long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__k", "__v"))).alias("m")).withColumn("m", F.transform("m", lambda s: s["__v"]))


def elastic_net(m: np.ndarray, alpha: float, l1: float, nonnegative: bool = False, least: int = 12) -> np.ndarray | None:
    """Intercept and coefficients from moments: squared error over 2n plus alpha times l1 of their sizes and (1 - l1) / 2 of their squares, features standardised; None for too few rows or a constant target."""
    size = int((np.sqrt(8 * len(m) + 1) - 1) / 2)
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = m
    full = full + np.triu(full, 1).T
    n = full[0, 0]
    if n < least:
        return None
    mean = full[0, 1:] / n
    cov = full[1:, 1:] / n - np.outer(mean, mean)
    gram, cross, spread = cov[:-1, :-1], cov[:-1, -1], cov[-1, -1]
    if spread <= 1e-12 * max(1.0, mean[-1] ** 2):
        return None
    scale = np.sqrt(np.maximum(np.diag(gram), 0))
    scale = np.where(scale <= 1e-9 * np.maximum(1.0, np.abs(mean[:-1])), 0.0, scale)  # a constant feature has no part
    safe = np.where(scale > 0, scale, 1.0)
    g, c = gram / np.outer(safe, safe), np.where(scale > 0, cross / safe, 0.0)
    np.fill_diagonal(g, 1.0)
    if l1 == 0 and not nonnegative:
        b = np.linalg.solve(g + alpha * np.eye(len(g)), c)
    else:
        b = np.zeros(len(g))
        for _ in range(5000):
            before = b.copy()
            for j in range(len(b)):
                rest = c[j] - g[j] @ b + g[j, j] * b[j]
                shrunk = np.sign(rest) * max(abs(rest) - alpha * l1, 0.0)
                b[j] = (max(shrunk, 0.0) if nonnegative else shrunk) / (g[j, j] + alpha * (1 - l1))
            if np.abs(b - before).max() < 1e-13:
                break
    b = np.where(scale > 0, b / safe, 0.0)
    return np.concatenate([[mean[-1] - mean[:-1] @ b], b])


def solved(fits: DataFrame, alpha: float, l1: float, nonnegative: bool, least: int) -> DataFrame:
    """fits with n, the rows each was fitted on, and b, its intercept and coefficients or null, in place of the moments."""

    @F.arrow_udf("array<double>")
    def solve(m: pa.Array) -> pa.Array:
        out = [elastic_net(np.array(row, float), alpha, l1, nonnegative, least) for row in m.to_pylist()]
        return pa.array([None if b is None else b.tolist() for b in out], pa.list_(pa.float64()))

    return written(fits.withColumns({"n": F.round(F.get("m", F.lit(0))).cast("long"), "b": solve("m")}).drop("m"))


def lodo_fits(train: DataFrame, held: str, scope: list[str], features: list[str], target: str, alpha: float, l1: float, nonnegative: bool = False, least: int = 12) -> DataFrame:
    """(scope, held, n, b): of each value of held the fit on all training rows of its scope but those of that value."""
    cells = written(moments(train, [*scope, held], [F.col(f) for f in features], F.col(target)))
    whole = summed_moments(cells.withColumn("__all", F.lit(0)), [*scope, "__all"]).withColumnRenamed("m", "__whole")
    values = cells.select(held).distinct()
    # a scope without rows of a value leaves out nothing
    grid = whole.join(values.withColumn("__all", F.lit(0)), "__all").join(cells, [*scope, held], "left")
    rest = F.when(F.col("m").isNull(), F.col("__whole")).otherwise(_less(F.col("__whole"), F.col("m")))
    return solved(grid.select(*scope, held, rest.alias("m")), alpha, l1, nonnegative, least)


def crossed_fits(train: DataFrame, dataset: str, predictor: str, features: list[str], target: str, alpha: float, l1: float, nonnegative: bool = False, least: int = 12) -> dict[str, DataFrame]:
    """lopo: (predictor, n, b) fitted on all other predictors; lodo_lopo: (dataset, predictor, n, b) on other predictors in other data sets."""
    cells = written(moments(train, [dataset, predictor], [F.col(f) for f in features], F.col(target)))
    marked = cells.withColumn("__all", F.lit(0))
    whole = summed_moments(marked, ["__all"]).withColumnRenamed("m", "__w")
    by_set = summed_moments(cells, [dataset]).withColumnRenamed("m", "__d")
    by_predictor = written(summed_moments(cells, [predictor]).withColumnRenamed("m", "__p"))
    lopo = by_predictor.withColumn("__all", F.lit(0)).join(whole, "__all").select(predictor, _less(F.col("__w"), F.col("__p")).alias("m"))
    grid = by_set.withColumn("__all", F.lit(0)).join(by_predictor.withColumn("__all", F.lit(0)), "__all").join(whole, "__all").join(cells, [dataset, predictor], "left")
    rest = _less(_less(F.col("__w"), F.col("__d")), F.col("__p"))
    both = F.when(F.col("m").isNull(), rest).otherwise(F.zip_with(rest, "m", lambda a, b: a + b))
    return {"lopo": solved(lopo, alpha, l1, nonnegative, least), "lodo_lopo": solved(grid.select(dataset, predictor, both.alias("m")), alpha, l1, nonnegative, least)}


def scored(rows: DataFrame, fits: DataFrame, keys: list[str], features: list[str], out: str) -> DataFrame:
    """rows that have a fit of their keys, with out, what it predicts; null where a feature is missing."""
    joined = rows.join(fits.select(*keys, F.col("b").alias("__b")).filter("__b is not null"), keys)
    x = F.array(F.lit(1.0), *(F.col(f).cast("double") for f in features))
    return joined.withColumn(out, F.aggregate(F.zip_with("__b", x, lambda b, v: b * v), F.lit(0.0), lambda s, v: s + v)).drop("__b")


def rank_target(train: DataFrame, group: list[str], error: str, out: str) -> DataFrame:
    """train with the error's average rank as a share of its group's rows; rows without error are left out."""
    rows = average_ranks(train, group, error, "__rank", "__size")
    return rows.withColumn(out, F.col("__rank") / F.col("__size")).drop("__rank", "__size")


def spline_terms(x: Column, knots: list[Column]) -> list[Column]:
    """A cubic spline that is straight beyond its outer knots: x, and a term for each knot but the last two."""
    cube = lambda k: F.pow(F.greatest(x - k, F.lit(0.0)), 3)
    last, before = knots[-1], knots[-2]
    slope = lambda k: F.try_divide(cube(k) - cube(last), last - k)
    wide = (last - knots[0]) * (last - knots[0])
    return [x, *(F.try_divide(slope(k) - slope(before), wide) for k in knots[:-2])]


def spline_crossfitted(rows: DataFrame, fold: str, x: str, y: str, out: str, degrees: int = 4, penalty: float = 1e-8) -> DataFrame:
    """rows with out: what a spline of x with so many degrees of freedom expects of y, fitted on the rows of all other folds.

    Knots are the quantiles of all x, so one set of moments serves all folds; equal knots give terms without effect. Rows without x have null.
    """
    shares = {f"__k{k}": 0.05 + 0.9 * k / degrees for k in range(degrees + 1)}
    knots = quantiles(rows.withColumn("__all", F.lit(0)), ["__all"], F.col(x), shares).drop("__all").first()
    if knots is None or knots[0] is None:
        return rows.withColumn(out, F.lit(None).cast("double"))
    terms = spline_terms(F.col(x).cast("double"), [F.lit(float(k)) for k in knots])
    names = [f"__s{k}" for k in range(degrees)]
    wide = rows.withColumns({n: F.coalesce(t, F.when(F.col(x).isNotNull(), 0.0)) for n, t in zip(names, terms, strict=True)})
    fits = lodo_fits(wide, fold, [], names, y, penalty, 0.0, least=degrees + 1)
    return scored(wide, fits, [fold], names, out).drop(*names)
