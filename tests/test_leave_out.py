"""Fits from differences of moments against refits on the rows themselves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.operators import leave_out

FEATURES = ["a", "b", "c"]


def records(seed=0):
    draw = random.Random(seed)
    rows = []
    for d in ("x", "y", "z"):
        for p in ("p0", "p1", "p2"):
            for k in range(0 if (d, p) == ("z", "p2") else 14):
                a, b = draw.gauss(5, 2), draw.random()
                rows.append((d, p, k, a, b, 1.0, 2 * a - 3 * b + draw.gauss({"x": 0, "y": 4, "z": -2}[d], 1)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([*rows, ("x", "p0", 99, None, 1.0, 1.0, 2.0), ("x", "p0", 98, 1.0, 1.0, 1.0, None)], "d string, p string, k int, a double, b double, c double, y double").repartition(3)


def refit(rows, alpha, l1=0.0):
    x, y = np.array([r[3:6] for r in rows]), np.array([r[6] for r in rows])
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-12] = np.inf
    z, c = (x - mean) / sd, y - y.mean()
    b = np.zeros(3)
    for _ in range(4000):
        for j in range(3):
            rest = z[:, j] @ (c - z @ b + z[:, j] * b[j]) / len(y)
            b[j] = np.sign(rest) * max(abs(rest) - alpha * l1, 0) / ((z[:, j] @ z[:, j]) / len(y) + alpha * (1 - l1) or 1)
    b = b / sd
    return np.array([y.mean() - mean @ b, *b])


@pytest.mark.parametrize("alpha,l1", [(0.1, 0.0), (0.05, 0.5)])
def test_fits_without_a_data_set_equal_refits(spark, alpha, l1):
    rows = records()
    got = {(r.d, r.p): r for r in leave_out.lodo_fits(frame(spark, rows), "d", ["p"], FEATURES, "y", alpha, l1).collect()}
    assert len(got) == 9
    for (d, p), r in got.items():
        rest = [x for x in rows if x[0] != d and x[1] == p]
        assert r.n == len(rest) and np.allclose(r.b, refit(rest, alpha, l1), atol=1e-8)
    few = leave_out.lodo_fits(frame(spark, rows), "d", ["p"], FEATURES, "y", alpha, l1, least=20).collect()
    assert {(r.d, r.p) for r in few if r.b is None} == {("x", "p2"), ("y", "p2")}


def test_crossed_fits_see_neither_predictor_nor_data_set(spark):
    rows = records(1)
    df = frame(spark, rows)
    fits = leave_out.crossed_fits(df, "d", "p", FEATURES, "y", 0.2, 0.0)
    for r in fits["lopo"].collect():
        assert np.allclose(r.b, refit([x for x in rows if x[1] != r.p], 0.2), atol=1e-8)
    both = fits["lodo_lopo"].collect()
    assert len(both) == 9
    for r in both:
        assert np.allclose(r.b, refit([x for x in rows if x[1] != r.p and x[0] != r.d], 0.2), atol=1e-8)
    changed = df.withColumn("y", F.when((F.col("d") == "x") | (F.col("p") == "p1"), F.col("y") * 100).otherwise(F.col("y")))
    again = {(r.d, r.p): r.b for r in leave_out.crossed_fits(changed, "d", "p", FEATURES, "y", 0.2, 0.0)["lodo_lopo"].collect()}
    assert np.allclose(again["x", "p1"], next(r.b for r in both if (r.d, r.p) == ("x", "p1")), atol=1e-6)  # held-out errors have no part
    scores = leave_out.scored(df, fits["lopo"], ["p"], FEATURES, "s").filter("k = 3 and d = 'x' and p = 'p0'").first()
    b = next(r.b for r in fits["lopo"].collect() if r.p == "p0")
    assert scores.s == pytest.approx(b[0] + b[1] * scores.a + b[2] * scores.b + b[3] * scores.c)


def test_nonnegative_and_degenerate_fits():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(50, 2))
    y = x[:, 0] - 2 * x[:, 1]
    full = np.column_stack([np.ones(50), x, y])
    m = (full.T @ full)[np.triu_indices(4)]
    b = leave_out.elastic_net(m, 0.01, 0.0, nonnegative=True)
    assert b[1] > 0 and b[2] == 0
    flat = np.column_stack([np.ones(50), x, np.full(50, 3.0)])
    assert leave_out.elastic_net((flat.T @ flat)[np.triu_indices(4)], 0.01, 0.0) is None


def test_rank_targets_are_of_training_rows(spark):
    rows = [("x", 3.0), ("x", 1.0), ("x", 1.0), ("y", 5.0), ("y", None)]
    got = leave_out.rank_target(spark.createDataFrame(rows, "g string, e double"), ["g"], "e", "t").collect()
    assert sorted((r.g, r.t) for r in got) == [("x", 0.5), ("x", 0.5), ("x", 1.0), ("y", 1.0)]


def test_spline_equals_least_squares_on_other_folds(spark):
    draw = random.Random(3)
    rows = [(k, k % 3, draw.uniform(0, 10)) for k in range(150)]
    rows = [(k, f, x, float(np.sin(x)) + draw.gauss(0, 0.1)) for k, f, x in rows]
    df = spark.createDataFrame([*rows, (900, 0, None, 1.0)], "k int, f int, x double, y double")
    got = {r.k: r.e for r in leave_out.spline_crossfitted(df, "f", "x", "y", "e").collect()}
    x, y, f = (np.array([r[k] for r in rows]) for k in (2, 3, 1))
    knots = np.quantile(x, [0.05 + 0.9 * k / 4 for k in range(5)])
    cube = lambda k: np.maximum(x - k, 0) ** 3
    slope = lambda k: (cube(k) - cube(knots[-1])) / (knots[-1] - k)
    basis = np.column_stack([np.ones(len(x)), x, *(slope(k) - slope(knots[-2]) for k in knots[:-2])])
    for fold in range(3):
        b = np.linalg.lstsq(basis[f != fold], y[f != fold], rcond=None)[0]
        for r, e in zip([r for r in rows if r[1] == fold], basis[f == fold] @ b):
            assert got[r[0]] == pytest.approx(e, abs=1e-4)
    assert got[900] is None
