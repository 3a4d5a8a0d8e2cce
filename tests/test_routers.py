"""Routers against refits on the rows themselves, triage by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.operators import routers

FEATURES = ["a", "b"]


def records(sets="wxyz", seed=3):
    draw = random.Random(seed)
    rows = []
    for d in sets:
        for f in range(1 + ord(d) % 3):
            for k in range(6 + 5 * f):
                a, b = draw.random(), draw.random()
                rows.append((d, f, len(rows), a, b, 0.6 * a - 0.4 * b + 0.3 * draw.random() + {"w": 0.1}.get(d, 0)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([*rows, ("w", 0, 900, None, 0.5, 0.5), ("w", 0, 901, 0.5, 0.5, None)], "d string, f int, id int, a double, b double, y double").repartition(3)


def fitted(x, y, weights, penalty, kept):
    """The ridge on chosen features, from the rows."""
    w = weights / weights.sum()
    mx, my = w @ x, w @ y
    z = x - mx
    b = np.zeros(x.shape[1])
    if kept:
        g = (z * weights[:, None]).T @ z + penalty * np.eye(x.shape[1])
        b[kept] = np.linalg.solve(g[np.ix_(kept, kept)], ((z * weights[:, None]).T @ (y - my))[kept])
    loss = weights @ (y - my - z @ b) ** 2 + penalty * b @ b
    return loss, np.array([my - mx @ b, *b])


def test_meta_router_equals_weighted_refits_without_negative_coefficients(spark):
    rows = records()
    found, fits = routers.meta_router(frame(spark, rows), "d", "f", FEATURES, "y", "risk")
    fits = {r.d: r for r in fits.collect()}
    assert set(fits) == set("wxyz")
    for d, fit in fits.items():
        train = [r for r in rows if r[0] != d]
        folds = {(r[0], r[1]): sum(q[:2] == r[:2] for q in train) for r in train}
        w = np.array([len(train) / (3 * sum(k[0] == r[0] for k in folds) * folds[r[:2]]) for r in train])
        x, y = np.array([r[3:5] for r in train]), np.array([r[5] for r in train])
        tried = [fitted(x, y, w, 10.0, kept) for kept in ([], [0], [1], [0, 1])]
        want = min((t for t in tried if (t[1][1:] >= 0).all()), key=lambda t: t[0])[1]  # the best of all signs
        assert fit.n == len(train) and np.allclose(fit.b, want, atol=1e-9) and fit.b[2] == 0 < fit.b[1]
    got = {r.id: r for r in found.collect()}
    assert len(got) == len(rows) + 2 and got[900].risk is None
    assert all(got[r[2]].risk == pytest.approx(np.dot(fits[r[0]].b, [1, *r[3:5]])) for r in rows)


def test_one_data_set_has_no_router(spark):
    found, fits = routers.meta_router(frame(spark, records("w")), "d", "f", FEATURES, "y", "risk")
    assert found.count() == 0 and fits.first().b is None
    assert routers.meta_router(frame(spark, []).filter("false"), "d", "f", FEATURES, "y", "risk")[0].count() == 0


def test_residual_risk_equals_nested_refits(spark):
    rows, penalties = records(), (0.0, 1.0, 100.0)
    found, fits = routers.residual_risk(frame(spark, rows), "d", ["a"], ["b", "a"], "y", penalties)
    fits = {r.d: r for r in fits.collect()}
    one = lambda train, x, y, p: fitted(np.array([[r[k] for k in x] for r in train]), np.array([y[r[2]] for r in train]), np.ones(len(train)), p, list(range(len(x))))[1]
    at = lambda b, r, x: b[0] + sum(w * r[k] for w, k in zip(b[1:], x))

    def nested(train, x, y):
        sets = sorted({r[0] for r in train})
        apart = {(d, p): one([r for r in train if r[0] != d], x, y, p) for d in sets for p in penalties}
        mae = [np.mean([abs(at(apart[r[0], p], r, x) - y[r[2]]) for r in train]) for p in penalties]
        best = penalties[int(np.argmin(mae))]
        return best, one(train, x, y, best), {r[2]: at(apart[r[0], best], r, x) for r in train}

    got = {r.id: r for r in found.collect()}
    for d in "wxyz":
        train, truth = [r for r in rows if r[0] != d], {r[2]: r[5] for r in rows}
        p, b, seen = nested(train, [3], truth)
        q, c, _ = nested(train, [4, 3], {k: truth[k] - v for k, v in seen.items()})
        assert (fits[d].base_penalty, fits[d].residual_penalty) == (p, q)
        assert np.allclose(fits[d].base_b, b, atol=1e-9) and np.allclose(fits[d].residual_b, c, atol=1e-8)
        for r in rows:
            if r[0] == d:
                assert got[r[2]].base_risk == pytest.approx(at(b, r, [3])) and got[r[2]].risk == pytest.approx(at(b, r, [3]) + at(c, r, [4, 3]))
    assert got[900].risk is None and got[901].risk is not None
    few = routers.residual_risk(frame(spark, records("wx")), "d", ["a"], ["b"], "y", penalties)[0]
    assert few.count() == len(records("wx")) + 2 and few.filter("risk is not null").count() == 0


def test_triage_by_hand(spark):
    errors = [1.0, 2.0, 3.0, 4.0, 10.0]
    rows = [("s", k, float(k), e) for k, e in enumerate(errors)] + [("s", 9, None, 5.0), ("flat", 1, 1.0, 2.0), ("flat", 0, 1.0, 4.0), (None, 1, 1.0, 1.0)]
    got = {r.g: r for r in routers.triage(spark.createDataFrame(rows, "g string, id int, s double, e double"), ["g"], "s", "e", "id").collect()}
    assert set(got) == {"s", "flat"}
    kept = [np.mean(errors[: max(1, -(-k * 5 // 20))]) for k in range(10, 21)]
    area = sum((p + q) / 2 * 0.05 for p, q in zip(kept, kept[1:])) / 0.5
    r = got["s"]
    assert r.normalized_aurc == pytest.approx(area / 4) and r.enrichment == pytest.approx(2.5) and r.reduction == pytest.approx((4 - 2.5) / 4) and r.capture == pytest.approx(0.5) and r.rho == pytest.approx(1)
    assert got["flat"].rho == 0 and got["flat"].enrichment == pytest.approx(2 / 3)  # the later id of equal scores goes first
