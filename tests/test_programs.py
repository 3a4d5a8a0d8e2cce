"""Program banks and transport against NumPy on whole matrices."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.operators import programs


def frame(spark, matrix, parts=5):
    return spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(matrix)], "id long, v array<double>").repartition(parts)


def spectrum(n, d, seed=0):
    draw = np.random.default_rng(seed)
    u, v = np.linalg.qr(draw.normal(size=(n, d)))[0], np.linalg.qr(draw.normal(size=(d, d)))[0]
    return (u * (2.0 ** -np.arange(d) * 100)) @ v + draw.normal(size=d)


@pytest.mark.parametrize("n,d,k", [(300, 12, 4), (40, 60, 5), (5, 8, 8)])
def test_components_equal_a_decomposition_of_the_whole_matrix(spark, n, d, k):
    x = spectrum(n, d) if n >= d else spectrum(d, n).T
    mean = x.mean(axis=0)
    got, squares = programs.principal_components(frame(spark, x), "v", k, mean)
    _, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    k = min(k, int((s > 1e-6 * s[0]).sum()))
    want = vt[:k] * np.sign(vt[np.arange(k), np.abs(vt[:k]).argmax(axis=1)])[:, None]
    assert np.abs(got[:k] - want).max() < 1e-8 and np.abs(squares[:k] - s[:k] ** 2).max() < 1e-8 * s[0] ** 2
    assert np.abs(got[:k] @ got[:k].T - np.eye(k)).max() < 1e-10


def test_factors_have_the_loss_curve_of_the_whole_matrix(spark):
    draw = np.random.default_rng(1)
    x = draw.gamma(1.0, size=(200, 4)) @ draw.gamma(0.5, size=(4, 15)) + 0.01 * draw.normal(size=(200, 15))
    mean = np.zeros(15)
    factors, losses = programs.nonnegative_factors(frame(spark, x), "v", 4, mean, passes=8, tolerance=0.0)
    one, alone = programs.nonnegative_factors(frame(spark, x, 1), "v", 4, mean, passes=8, tolerance=0.0)
    assert np.allclose(losses, alone, rtol=1e-8) and np.allclose(factors, one, rtol=1e-6, atol=1e-8)  # however rows are dealt
    assert (factors >= 0).all() and all(b <= a * (1 + 1e-9) for a, b in zip(losses, losses[1:]))
    # plain multiplicative updates of both factors on the whole matrix end no lower
    m = np.abs(x) + 1e-6
    w, h = draw.random((200, 4)), draw.random((4, 15))
    for _ in range(400):
        w *= (m @ h.T) / (w @ h @ h.T)
        h *= (w.T @ m) / (w.T @ w @ h)
    more = programs.nonnegative_factors(frame(spark, x, 2), "v", 4, mean, passes=60, tolerance=1e-4)[1]
    assert more[-1] <= 1.05 * ((m - w @ h) ** 2).sum()


def test_bank_of_all_kinds(spark):
    x = spectrum(80, 10, 3)
    bank = programs.fit_programs(frame(spark, x), "v", 9, "combo")
    assert bank.blocks == {"pca": 3, "nmf": 3, "hvg": 3} and np.allclose(np.linalg.norm(bank.components, axis=1), 1)
    order = np.argsort(-x.var(axis=0), kind="stable")[:3]
    assert (bank.components[6:].argmax(axis=1) == order).all() and bank.kinds[:4] == ["pca", "pca", "pca", "nmf"]
    rows = frame(spark, x).withColumn("z", bank.scores(F.col("v"))).withColumn("back", bank.restored(F.col("z"))).orderBy("id").collect()
    z = (x - x.mean(axis=0)) @ bank.components.T
    assert np.allclose([r.z for r in rows], z) and np.allclose([r.back for r in rows], z @ bank.components + x.mean(axis=0))
    with pytest.raises(ValueError):
        programs.fit_programs(frame(spark, x).filter("false"), "v")


def hashed(label, size):
    out = np.zeros(size)
    for part in [label, *label.replace("+", "_").replace(",", "_").replace("-", "_").split("_")]:
        if part:
            digest = hashlib.sha256(part.encode()).digest()
            for j in range(0, min(32, size), 2):
                out[digest[j] % size] += 1.0 if digest[j + 1] % 2 else -1.0
    return out / (np.linalg.norm(out) or 1.0)


def test_hashed_labels(spark):
    labels = ["A+B", "", "x_y-z", "TP53", "é,é"]
    for size in (8, 64):
        got = spark.createDataFrame([(x,) for x in labels], "l string").select("l", programs.hashed_label(F.col("l"), size).alias("h")).collect()
        assert all(np.allclose(r.h, hashed(r.l, size)) for r in got)


def test_transport_equals_plain_arrays(spark):
    draw = np.random.default_rng(5)
    perts, contexts = [f"g{k}" for k in range(12)], ["a", "b", "c"]
    tasks = [(p, c, draw.normal(size=6), draw.normal(size=6), not (draw.random() < 0.3 or p == "g3")) for p in perts for c in contexts]
    df = spark.createDataFrame([(k, c, p, e.tolist(), m.tolist(), t) for k, (p, c, e, m, t) in enumerate(tasks)], "id long, context string, perturbation string, effect array<double>, control array<double>, train boolean").repartition(4)
    got = {r.id: r for r in programs.transported(df, 4, "pca", hash_size=8).collect()}
    train = [t for t in tasks if t[4]]
    overall = np.mean([t[2] for t in train], axis=0)
    mean = lambda rows, other=None: np.mean([t[2] for t in rows], axis=0) if rows else other
    x = np.array([t[2] for t in train])
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    score = lambda v: (v - x.mean(axis=0)) @ vt[:4].T

    def parts(t):
        same = [u for u in train if u[0] == t[0]]
        others = [u for u in same if u[1] != t[1]]
        base = mean(same, overall)
        here = [u for u in train if u[1] == t[1]]
        base = 0.85 * base + 0.15 * mean(here) if here else base
        source = mean(others or same, overall)
        return base, np.concatenate([score(source), score(t[3]), hashed(t[0], 8), hashed(t[1], 8)])

    f = np.array([parts(t)[1] for t in train])
    y = np.array([score(t[2]) for t in train])
    std = f.std(axis=0)
    std[std < 1e-6] = 1
    xs = (f - f.mean(axis=0)) / std
    coef = np.linalg.solve(xs.T @ xs + 3.0 * np.eye(xs.shape[1]), xs.T @ (y - y.mean(axis=0)))
    for k, t in enumerate(tasks):
        base, features = parts(t)
        carried = ((features - f.mean(axis=0)) / std @ coef + y.mean(axis=0)) @ vt[:4] + x.mean(axis=0)
        assert np.allclose(got[k].base, base) and np.allclose(got[k].prediction, 0.9 * base + 0.1 * carried, atol=1e-8)
