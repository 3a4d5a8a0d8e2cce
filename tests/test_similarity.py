"""Neighbours, likeness, retrieval and distances of blocks against all pairs in NumPy; copies, zeros and missing vectors included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.operators import priors, similarity

BY_BLOCKS = "FlatMapCoGroupsInArrow"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def vectors():
    v = np.random.default_rng(5).normal(size=(60, 7))
    v[20:40] = v[:20]  # copies
    v[59] = 0.0
    return v


@pytest.fixture(scope="module")
def sides(spark, vectors):
    rows = [(k // 30, k, x.tolist()) for k, x in enumerate(vectors)] + [(0, 90, None), (1, 91, [1.0, None, 2.0, 0.0, 0.0, 0.0, 0.0]), (1, 92, [1.0, 2.0])]
    queries = spark.createDataFrame(rows, "p int, id long, v array<double>").repartition(3)
    return queries, queries.select("p", F.col("id").alias("source"), F.col("v").alias("w"))


def strict(x, y):
    out = 0.0
    for a, b in zip(x.tolist(), y.tolist(), strict=True):
        out += a * b
    return out


def cosine(v, i, j):
    return strict(v[i], v[j]) / (np.sqrt(strict(v[i], v[i])) * np.sqrt(strict(v[j], v[j])))


def pool_of(i):
    return [j for j in range(59) if j // 30 == i // 30]


@pytest.mark.parametrize("block", [1 << 14, 4])
def test_neighbours_by_blocks(spark, sides, vectors, monkeypatch, block):
    monkeypatch.setattr(priors, "BLOCK", block)
    monkeypatch.setattr(similarity, "PRODUCTS", 50)
    found = similarity.neighbours(*sides, ["p"], 3, others=True)
    assert BY_BLOCKS in plan(found)
    want = {(i, j, cosine(vectors, i, j), n) for i in range(59) for n, j in enumerate(sorted((j for j in pool_of(i) if j != i), key=lambda j: (-cosine(vectors, i, j), j))[:3], 1)}
    got = [(r.id, r.source, r.cosine, r.nth) for r in found.collect() if r.id != 92]
    assert set(got) == want and len(got) == len(want)


def test_weighted_neighbours_by_blocks(spark, sides, vectors, monkeypatch):
    monkeypatch.setattr(priors, "BLOCK", 4)
    found = similarity.softmax_weights(similarity.neighbours(*sides, ["p"], 4), ["p"], 0.1)
    values = sides[1].select("source", F.posexplode("w").alias("position", "x")).filter("x is not null")
    out = similarity.weighted_prediction(found, values, ["p"])
    assert BY_BLOCKS in plan(out)
    got = {(r.id, r.position): r.prediction for r in out.collect()}
    for i in range(59):
        best = sorted(pool_of(i), key=lambda j: (-cosine(vectors, i, j), j))[:4]
        w = np.exp((np.array([cosine(vectors, i, j) for j in best]) - cosine(vectors, i, best[0])) / 0.1)
        assert np.allclose([got[i, k] for k in range(7)], w @ vectors[best] / w.sum())


def test_likeness_by_blocks(spark, sides, vectors, monkeypatch):
    monkeypatch.setattr(priors, "BLOCK", 4)
    found = similarity.likeness(*sides, ["p"])
    assert BY_BLOCKS in plan(found)
    got = {r.id: (r.n, r.greatest, r["mean"]) for r in found.collect()}
    for i in range(59):
        c = [cosine(vectors, i, j) for j in pool_of(i)]
        assert np.allclose(got[i], (len(c), max(c), np.mean(c)))
    assert 59 not in got and 91 not in got


def test_retrieval_by_blocks(spark, sides, vectors, monkeypatch):
    monkeypatch.setattr(priors, "BLOCK", 4)
    noisy = np.array([x[::-1] for x in vectors])
    queries = spark.createDataFrame([(k // 30, k, x.tolist()) for k, x in enumerate(noisy)], "p int, id long, v array<double>")
    found = similarity.retrieval(queries, sides[1], ["p"], 2)
    assert BY_BLOCKS in plan(found)
    got = {r.id: (r.n, r.rank) for r in found.collect()}
    both = np.concatenate([noisy, vectors])
    for i in range(59):
        c = {j: cosine(both, i, j + 60) for j in pool_of(i)}
        assert got[i] == (len(c), sum(x > c[i] for x in c.values()) + (sum(x == c[i] for x in c.values()) + 1) / 2)
    assert 59 not in got


def test_farther_truths_by_blocks(spark, sides, vectors, monkeypatch):
    monkeypatch.setattr(priors, "BLOCK", 4)
    noisy = np.array([x[::-1] for x in vectors])
    queries = spark.createDataFrame([(k // 30, k, x.tolist()) for k, x in enumerate(noisy)], "p int, id long, v array<double>")
    found = similarity.centroid_accuracy(queries, sides[1], ["p"])
    assert BY_BLOCKS in plan(found)
    got = {r.id: r.accuracy for r in found.collect()}
    far = lambda i, j: np.sqrt(strict(noisy[i] - vectors[j], noisy[i] - vectors[j]) / 7)
    for i in range(60):
        others = [j for j in range(60) if j // 30 == i // 30 and j != i]
        assert abs(got[i] - np.mean([far(i, i) < far(i, j) for j in others])) < 1e-12
