"""Rough products by tiles: what they leave open is scored exactly, and the work is dealt by pairs of blocks."""

import numpy as np
import pytest

from veritrail.operators import priors, similarity, tiles


@pytest.fixture
def close_vectors():
    """Vectors whose cosines differ by less than single precision tells, with equal ones."""
    draw = np.random.default_rng(2)
    v = draw.normal(size=(70, 16))
    v[10:40] = v[3] + 1e-9 * draw.normal(size=(30, 16))
    v[40:50] = v[10]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("most", [1 << 19, 24])
def test_best_of_scores_closer_than_single_precision(close_vectors, most):
    a, b = close_vectors[:30], close_vectors
    place = np.random.default_rng(3).permutation(len(b))
    exact = lambda i, j: tiles.paired(a, b, i, j, np.multiply)
    got = tiles.best(tiles.products(a, b, most=most), 5, np.full(len(a), tiles.slack(16)), place, exact)
    every = np.array([exact(np.full(len(b), i), np.arange(len(b))) for i in range(len(a))])
    want = [(i, j) for i in range(len(a)) for j in sorted(range(len(b)), key=lambda j: (-every[i, j], place[j]))[:5]]
    assert list(zip(*(x.tolist() for x in got[:2]), strict=True)) == want


def test_counts_and_places():
    for width in (1024, 40, 13):
        mask = np.random.default_rng(width).random((7, width)) < 0.4
        assert (tiles.counted(mask) == mask.sum(axis=1)).all()
        assert all((x == y).all() for x, y in zip(tiles.places(mask), np.nonzero(mask), strict=True))


def frames(spark, queries, truths):
    rows = lambda v: [(0, k, x.tolist()) for k, x in enumerate(v)]
    return spark.createDataFrame(rows(queries), "p int, id long, v array<double>"), spark.createDataFrame(rows(truths), "p int, source long, w array<double>")


def strict(x, y, entry):
    return tiles.paired(x[None], y[None], np.zeros(1, int), np.zeros(1, int), entry)[0]


def test_ranks_and_accuracy_of_close_and_unlike_vectors(spark, close_vectors):
    truths = close_vectors.copy()
    truths[60] *= 1e4  # of another length than all others
    queries = truths[::-1] + 1e-9
    norm = lambda x: np.sqrt(strict(x, x, np.multiply))
    cosine = np.array([[strict(q, t, np.multiply) / (norm(q) * norm(t)) for t in truths] for q in queries])
    far = np.array([[np.sqrt(strict(q, t, lambda x, y: (x - y) * (x - y)) / 16) for t in truths] for q in queries])
    sides = frames(spark, queries, truths)
    ranks = {r.id: r.rank for r in similarity.retrieval(*sides, ["p"], 2).collect()}
    assert ranks == {i: (cosine[i] > cosine[i, i]).sum() + ((cosine[i] == cosine[i, i]).sum() + 1) / 2 for i in range(70)}
    near = {r.id: r.accuracy for r in similarity.centroid_accuracy(*sides, ["p"]).collect()}
    assert near == {i: (far[i] > far[i, i]).sum() / 69 for i in range(70)}
    like = {r.id: r.greatest for r in similarity.likeness(*sides, ["p"]).collect()}
    assert like == {i: cosine[i].max() for i in range(70)}


def test_nan_and_infinite_vectors(spark, close_vectors):
    truths = close_vectors.copy()
    truths[5, 0], truths[6, 1] = np.nan, np.inf
    sides = frames(spark, close_vectors, truths)
    found = {(r.id, r.nth): (r.source, r.cosine) for r in similarity.neighbours(*sides, ["p"], 3).collect()}
    assert all({found[k, 1][0], found[k, 2][0]} == {5, 6} and np.isnan(found[k, 1][1]) for k in range(70))
    assert found[60, 3][0] == 60
    like = {r.id: r for r in similarity.likeness(*sides, ["p"]).collect()}
    assert all(r.n == 70 and np.isnan(r.greatest) for r in like.values())


def test_a_task_for_each_pair_of_blocks(spark, close_vectors, monkeypatch):
    monkeypatch.setattr(priors, "BLOCK", 20)
    found = similarity.likeness(*frames(spark, close_vectors[:30], close_vectors), ["p"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "#" in plan and ", 32)" in plan  # 4 blocks of queries, 8 of sources


def test_nearest_deals_pairs_of_blocks_and_keeps_k_of_ties(spark, monkeypatch):
    monkeypatch.setattr(priors, "BLOCK", 20)
    v = np.eye(4)[np.arange(40) % 2]  # all products are 0 or 1
    queries, sources = frames(spark, v, v)
    found = priors.nearest(queries, sources, ["p"], 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and ", 64)" in plan
    got = {(r.id, r.nth): (r.source, r.score) for r in found.collect()}
    assert got == {(k, n): (k % 2 + 2 * (n - 1), 1.0) for k in range(40) for n in (1, 2, 3)}
