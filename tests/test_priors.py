"""Predictions from alike tasks against loops over whole matrices."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.operators import priors, programs

WORDS = [("CDK4+MYC", "A549"), ("stat1", "K562"), ("ctrl", "hepg2"), ("SOX2_KLF4", "A549"), ("", "K562"), ("HDAC1", "HDAC1"), ("TP53", "hepg2")]


def hashed(label, size):
    out = np.zeros(size)
    text = label
    for c in "_+,-":
        text = text.replace(c, "\0")
    for part in [p for p in [label, *text.split("\0")] if p]:
        digest = hashlib.sha256(part.encode()).digest()
        for j in range(0, min(32, size), 2):
            out[digest[j] % size] += 1 if digest[j + 1] % 2 else -1
    return out / (np.linalg.norm(out) or 1)


def prior(pert, ctx, size):
    marks = [float(any(w in f"{pert} {ctx}".upper() for w in words)) for words in priors.PATHWAYS.values()]
    v = np.concatenate([marks, hashed(f"{pert}::{ctx}", size)])
    return v / (np.linalg.norm(v) or 1)


@pytest.fixture(scope="module")
def tasks():
    draw = np.random.default_rng(11)
    return [(int(k), k % 2, *WORDS[draw.integers(len(WORDS))], draw.normal(size=12), draw.normal(size=12), bool(draw.random() < 0.6)) for k in range(60)]


def frame(spark, tasks):
    rows = [(i, p, a, b, e.tolist(), c.tolist(), t) for i, p, a, b, e, c, t in tasks]
    return spark.createDataFrame(rows, "id long, pool int, perturbation string, context string, effect array<double>, control array<double>, train boolean").repartition(3)


def neighbours(tasks, task, vectors, k):
    scored = [(-float((vectors[task[0]] * vectors[t[0]]).sum()), t[0]) for t in tasks if t[1] == task[1] and t[6]]
    best = sorted(scored)[:k]
    return np.array([-s for s, _ in best]), [i for _, i in best]


def clipped(s):
    s = np.maximum(s, 0)
    return s / s.sum() if s.sum() > 1e-8 else np.full(len(s), 1 / len(s))


def test_features_of_labels(spark, tasks):
    got = frame(spark, tasks).select("id", priors.prior_features(F.col("perturbation"), F.col("context"), 64).alias("v")).collect()
    by_id = {t[0]: t for t in tasks}
    assert all(np.allclose(r.v, prior(*by_id[r.id][2:4], 64)) for r in got)


@pytest.mark.parametrize("block", [1024, 4])
def test_nearest_of_blocks_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(priors, "BLOCK", block)
    draw = np.random.default_rng(2)
    v = draw.integers(-2, 3, (50, 3)).astype(float)  # many ties
    rows = spark.createDataFrame([(k, k % 3, x.tolist()) for k, x in enumerate(v)] + [(90, 0, None)], "id long, pool int, v array<double>").repartition(4)
    got = priors.nearest(rows, rows.filter("pool < 2").select("pool", F.col("id").alias("source"), F.col("v").alias("w")), ["pool"], 4).collect()
    want = {(i, j, float(v[i] @ v[j]), n) for i in range(50) if i % 3 < 2 for n, j in enumerate(sorted((j for j in range(50) if j % 3 == i % 3), key=lambda j: (-(v[i] @ v[j]), j))[:4], 1)}
    assert {(r.id, r.source, r.score, r.nth) for r in got} == want and len(got) == len(want)


def test_smoothing_and_barycentres(spark, tasks):
    effect = {t[0]: t[4] for t in tasks}
    p = {t[0]: prior(t[2], t[3], 128) for t in tasks}
    unit = lambda v: v / np.linalg.norm(v)
    b = {t[0]: np.concatenate([unit(t[5]) * 0.55**0.5, prior(t[2], t[3], 96) * 0.45**0.5]) for t in tasks}
    smooth = {r.id: r for r in priors.prior_smoothed(frame(spark, tasks), ["pool"], "out").collect()}
    bary = {r.id: r for r in priors.barycentric(frame(spark, tasks), ["pool"], "out").collect()}
    for t in tasks:
        s, ids = neighbours(tasks, t, p, 7)
        w = clipped(s)
        assert np.allclose(smooth[t[0]].out, sum(x * effect[i] for x, i in zip(w, ids)))
        s, ids = neighbours(tasks, t, b, 7)
        w = s - s.min() + 1e-3
        assert np.allclose(bary[t[0]].out, sum(x * effect[i] for x, i in zip(w / w.sum(), ids)))
    none = priors.prior_smoothed(frame(spark, [(*t[:6], t[1] == 0) for t in tasks]), ["pool"], "out")
    assert none.count() == len(tasks) and none.filter("pool = 1 and out is not null").count() == 0


def test_latent_delta_blends_in_program_space(spark, tasks):
    df = frame(spark, tasks)
    bank = programs.fit_programs(df.filter("train"), "effect", 5, "pca")
    got = {r.id: r.out for r in priors.latent_delta(df, bank, ["pool"], "out").collect()}
    score = lambda e: (e - bank.mean) @ bank.components.T
    z = {t[0]: score(t[4]) for t in tasks if t[6]}
    p = {t[0]: prior(t[2], t[3], 96) for t in tasks}
    for t in tasks:
        s, ids = neighbours(tasks, t, p, 5)
        near = score(sum(x * (z[i] @ bank.components + bank.mean) for x, i in zip(clipped(s), ids)))
        same = [z[u[0]] for u in tasks if u[6] and u[2] == t[2]] or list(z.values())
        assert np.allclose(got[t[0]], (0.65 * np.mean(same, axis=0) + 0.35 * near) @ bank.components + bank.mean)


def test_ridge_on_labels(spark, tasks):
    got = {r.id: r.out for r in priors.label_ridge(frame(spark, tasks), "out", size=16, most_control=5).collect()}
    x = np.array([np.concatenate([hashed(t[2], 16), hashed(t[3], 16), hashed(t[2], 16) * hashed(t[3], 16), t[5][:5]]) for t in tasks])
    train = np.array([t[6] for t in tasks])
    sd = x[train].std(axis=0)
    z = (x - x[train].mean(axis=0)) / np.where(sd < 1e-6, 1, sd)
    y = np.array([t[4] for t in tasks])
    want = z @ np.linalg.solve(z[train].T @ z[train] + 5 * np.eye(z.shape[1]), z[train].T @ y[train])
    assert np.allclose([got[t[0]] for t in tasks], want)


@pytest.mark.parametrize("block", [1024, 3])
def test_transport_by_controls(spark, tasks, monkeypatch, block):
    monkeypatch.setattr(priors, "BLOCK", block)
    known = [(*t[:6], t[6] and t[2] != "stat1" and (t[2] != "TP53" or t[3] == "hepg2")) for t in tasks]
    got = {r.id: r for r in priors.control_transported(frame(spark, known), "out").collect()}
    train = [t for t in known if t[6]]
    for t in known:
        same = [u for u in train if u[2] == t[2]]
        used = [u for u in same if u[3] != t[3]] or same
        r = got[t[0]]
        if not used:
            assert np.allclose(r.out, np.mean([u[4] for u in train], axis=0)) and r.likeness == 0 and r.unsafe
            continue
        s = np.array([t[5] @ u[5] / (np.linalg.norm(t[5]) * np.linalg.norm(u[5]) + 1e-8) for u in used])
        w = np.exp(5 * (s - s.max()))
        assert np.allclose(r.out, (w / w.sum()) @ np.array([u[4] for u in used])) and r.likeness == pytest.approx(s.max()) and r.unsafe == (s.max() < 0.35)


def test_graph_transport_and_support(spark, tasks):
    df = frame(spark, tasks)
    got = {r.id: r for r in priors.graph_transported(df, ["pool"], "out", 5, "pca", size=8).collect()}
    bank = programs.fit_programs(df.filter("train"), "effect", 5, "pca")
    score = lambda e: (e - bank.mean) @ bank.components.T
    base = {r.id: (np.array(r.base), np.array(r.source)) for r in programs.baseline_and_source(df).collect()}
    p, effect = {t[0]: prior(t[2], t[3], 8) for t in tasks}, {t[0]: t[4] for t in tasks}
    x = []
    for t in tasks:
        s, ids = neighbours(tasks, t, p, 5)
        near = score(sum(w * effect[i] for w, i in zip(clipped(s), ids)))
        source = score(base[t[0]][1])
        x.append(np.concatenate([source, score(t[5]), near, p[t[0]], source * near]))
    x, train, y = np.array(x), np.array([t[6] for t in tasks]), np.array([score(t[4]) for t in tasks])
    sd = x[train].std(axis=0)
    z = (x - x[train].mean(axis=0)) / np.where(sd < 1e-6, 1, sd)
    shift = y[train].mean(axis=0)
    carried = (z @ np.linalg.solve(z[train].T @ z[train] + 5 * np.eye(z.shape[1]), z[train].T @ (y[train] - shift)) + shift) @ bank.components + bank.mean
    assert np.allclose([got[t[0]].out for t in tasks], [0.82 * base[t[0]][0] + 0.18 * c for t, c in zip(tasks, carried)])
    support = {r.id: r.uncertainty for r in priors.with_support(df).collect()}
    assert all(support[t[0]] == pytest.approx(1 / (1 + sum(u[6] and u[2] == t[2] and u[3] != t[3] for u in tasks))) for t in tasks)


def test_blocks_hold_few_products_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(priors, "PRODUCTS", 40)
    v = np.random.default_rng(4).integers(-2, 3, (50, 3)).astype(float)
    rows = spark.createDataFrame([(k, 0, x.tolist()) for k, x in enumerate(v)], "id long, pool int, v array<double>")
    got = priors.nearest(rows, rows.select("pool", F.col("id").alias("source"), F.col("v").alias("w")), ["pool"], 4).collect()
    want = {(i, j, float(v[i] @ v[j]), n) for i in range(50) for n, j in enumerate(sorted(range(50), key=lambda j: (-(v[i] @ v[j]), j))[:4], 1)}
    assert {(r.id, r.source, r.score, r.nth) for r in got} == want and len(got) == len(want)
