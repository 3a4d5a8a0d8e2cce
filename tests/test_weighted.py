"""Cluster bootstraps against plain Python that copies the drawn clusters' rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.operators import weighted as wt

B = 60


def sample(seed=0, n=260, groups=("a", None), clusters=17):
    draw = random.Random(seed)
    rows = []
    for g in groups:
        for k in range(n):
            c = draw.randrange(clusters)
            y = draw.gauss(c / 5, 1)
            rows.append((g, k % 3, f"c{c}", k, float(round(y * 2)), round(y + draw.gauss(0, 1), 1), abs(y) + 0.1))
    return rows


def frame(spark, rows):
    extra = [("a", 0, "c1", 9001, None, 1.0, 1.0), ("a", 1, "c2", 9002, 1.0, 2.0, None)]
    return spark.createDataFrame([*rows, *extra], "g string, fold int, c string, id long, s double, t double, y double").repartition(4)


def copies(rows, key, r, seed="bootstrap"):
    """The rows of replicate r: those of every drawn cluster as often as it is drawn."""
    names = sorted({x[2] for x in rows})
    times = dict(zip(names, wt.draws(seed, key, len(names), r, 1)[:, 0]))
    return [x for x in rows for _ in range(times[x[2]])]


def key(*values):
    return "[" + ",".join('"null"' if v is None else f'"={v}"' for v in values) + "]"


def ranks(values):
    order = sorted(values)
    first = {v: order.index(v) for v in set(values)}
    return [first[v] + (order.count(v) + 1) / 2 for v in values]


def spearman(a, b):
    return float(np.corrcoef(ranks(a), ranks(b))[0, 1])


def close(got, values):
    """got (estimate, low, high) against the values of replicates 0 to B."""
    drawn = [v for v in values[1:] if math.isfinite(v)]
    assert got.estimate == pytest.approx(values[0], abs=1e-9)
    assert got.low == pytest.approx(np.quantile(drawn, 0.025), abs=1e-9) and got.high == pytest.approx(np.quantile(drawn, 0.975), abs=1e-9) and got.n_valid == len(drawn)


def test_draws_are_whole_and_repeat():
    one = wt.draws("s", "k", 9, 0, 50)
    assert (one.sum(axis=0) == 9).all() and (one[:, 0] == 1).all() and (wt.draws("s", "k", 9, 20, 5) == one[:, 20:25]).all()
    assert (wt.draws("s", "other", 9, 0, 50) != one).any() and abs(wt.draws("s", "k", 40, 1, 2000).mean(axis=1) - 1).max() < 0.15


@pytest.mark.parametrize("cells", [8_000_000, 700])
def test_rank_correlations_and_paired_gains(spark, monkeypatch, cells):
    monkeypatch.setattr(wt, "CELLS", cells)
    rows = sample()
    got = {(r.g, r.metric): r for r in wt.bootstrap_spearman(frame(spark, rows), ["g"], "c", ["s", "t"], "y", B).collect()}
    for g in ("a", None):
        mine = [x for x in rows if x[0] == g]
        pairs = []
        for r in range(B + 1):
            part = copies(mine, key(g), r)
            y = [x[6] for x in part]
            pairs.append((spearman([x[4] for x in part], y), spearman([x[5] for x in part], y)))
        close(got[g, "s"], [a for a, _ in pairs])
        close(got[g, "t"], [b for _, b in pairs])
        close(got[g, "s - t"], [a - b for a, b in pairs])


def aurc(pairs):
    total, out = 0.0, 0.0
    for k, (_, e) in enumerate(pairs, 1):
        total += e
        out += total / k
    return out / len(pairs)


@pytest.mark.parametrize("cells", [8_000_000, 700])
def test_aurc_utility_and_median(spark, monkeypatch, cells):
    monkeypatch.setattr(wt, "CELLS", cells)
    rows = sample(1)
    df = frame(spark, rows)
    got = {(r.g, r.metric): r for r in wt.bootstrap_aurc(df, ["g"], "c", "s", "y", "id", B).collect()}
    useful = {(r.g, r.metric): r for r in wt.bootstrap_utility(df, ["g"], "c", "s", "y", "id", [0.1, 0.5], B).collect()}
    middle = {r.g: r for r in wt.bootstrap_median(df.filter("s is not null"), ["g"], "c", "s", "id", B).collect()}
    for g in ("a", None):
        mine = [x for x in rows if x[0] == g]
        excess, gain, utility, medians = [], [], {0.1: [], 0.5: []}, []
        for r in range(B + 1):
            part = copies(mine, key(g), r)
            errors = [x[6] for x in part]
            mean = sum(errors) / len(errors)
            own, best = aurc([(0, x[6]) for x in sorted(part, key=lambda x: (x[4], x[3]))]), aurc([(0, e) for e in sorted(errors)])
            excess.append(own - best)
            gain.append(100 * (mean - own) / mean)
            for b, out in utility.items():
                n = math.ceil(len(part) * b - 1e-9)
                chosen = [x[6] for x in sorted(part, key=lambda x: (-x[4], x[3]))[:n]]
                top = sum(sorted(errors)[-n:]) / n
                out.append((sum(chosen) / n - mean) / (top - mean))
            medians.append(float(np.median([x[4] for x in part])))
        close(got[g, "excess_aurc"], excess)
        close(got[g, "reduction_pct"], gain)
        close(useful[g, "0.1"], utility[0.1])
        close(useful[g, "0.5"], utility[0.5])
        if g is None:  # the other group has a row more with a score
            close(middle[g], medians)
    few = wt.bootstrap_aurc(df.filter("g = 'a' and c in ('c1', 'c2', 'c3')"), ["g"], "c", "s", "y", "id", 5).collect()
    assert all(r.low is None and r.estimate is not None for r in few)


def test_folds_and_hierarchy(spark):
    rows = sample(2, n=120, groups=("a", "b", "d"), clusters=8)
    df = frame(spark, rows)

    def fold_mean(g, r):
        mine = [x for x in rows if x[0] == g]
        part = copies(mine, key(g), r)
        found = [spearman([x[4] for x in part if x[1] == f], [x[6] for x in part if x[1] == f]) for f in range(3) if len({x[4] for x in part if x[1] == f}) > 1]
        return sum(found) / len(found)

    got = {r.g: r for r in wt.bootstrap_folds(df, "g", "fold", "c", ["s"], "y", 20).collect()}
    for g in ("a", "b", "d"):
        values = [fold_mean(g, r) for r in range(21)]
        assert got[g].estimate == pytest.approx(values[0]) and got[g].low == pytest.approx(np.quantile(values[1:], 0.025))
    whole = wt.bootstrap_hierarchical(df, "g", "fold", "c", ["s"], "y", 20).first()
    times, after, values = wt.draws("bootstrap", "datasets", 3, 0, 21)[:, 1:], [1, 1, 1], []
    for r in range(20):
        found = []
        for k, g in enumerate("abd"):
            for _ in range(times[k, r]):
                found.append(fold_mean(g, after[k]))
                after[k] += 1
        values.append(sum(found) / len(found))
    assert whole.estimate == pytest.approx(np.mean([fold_mean(g, 0) for g in "abd"]))
    assert whole.low == pytest.approx(np.quantile(values, 0.025)) and whole.high == pytest.approx(np.quantile(values, 0.975)) and whole.above_zero == np.mean(np.array(values) > 0)


def test_draws_are_made_once_for_some_clusters_at_a_time(spark, monkeypatch):
    df = frame(spark, sample(3, 60)).dropna(subset=["s", "t", "y"])
    rows = wt.slotted(df, ["g"], ["g"], "c")
    whole = {k: wt.draws("x", k, 17, 0, B) for k in (key("a"), key(None))}
    results = []
    for slots, run in ((1 << 15, 8192), (4, 25)):
        monkeypatch.setattr(wt, "SLOTS", slots)
        monkeypatch.setattr(wt, "RUN", run)
        got = wt.drawn(rows, "x", B).collect()
        assert len(got) == 34 and all(list(r["__draws"]) == whole[r["__d"]][r["__slot"]].tolist() for r in got)
        results.append(sorted(map(str, wt.bootstrap_spearman(df, ["g"], "c", ["s", "t"], "y", B).select("g", "metric", F.round("estimate", 9), F.round("low", 9), F.round("high", 9), "n_valid").collect())))
    assert results[0] == results[1]
