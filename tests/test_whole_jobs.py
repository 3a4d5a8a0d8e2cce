"""Queries against results of the whole job, worked out apart from their oracles."""

import hashlib
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from veritrail.operators import contracts, effects, graphs, resampling, similarity
from veritrail.sources import views

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.registry.QUERIES


def test_pivot_has_every_gene(spark):
    long = QUERIES["pseudobulk_effect"](spark, SF).collect()
    wide = {(r.context, r.perturbation): r for r in QUERIES["effect_long_to_wide_pivot"](spark, SF).collect()}
    assert {r.gene for r in long} == {"AF", "AO", "NF", "NO", "RF", "RO"}
    assert all(abs(wide[r.context, r.perturbation][r.gene] - r.effect) < 2e-6 for r in long)
    assert sum(v is not None for r in wide.values() for v in r[2:]) == len(long)


def test_conformal_settings_have_all_clusters(spark):
    scores, sizes = defaultdict(list), defaultdict(int)
    for r in views.scored_events(spark, SF).collect():
        key = r.dataset, "rare" if r.cluster is not None and r.cluster % 4 == 0 else "common"
        sizes[key] += 1
        if r.error is not None and r.risk is not None:
            scores[key].append(abs(r.error - r.risk))

    def order_statistic(x):
        return sorted(x)[min(len(x), math.ceil((len(x) + 1) * 0.9 - 1e-9)) - 1]

    pooled = order_statistic([x for v in scores.values() for x in v])
    got = {(r.dataset, r.setting): (r.n, r.threshold) for r in QUERIES["conformal_setting_matched"](spark, SF).collect()}
    assert got.keys() == sizes.keys()
    for key, (n, threshold) in got.items():
        assert n == sizes[key] and abs(threshold - (order_statistic(scores[key]) if len(scores[key]) >= 30 else pooled)) < 1e-6


def test_distances_along_a_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(24)] + [(30, 31)], "a int, b int")
    first = spark.createDataFrame([(0,)], "node int")
    assert {r.node: r.hops for r in graphs.distances(chain, first).collect()} == {k: k for k in range(25)}
    assert {r.node: r.hops for r in graphs.distances(chain, first, 3).collect()} == {k: k for k in range(4)}


def test_predictions_have_all_positions(spark):
    v = {r.vec_id: r for r in views.vectors(spark, SF).collect()}
    unit = {k: np.array(r.v) / np.linalg.norm(r.v) for k, r in v.items()}
    got = {(r.id, r.position): r.prediction for r in QUERIES["context_sim_prediction"](spark, SF).collect()}
    targets = [k for k, r in v.items() if r.member == 0]
    assert got.keys() == {(k, i) for k in targets for i in range(64)}
    for k in targets:
        near = sorted((-float(unit[k] @ unit[s]), s) for s, r in v.items() if r.label == v[k].label and r.member > 0)[:4]
        weights = np.exp([(near[0][0] - c) / 0.1 for c, _ in near])
        wanted = weights @ np.array([v[s].v for _, s in near]) / weights.sum()
        assert max(abs(wanted[i] - got[k, i]) for i in range(64)) < 2e-6


def test_edges_of_all_positions(spark):
    def wanted(x):
        with np.errstate(invalid="ignore", divide="ignore"):
            r = np.nan_to_num(np.corrcoef(x, rowvar=False))
        out = {}
        for b in range(len(r)):
            strongest = sorted(range(len(r)), key=lambda a: (-round(abs(r[a, b]), 9), -a))[:11]
            out |= {(a, b): r[a, b] for a in {*strongest, b} if a == b or abs(r[a, b]) >= 0.4}
        return out

    def same(got, x):
        want = wanted(x)
        return got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 or k[0] == k[1] for k in got)

    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 64)) * 0.6 + draw.normal(size=(300, 1)) * np.linspace(0, 1, 64)
    x[:, 7] = 2.0
    rows = spark.createDataFrame([(list(map(float, v)),) for v in x] + [(None,)], "v array<double>")
    got = {(r.a, r.b): r.r for r in similarity.correlated_positions(rows, "v").collect()}
    assert same(got, x) and sum(b == 63 for _, b in got) == 11 and (7, 7) in got
    vectors = np.array([r.v for r in views.vectors(spark, SF).collect()])
    got = {(r.a, r.b): r.r for r in QUERIES["coexpression_edges"](spark, SF).collect()}
    assert same(got, vectors) and {b for _, b in got} == set(range(64))


def _energy(cells):
    """(context, perturbation): n, delta, sigma of control, sigma, energy of the cells' vectors, by all pairs."""
    sides = defaultdict(lambda: defaultdict(lambda: defaultdict(float)))
    for cell, context, perturbation, gene, x in cells:
        sides[context, perturbation][cell][gene] += x
    genes = sorted({c[3] for c in cells})
    sides = {k: np.array([[v[g] for g in genes] for v in cells.values()]) for k, cells in sides.items()}
    apart = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(-1)
    sigma = lambda a: apart(a, a).sum() / len(a) / (len(a) - 1) if len(a) > 1 else math.nan
    out = {}
    for (context, perturbation), v in sides.items():
        if perturbation != views.CONTROL and (context, views.CONTROL) in sides:
            control = sides[context, views.CONTROL]
            delta = apart(control, v).mean()
            out[context, perturbation] = len(v), delta, sigma(control), sigma(v), 2 * delta - sigma(control) - sigma(v)
    return out


def test_energy_distance_has_both_sigmas(spark):
    k = views.CONTROL
    small = [("1", "x", k, "g", 4.0), ("2", "x", k, "h", 2.0), ("3", "x", k, "g", 1.0), ("3", "x", k, "g", 1.0), ("4", "x", "p", "g", 3.0), ("5", "x", "p", "i", 1.0), ("6", "x", "q", "i", 5.0), ("7", "y", "p", "g", 1.0)]
    rows = spark.createDataFrame(small, "cell string, context string, perturbation string, gene string, x double")
    names = ("n_cells", "delta", "sigma_control", "sigma", "energy")
    large = [(r.cell, r.context, r.perturbation, r.gene, r.x) for r in views.cells(spark, SF).collect()]
    for got, cells in ((effects.energy_distances(rows, k, ["context"]), small), (QUERIES["energy_distance"](spark, SF), large)):
        got, want = {(r.context, r.perturbation): [math.nan if r[c] is None else r[c] for c in names] for r in got.collect()}, _energy(cells)
        assert got.keys() == want.keys() and all(np.allclose(got[g], want[g], atol=2e-6, rtol=1e-9, equal_nan=True) for g in want)


def test_tasks_of_energy_and_cells_grow_in_number(spark, monkeypatch):
    kind = type(spark.range(1))
    tasks, deal = [], kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *c: (tasks.append((n, *c)), deal(self, n, *c))[1])
    before = sorted(map(str, QUERIES["energy_distance"](spark, SF).collect()))
    n = views.cells(spark, SF).count()
    assert tasks == [(-(-n // effects.TASK_ROWS), "context", "perturbation", "cell")]
    monkeypatch.setattr(effects, "TASK_ROWS", 1000)
    for name, value in (("JOIN_ROWS", 1000), ("DEALT_ROWS", 1), ("BROAD_ROWS", 1)):
        monkeypatch.setattr(views, name, value)
    tasks.clear()
    assert sorted(map(str, QUERIES["energy_distance"](spark, SF).collect())) == before
    assert [k for k, *_ in tasks] == [max(4, -(-n // 1000))] * 3 + [-(-n // 1000)]


def _draws(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_bootstrap_has_1000_replicates(spark):
    sums = defaultdict(lambda: defaultdict(lambda: [0.0, 0]))
    for r in views.scored_events(spark, SF).collect():
        of = sums[r.dataset][r.cluster]
        of[0], of[1] = of[0] + r.error, of[1] + 1
    got = {r.dataset: r for r in QUERIES["cluster_bootstrap_ci"](spark, SF).collect()}
    assert got.keys() == sums.keys()
    for dataset, clusters in sums.items():
        rows = np.array([clusters[c] for c in sorted(clusters)])
        picks = [rows[[_draws("boot", dataset, k, slot) % len(rows) for slot in range(len(rows))]].sum(0) for k in range(1000)]
        low, high = np.quantile([s / n for s, n in picks], [0.025, 0.975])
        assert abs(got[dataset].low - low) < 2e-6 and abs(got[dataset].high - high) < 2e-6


def test_permutations_are_200(spark):
    clusters = defaultdict(lambda: defaultdict(list))
    for r in views.scored_events(spark, SF).collect():
        clusters[r.dataset][r.cluster].append((r.risk, r.error))
    got = {r.dataset: r for r in QUERIES["permuted_flags"](spark, SF).collect()}
    assert got.keys() == clusters.keys()
    for dataset, of in clusters.items():
        high = {c for c, v in of.items() if np.mean([x for x, _ in v]) > 50}

        def stat(on, of=of):
            means = [np.mean([e for c, v in of.items() if (c in on) == side for _, e in v]) for side in (True, False)]
            return means[0] - means[1]

        shuffled = [stat(set(sorted(of, key=lambda c, k=k: (_draws("perm", k, c), c))[: len(high)])) for k in range(1, 201)]
        p = (1 + sum(s >= stat(high) for s in shuffled)) / 201
        assert abs(got[dataset].observed - stat(high)) < 2e-6 and abs(got[dataset].p - p) < 2e-6


def test_a_perfect_split_is_extreme_among_all_permutations(spark):
    rows = spark.createDataFrame([("x", u, float(u > 15), float(u > 15)) for u in range(20)], "g string, u long, f double, v double")
    r = resampling.permutation_p(rows, ["g"], "u", F.max("f") > 0, "v", 400, "s").first()
    assert r.observed == 1.0 and r.p <= 3 / 401  # one of 4845 splits reaches 1


def test_aliases_decide_matches(spark):
    names = spark.createDataFrame([("Acme One",), ("acme-one",), ("Beta",)], "name string")
    aliases = spark.createDataFrame([(1, "BETA (old)"), (2, "acme one"), (3, "gamma"), (4, None)], "id int, alias string")
    got = {r.id: (r.canonical, r.status) for r in contracts.alias_join(aliases, names, "alias", "name").collect()}
    assert got == {1: ("Beta", "matched"), 2: (None, "ambiguous"), 3: (None, "unknown"), 4: (None, "unknown")}
