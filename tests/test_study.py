"""Halvings, eligibility, associations, magnitude bins and leave-one-out fits, against values worked out apart from the SQL."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.functions.ranks import average_ranks_of
from veritrail.operators import certificates, contracts, effects, metrics, resampling, small


def test_half_masks_are_balanced_and_differ(spark):
    rows = [(s, f"u{k}") for s, n in (("a", 37), (None, 8), ("c", 1)) for k in range(n)]
    df = spark.createDataFrame(rows + rows[:20], "s string, u string")
    got = resampling.half_masks(df, ["s"], "u", 20, "x").collect()
    assert len(got) == len(rows)
    for s, n in (("a", 37), (None, 8), ("c", 1)):
        masks = [r.mask for r in got if r.s == s]
        for k in range(20):
            assert abs(2 * sum(m >> k & 1 for m in masks) - n) <= 1
    assert len({tuple(r.mask >> k & 1 for r in sorted(got, key=str)) for k in range(20)}) == 20
    again = resampling.half_masks(df.repartition(7), ["s"], "u", 20, "x").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_noise_of_halves_equals_arrays(spark):
    draw = random.Random(3)
    cells, masks = [], []
    for p, n in (("ctrl", 14), ("g1", 12), ("g2", 3)):
        for k in range(n):
            cell = f"{p}-{k}"
            masks.append(("x", p, "b", cell, draw.randrange(16)))
            cells += [("x", p, "b", cell, g, draw.random()) for g in ("A", "B", "C", "D") if draw.random() < 0.7 and not (p == "g1" and g == "D")]
    frame = spark.createDataFrame(cells, "context string, perturbation string, batch string, cell string, gene string, x double")
    halves = spark.createDataFrame(masks, "context string, perturbation string, batch string, cell string, mask long")
    got = {r.perturbation: r for r in effects.split_half_noise(frame, halves, "ctrl", 4, 3).collect()}
    mask, value = {m[3]: m[4] for m in masks}, defaultdict(lambda: np.zeros(4))
    for _, _, _, cell, gene, x in cells:
        value[cell]["ABCD".index(gene)] += x

    def mean(p, r, side):
        mine = [c for c, m in mask.items() if c.startswith(p + "-") and (m >> r & 1) == side]
        return len(mine), sum((value[c] for c in mine), np.zeros(4)) / max(1, len(mine))

    stats = []
    for r in range(4):
        (a, x), (b, y), (c, u), (d, v) = mean("g1", r, 1), mean("g1", r, 0), mean("ctrl", r, 1), mean("ctrl", r, 0)
        if min(a, b, c, d) >= 3:
            e, f = x - u, y - v
            stats.append((math.sqrt(((e - f) ** 2).mean()), 1 - np.corrcoef(e, f)[0, 1], 1 - e @ f / np.linalg.norm(e) / np.linalg.norm(f)))
    assert "g2" not in got and got["g1"].n_repeats == len(stats) > 1 and got["g1"].n_cells == 12
    rmse, pearson, cosine = map(np.array, zip(*stats))
    assert got["g1"].rmse_mean == pytest.approx(rmse.mean()) and got["g1"].rmse_sd == pytest.approx(rmse.std(ddof=1))
    assert got["g1"].pearson_error == pytest.approx(pearson.mean()) and got["g1"].cosine_error == pytest.approx(cosine.mean())


def test_reasons_of_eligibility(spark):
    rows = [("good", f"c{c}", p, 0) for c in range(3) for p in ("Ctrl ", "a", "b") for _ in range(6)]
    rows += [("few", f"c{c}", p, 0) for c in range(3) for p in ("ctrl", "a", "b") for _ in range(5)]
    rows += [("one", "c0", p, 0) for p in [*"abcdefgh", None] for _ in range(6)]
    df = spark.createDataFrame(rows, "name string, context string, perturbation string, z int").withColumn("condition", F.col("perturbation"))
    of = lambda *a, **k: {r.name: r for r in contracts.eligibility(df, ["name"], *a, **k).collect()}
    got = of("context", "perturbation")
    assert got["good"].eligible and got["good"].reasons == "" and got["good"].n_eligible_pairs == 9
    assert got["few"].reasons == "n_eligible_pairs=0<8" and got["one"].reasons == "n_contexts<2;no_control_in_perturbation_col" and got["one"].n_perturbations == 8
    assert of("perturbation", "perturbation")["good"].reasons == "context_equals_perturbation;n_eligible_pairs=3<8"
    assert of(None, "perturbation")["good"].reasons == "no_context_col>=2;n_contexts<2;n_eligible_pairs=0<8"
    assert "no_perturbation_col>=2" in of("context", None)["good"].reasons and "combinatorial" in of("condition", "perturbation")["good"].reasons
    assert of("context", "perturbation", forbidden=("context",))["good"].reasons == "unknown"
    names = spark.createDataFrame([("good",), ("absent",)], "name string")
    whole = {r.name: r.reasons for r in contracts.missing_files(names, contracts.eligibility(df, ["name"], "context", "perturbation"), "name").collect()}
    assert whole["absent"] == "file_missing" and len(whole) == 4


def ranks(v):
    s = sorted(v)
    return [s.index(x) + (s.count(x) + 1) / 2 for x in v]


def test_association_null(spark):
    draw = random.Random(5)
    risk = {f"u{k}": float(draw.randrange(6)) for k in range(30)}
    errors = [(u, m, risk[u] * (m == "m1") + draw.random() * 4) for u in risk for m in ("m1", "m2", "m3") if draw.random() < 0.9]
    r = resampling.association_null(spark.createDataFrame([*risk.items(), ("none", None)], "u string, risk double"), spark.createDataFrame(errors, "u string, m string, error double"), "u", "m", 50, "s").first()
    observed = np.median([np.corrcoef(ranks([risk[u] for u, k, _ in errors if k == m]), ranks([e for _, k, e in errors if k == m]))[0, 1] for m in ("m1", "m2", "m3")])
    assert r.observed == pytest.approx(observed) and r.n_null == 50 and 1 / 51 <= r.p <= 1
    strong = [(u, m, risk[u]) for u in risk for m in ("m1", "m2")]
    r = resampling.association_null(spark.createDataFrame(list(risk.items()), "u string, risk double"), spark.createDataFrame(strong, "u string, m string, error double"), "u", "m", 50, "s").first()
    assert r.observed == pytest.approx(1) and r.p == pytest.approx(1 / 51)


def test_bins_of_magnitude(spark):
    draw = random.Random(1)
    rows = [(k, draw.random(), draw.random(), float(k // 2)) for k in range(18)] + [(90, None, 1.0, 1.0), (91, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, risk double, error double, size double")
    got = {r.bin: r for r in metrics.within_magnitude(df, [], "risk", "error", "size", "id").collect()}
    assert [got[k].n for k in range(4)] == [5, 4, 4, 5] and got[1].rho is None and (got[0].low, got[0].high) == (0.0, 2.0)
    first = rows[:5]
    assert got[0].rho == pytest.approx(np.corrcoef(ranks([r[1] for r in first]), ranks([r[2] for r in first]))[0, 1])
    assert metrics.within_magnitude(df.limit(10), [], "risk", "error", "size", "id").count() == 0


def test_leave_one_out_fits(spark):
    y, se = np.array([0.1, 0.5, -0.2, 0.9]), np.array([0.1, 0.15, 0.2, 0.12])
    got = {r.removed: r for r in small.leave_one_out_meta(spark.createDataFrame([("abcd"[k], float(y[k]), float(se[k])) for k in range(4)], "s string, y double, se double"), "s", "y", "se").collect()}
    for k in range(4):
        z, v = np.delete(y, k), np.delete(se, k) ** 2

        def loss(t):
            w = 1 / (v + t)
            mu = (w * z).sum() / w.sum()
            return np.log(v + t).sum() + np.log(w.sum()) + (w * (z - mu) ** 2).sum()

        grid = np.linspace(0, 2, 200_001)
        tau2 = grid[np.argmin([loss(t) for t in grid[::50]]) * 50 + np.arange(-50, 51).clip(-np.argmin([loss(t) for t in grid[::50]]) * 50)]
        tau2 = min(tau2[(tau2 >= 0)], key=loss)
        w = 1 / (v + tau2)
        mu = (w * z).sum() / w.sum()
        se_mu = math.sqrt(max(1, (w * (z - mu) ** 2).sum() / 2) / w.sum())
        r = got["abcd"[k]]
        assert r.n == 3 and r.tau2 == pytest.approx(tau2, abs=2e-4) and r.estimate == pytest.approx(mu, abs=1e-3) and r.se == pytest.approx(se_mu, abs=1e-3)
        assert r.high - r.estimate == pytest.approx(4.302653 * se_mu, abs=5e-3)  # t of 0.975 with 2 degrees
    assert small.leave_one_out_meta(spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 1.0)], "s string, y double, se double"), "s", "y", "se").count() == 0


def test_registered_families(spark):
    members = spark.createDataFrame([(1, m, 0, float(m)) for m in (1, 2, 3, 4)], "task long, member int, position int, prediction double")
    rows = certificates.registered_families(members, F.when(F.col("member") <= 2, 1).otherwise(2)).collect()
    of = lambda f: sorted((r.member, r.prediction) for r in rows if r.family == f)
    assert of("architecture_pair") == [(1, 1.5), (2, 3.5)] and len(of("all_seeds")) == 4 and of("no_change_control") == [(0, 0.0), (1, 1.5), (2, 3.5)]


def test_ranks_of_many_columns_read_their_input_once_a_column(spark, tmp_path):
    spark.createDataFrame([(k % 3, float(k % 7), float(k % 5), k, -k * k % 11) for k in range(200)], "g int, a double, b double, c long, d long").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    ranked = average_ranks_of(df, ["g"], {"a": "ra", "b": "rb", "c": "rc"})
    assert ranked._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 4  # the table, and a table of ranks for each column
    rows = ranked.filter("g = 0").collect()
    assert [r.ra for r in rows] == ranks([r.a for r in rows]) and [r.rc for r in rows] == ranks([r.c for r in rows])
    partial = metrics.partial_spearman_two(df, ["g"], "a", "b", "c", "d")
    assert partial._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 5
