"""Pair features in odd cases, and the nested benchmark against a plain loop over its repeats."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.operators import nested, pair_features


def test_features_of_odd_vectors(spark):
    rows = [(0, [1.0, -2.0, 0.0, 3.0], [2.0, 1.0, 0.0, 3.0]), (1, [0.0] * 4, [0.0] * 4), (2, None, [1.0]), (3, [1.0, 2.0], [1.0]), (4, [], []), (5, [1.0, 1.0, 1.0], [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>")
    got = {r.i: r for r in df.select("i", pair_features.disagreement(F.col("a"), F.col("b")).alias("d"), pair_features.pair_features(F.col("a"), F.col("b")).alias("p")).collect()}
    d = got[0].d
    assert d.rmse == pytest.approx(math.sqrt(10 / 4)) and d.direction_agreement == pytest.approx(2 / 3) and d.topk_jaccard == pytest.approx(1 / 3)
    assert d.rank_spearman == pytest.approx(np.corrcoef([3, 1, 2, 4], [3, 2, 1, 4])[0, 1]) and d.cosine_distance == pytest.approx(1 - 9 / 14)
    assert d.sparsity_jaccard == pytest.approx(3 / 3 if min(2, 1) > 0.5 else 0) and d.tail_divergence == 0
    assert got[1].d.rmse == 0 and got[1].d.direction_agreement is None and got[1].d.cosine_distance is None and got[1].p.sign_agreement == 1
    assert all(x is None for i in (2, 3, 4) for x in (*got[i].d, *got[i].p))
    assert got[5].d.rank_spearman is None and got[5].d.variance_ratio is None
    ties = pair_features.average_ranks(np.array([[2.0, 1.0, 2.0, 5.0, 1.0], [3.0, 3.0, 3.0, 3.0, 3.0]]))
    assert ties.tolist() == [[3.5, 1.5, 3.5, 5.0, 1.5], [3.0] * 5]


def test_benchmark_equals_a_loop(spark):
    draw = random.Random(0)
    rows = [(f"c{k % 30}", x := draw.random(), draw.random() * 0.2, 1 + 2 * x + draw.gauss(0, 0.3)) for k in range(150)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0), ("c1", None, 1.0, 1.0)], "c string, x double, low double, y double").repartition(3)
    got = {(r["repeat"], r.method): r for r in nested.nested_benchmark(df, "c", "y", "low", {"none": F.lit(0.0), "x": F.col("x")}, ["x"], {"ridge": (0.01, 0.0, False)}, 3).collect()}
    parts = defaultdict(dict)
    for r in nested.repeated_parts(df, "c", 3, "nested").collect():
        parts[r["repeat"]][r.c] = r.part
    assert len(got) == 9 and len({tuple(sorted(p.items())) for p in parts.values()}) == 3
    for k in range(3):
        of = lambda name: [r for r in rows if parts[k][r[0]] == name]  # noqa: E731, B023
        assert [len({r[0] for r in of(p)}) for p in ("train", "calibration", "evaluation")] == [15, 8, 7]
        x, y = (np.array([r[i] for r in of("train")]) for i in (1, 3))
        slope = ((x - x.mean()) * (y - y.mean())).mean() / x.std() / (1 + 0.01) / x.std()
        bases = {"none": lambda r: 0.0, "x": lambda r: r[1], "ridge": lambda r: max(r[2], y.mean() + slope * (r[1] - x.mean()))}  # noqa: B023
        for method, base in bases.items():
            worst = defaultdict(lambda: -math.inf)
            for r in of("calibration"):
                worst[r[0]] = max(worst[r[0]], r[3] - base(r))
            rank = math.ceil((len(worst) + 1) * 0.9 - 1e-9)
            q = sorted(worst.values())[rank - 1] if rank <= len(worst) else math.inf
            upper = [(r, max(r[2], base(r) + q)) for r in of("evaluation")]
            covered = defaultdict(list)
            for r, u in upper:
                covered[r[0]].append(r[3] <= u + 1e-10)
            g = got[k, method]
            assert g.correction == pytest.approx(q) and g["rank"] == rank and g.n_calibration == 8 and g.n_evaluation == 7 and g.n_tasks == len(upper)
            assert g.target_coverage == pytest.approx(np.mean([all(v) for v in covered.values()])) and g.task_coverage == pytest.approx(np.mean([c for v in covered.values() for c in v]))
            assert g.mean_upper == pytest.approx(np.mean([u for _, u in upper])) and g.median_upper == pytest.approx(np.median([u for _, u in upper])) and g.mean_width == pytest.approx(np.mean([u - r[2] for r, u in upper]))
