"""Operators on small inputs with known results: ties, constants, nulls, degenerate groups."""

import math

import numpy as np
from pyspark.sql import functions as F

from veritrail.functions import ranks, scalars, vectors
from veritrail.operators import certificates, effects, metrics, resampling, scaling


def test_average_ranks_and_prefix_sums(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 5.0), ("b", None), ("b", 3.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = sorted((str(r.g), r.x, r.rank, r.n) for r in ranks.average_ranks(df, ["g"], "x", "rank", "n").collect())
    assert got == [("None", 1.0, 1.0, 1), ("a", 1.0, 1.0, 4), ("a", 2.0, 2.5, 4), ("a", 2.0, 2.5, 4), ("a", 5.0, 4.0, 4), ("b", 3.0, 1.0, 1)]
    many = spark.range(5000).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % 5000).alias("v"), F.col("id"))
    sums = ranks.running(many, ["g"], "v", {"v": F.col("v")}, ["id"])
    assert sums.filter("before_v <> v * (v - 1) / 2 or total_v <> 4999 * 2500").count() == 0


def test_spearman_of_ties_and_constants(spark):
    df = spark.createDataFrame([("t", 1.0, 2.0), ("t", 1.0, 1.0), ("t", 3.0, 5.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0), ("c", 1.0, 4.0), ("s", 1.0, 1.0)], "g string, x double, y double")
    got = {r.g: (r.n, r.rho) for r in metrics.spearman(df, ["g"], "x", "y").collect()}
    assert got["c"] == (3, None) and got["s"] == (1, None) and abs(got["t"][1] - 0.8660254) < 1e-6


def test_perfect_ranking_has_no_excess_and_reversed_is_worse_than_random(spark):
    errors = [0.1, 0.2, 0.3, 0.4, 0.5]
    df = spark.createDataFrame([("good", k, e, e) for k, e in enumerate(errors)] + [("bad", k, -e, e) for k, e in enumerate(errors)], "g string, id int, risk double, error double")
    got = {r.g: r for r in metrics.selective_summary(df, ["g"], "risk", "error", "id").collect()}
    assert abs(got["good"].excess_aurc) < 1e-12 and got["bad"].aurc > got["bad"].random_aurc and abs(got["good"].gap_captured_pct - 100) < 1e-9


def test_adjustments(spark):
    df = spark.createDataFrame([("f", k, p) for k, p in enumerate([0.01, 0.04, 0.03, 0.20])], "f string, k int, p double")
    bh = [r.p_bh for r in metrics.adjusted(df, ["f"], "p", "k", "bh").orderBy("p").collect()]
    assert [round(x, 10) for x in bh] == [0.04, 0.0533333333, 0.0533333333, 0.2]
    holm = [r.p_holm for r in metrics.adjusted(df, ["f"], "p", "k", "holm").orderBy("p").collect()]
    assert [round(x, 10) for x in holm] == [0.04, 0.09, 0.09, 0.2]


def test_conformal_ranks(spark):
    df = spark.createDataFrame([("g", float(k)) for k in range(1, 20)] + [("h", 1.0), ("h", 2.0)], "g string, v double")
    clip = {r.g: (r.conformal_rank, r.q) for r in certificates.conformal_quantile(df, ["g"], "v", 0.9, "q").collect()}
    assert clip == {"g": (18, 18.0), "h": (2, 2.0)}
    assert {r.g: r.q for r in certificates.conformal_quantile(df, ["g"], "v", 0.9, "q", "inf").collect()} == {"g": 18.0, "h": math.inf}


def test_family_identity(spark):
    members = spark.range(7 * 30).select((F.col("id") % 7).alias("member"), F.floor(F.col("id") / 7).alias("position"), F.lit(1).alias("task"), F.randn(3).alias("prediction"))
    truth = spark.range(30).select(F.lit(1).alias("task"), F.col("id").alias("position"), F.randn(4).alias("truth"))
    row = certificates.family_certificate(members, truth, ["task"]).first()
    assert row.n_members == 7 and row.identity_residual < 1e-12 and not row.family_violation and not row.worst_violation
    flat = members.withColumn("prediction", F.lit(0.5))
    assert certificates.family_certificate(flat, truth, ["task"]).first().diversity_lower == 0


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, -3.0, 2.0, 0.0], [1.0, 3.0, 2.0, 0.0], [0.0] * 4)], "a array<double>, b array<double>, z array<double>")
    a, b, z = (F.col(c) for c in "abz")
    row = df.select(vectors.rmse(a, b).alias("rmse"), vectors.cosine(a, z).alias("none"), vectors.sign_agreement(a, b).alias("sign"), vectors.top_k(a, 2).alias("top"), vectors.top_k_overlap(a, b, 2).alias("over"), vectors.jaccard(F.array(), F.array()).alias("j"), vectors.pearson(a, z).alias("p"), vectors.unit(z).alias("u")).first()
    assert (row.rmse, row.none, row.sign, row.top, row.over, row.j, row.p, row.u) == (3.0, None, 0.5, [1, 2], 1.0, 1.0, None, None)


def test_scales_and_their_fallbacks(spark):
    rows = [("a", float(k), True) for k in range(5)] + [("a", None, False), ("c", 2.0, True), ("c", 2.0, True), ("e", 1.0, False)]
    df = spark.createDataFrame(rows, "g string, x double, ref boolean")
    z = scaling.robust_z(df, ["g"], "x", F.col("ref"), "z").collect()
    assert sorted(r.z for r in z if r.g == "a") == [-1.0, -0.5, 0.0, 0.0, 0.5, 1.0] and {r.z for r in z if r.g == "c"} == {0.0}
    q = scaling.empirical_quantile(df, ["g"], "x", F.col("ref"), "q").collect()
    assert sorted(r.q for r in q if r.g == "a") == [0.1, 0.3, 0.5, 0.5, 0.7, 0.9] and [r.q for r in q if r.g == "e"] == [0.5]


def test_labels_and_gate(spark):
    df = spark.createDataFrame([(x,) for x in (" Ctrl-7", "control", "GENE", None, "nan")], "l string")
    assert [r.c for r in df.select(scalars.is_control(F.col("l")).alias("c")).collect()] == [True, True, False, True, True]
    gate = spark.createDataFrame([(0.2, 0.01, 0.6), (0.2, -0.01, 0.8), (0.2, 0.01, 0.5), (0.0, -0.1, 0.8), (None, None, 1.0)], "e double, l double, s double")
    assert [r.g for r in gate.select(scalars.decision(F.col("e"), F.col("l"), F.col("s")).alias("g")).collect()] == ["PASS", "PARTIAL", "PARTIAL", "FAIL", "FAIL"]


def test_effects_count_absent_genes_as_zero(spark):
    cells = spark.createDataFrame([("1", "x", "ctl", "g1", 4.0), ("2", "x", "ctl", "g2", 2.0), ("3", "x", "p", "g1", 6.0), ("4", "y", "p", "g1", 1.0)], "cell string, context string, perturbation string, gene string, x double")
    got = {(r.context, r.gene): r.effect for r in effects.control_effects(cells, "ctl", ["context"]).collect()}
    assert got == {("x", "g1"): 4.0, ("x", "g2"): -1.0}


def test_draws_repeat(spark):
    df = spark.range(60).select((F.col("id") % 6).alias("c"), F.col("id").cast("double").alias("v"), F.lit("g").alias("g"))
    a, b = (resampling.bootstrap_mean(df.repartition(n), ["g"], "c", "v", 40, "s").first() for n in (1, 5))
    assert a == b and a.low <= a.estimate <= a.high
    times = resampling.multiplicities(df, ["g"], "c", 5, "s").groupBy("replicate").agg(F.sum("times").alias("t"))
    assert {r.t for r in times.collect()} == {6}


def test_hot_values_share_out_and_quantiles_are_exact(spark):
    draw = np.random.default_rng(3)
    values = [7.0 if draw.random() < 0.9 else float(draw.integers(0, 50)) for _ in range(4000)]
    rows = spark.createDataFrame([("g", k, v) for k, v in enumerate(values)] + [("none", -1, None)], "g string, k long, v double")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for keys in (["g", "v", "k"], ["g", "v"], ["g"]):  # a value in nine of ten rows, with a tie that tells rows apart, and without
        assert ranks.in_runs(rows.filter("v is not null"), keys).groupBy("__run").count().agg(F.max("count")).first()[0] < 4000 / 20
    for c, v in before.items():
        spark.conf.set(c, v)
    got = {r.k: r.before_one for r in ranks.running(rows.filter("v is not null"), ["g"], "v", {"one": F.lit(1)}, ["k"]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(4000), key=lambda k: (values[k], k))
    shares = {"a": 0.0, "b": 0.03, "c": 0.5, "d": 0.987, "e": 1.0}
    found = {r.g: r for r in ranks.quantiles(rows, ["g"], F.col("v"), shares).collect()}
    assert all(abs(found["g"][k] - np.quantile(values, s)) < 1e-9 for k, s in shares.items()) and found["none"].a is None


def test_required_columns_and_labels(spark):
    import pytest

    from veritrail.operators import contracts

    df = spark.createDataFrame([("a", "test"), ("b", "train")], "k string, split string")
    assert [r.k for r in contracts.test_rows(df, ["k"]).collect()] == ["a"]
    with pytest.raises(ValueError, match="error"):
        contracts.test_rows(df, ["k", "error"])
    labels = spark.createDataFrame([("K562_b+A_1+1",), ("K562_ctrl_1+1",), ("K562_x_ctrl_1+1",)], "l string")
    got = labels.select(scalars.canonical_condition(scalars.condition_genes(scalars.label_between(F.col("l"), "K562_", "_1+1"))).alias("c")).collect()
    assert [r.c for r in got] == ["A+B", "ctrl", "X+ctrl"]


def test_partial_spearman_of_two_covariates_is_that_of_residuals(spark):
    draw = np.random.default_rng(8)
    c, d = draw.normal(size=(2, 60))
    x, y = c + 0.5 * d + draw.normal(size=60), c - d + draw.normal(size=60)
    df = spark.createDataFrame([("g", *map(float, v)) for v in zip(x, y, c, d, strict=True)], "g string, x double, y double, c double, d double")
    rank = lambda v: np.argsort(np.argsort(v)).astype(float)
    base = np.stack([np.ones(60), rank(c), rank(d)], 1)
    rest = [rank(v) - base @ np.linalg.lstsq(base, rank(v), rcond=None)[0] for v in (x, y)]
    assert abs(metrics.partial_spearman_two(df, ["g"], "x", "y", "c", "d").first().rho - np.corrcoef(*rest)[0, 1]) < 1e-9
