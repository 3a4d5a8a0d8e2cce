"""Source effects, nested medians, novelty and the pair's ladder by hand."""

import pytest
from pyspark.sql import functions as F

from veritrail.operators import evidence


def test_sources_are_weighted_by_cells_and_lack_genes_as_zeros(spark):
    rows = [("a", "p", "g", 1.0, 10), ("b", "p", "g", 4.0, 30), ("b", "p", "h", 2.0, 30), ("c", "p", "g", 7.0, 60), ("a", "only", "g", 5.0, 3)]
    got = {(r.context, r.gene): r for r in evidence.weighted_source_deltas(spark.createDataFrame(rows, "context string, perturbation string, gene string, effect double, n_cells long")).collect()}
    assert set(got) == {(c, g) for c in "abc" for g in "gh"}
    assert got["a", "g"].delta == pytest.approx((4 * 30 + 7 * 60) / 90) and got["a", "h"].delta == pytest.approx(2 * 30 / 90)
    assert got["b", "h"].delta == 0 and (got["b", "h"].n_source_contexts, got["b", "h"].n_source_cells) == (2, 70)


def test_medians_within_medians(spark):
    rows = [("k", f, c, x) for f, c, xs in ((0, 0, [1, 2, 30]), (0, 1, [4]), (1, 0, [10, 20]), (2, 0, [None])) for x in map(lambda v: None if v is None else float(v), xs)]
    df = spark.createDataFrame(rows, "k string, f int, c int, x double")
    assert evidence.nested_medians(df, ["f", "c"], ["k"], "x", "m").first().m == pytest.approx((3.0 + 15.0) / 2)
    assert evidence.nested_medians(df, [], ["k"], "x", "m").first().m == pytest.approx(7.0)


def test_novelty_and_support(spark):
    rows = [(0, "train", "a", "p"), (0, "train", "b", "p"), (0, "test", "c", "p"), (0, "test", "a", "q"), (1, "test", "a", "p")]
    df = spark.createDataFrame(rows, "fold int, split string, context string, perturbation string")
    controls = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 1.0])], "context string, v array<double>")
    got = {(r.fold, r.context, r.perturbation): r for r in evidence.structural_features(df, controls).collect()}
    near = 1 - 2**-0.5  # of a and b, and of b and c: the median of the three distances
    assert got[0, "a", "q"].context_novelty == 0 and got[0, "c", "p"].context_novelty == pytest.approx(near / near)
    assert got[0, "c", "p"].support == 2 and got[0, "c", "p"].perturbation_novelty == pytest.approx(1 / 3) and got[0, "a", "q"].perturbation_novelty == 1
    assert got[1, "a", "p"].context_novelty is None and got[1, "a", "p"].support == 0
    alone = evidence.structural_features(df, controls.filter("context = 'a'")).collect()
    assert len(alone) == len(rows)


def test_concordance_of_ties(spark):
    rows = [("s", k // 2, float(k), float(k if k < 5 else 9 - k)) for k in range(10)] + [("s", 9, None, 1.0)]
    r = evidence.concordance(spark.createDataFrame(rows, "s string, c int, a double, b double"), ["s"], "a", "b", "c").first()
    assert (r.n_tasks, r.n_clusters) == (10, 5) and r.ties == 0.5 and r.second_lower == 0.5 and r.first_lower == 0
    assert r.both_high + r.both_low + r.discordant == pytest.approx(1) and r.median_abs_gap == pytest.approx(0.5)


def test_ladder_of_pairs(spark):
    df = spark.createDataFrame([(3.0, 4.0, 2.0), (0.0, 0.0, 0.0), (1.0, 1.0, 4.0)], "a double, b double, d double")
    first, zero, broken = df.select(*(c.alias(k) for k, c in evidence.pair_ladder(F.col("a"), F.col("b"), F.col("d")).items())).collect()
    assert first.family_rms == pytest.approx(12.5**0.5) and first.centroid_error == pytest.approx(11.5**0.5) and first.worst_tightness == 0.25 and not first.rms_violation
    assert zero.rms_tightness == 0 and broken.rms_violation and broken.worst_violation and broken.centroid_error == 0
