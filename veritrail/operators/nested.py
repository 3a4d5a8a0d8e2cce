"""Calibrated upper bounds over many repeats of a split of clusters: the repeat is a dimension of one job, not a loop of jobs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.ranks import order_statistic, quantiles
from veritrail.operators.leave_out import moments, solved, summed_moments
from veritrail.operators.metrics import hash_positions
from veritrail.sources.storage import written

#: Repeats, shares of clusters for training and calibration, coverage that is aimed at, tolerance of a covered outcome.
REPEATS, TRAIN, CALIBRATION, COVERAGE, TOLERANCE = 50, 0.5, 0.25, 0.9, 1e-10


def repeated_parts(rows: DataFrame, cluster: str, repeats: int, seed: str) -> DataFrame:
    """(cluster, repeat, part): half of the clusters train, a quarter calibration, the rest evaluation, in a hash order of each repeat."""
    drawn = rows.select(cluster).filter(F.col(cluster).isNotNull()).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    drawn = drawn.withColumn("__digest", F.sha2(F.concat_ws("|", F.lit(seed), F.col("repeat").cast("string"), F.col(cluster).cast("string")), 256))
    placed = hash_positions(drawn, ["repeat"], "__digest", cluster, "__at")
    train = F.round(F.col("n") * TRAIN)
    part = F.when(F.col("__at") <= train, "train").when(F.col("__at") <= train + F.round(F.col("n") * CALIBRATION), "calibration").otherwise("evaluation")
    return placed.select(cluster, "repeat", part.alias("part"))


def nested_benchmark(rows: DataFrame, cluster: str, outcome: str, lower: str, bases: Mapping[str, Column], features: list[str], learners: Mapping[str, tuple[float, float, bool]], repeats: int = REPEATS, coverage: float = COVERAGE, seed: str = "nested") -> DataFrame:
    """(repeat, method, ...) of every base: its conformal correction, simultaneous and marginal coverage, mean and median upper bound and width.

    A base is an expression over the rows, or a learner (alpha, share of l1, non-negative) fitted on the repeat's training clusters, not
    below the lower bound. The correction is the ceil((n + 1) * coverage)-th of the calibration clusters' greatest residuals, infinite
    beyond n. Rows that lack a value are left out, and null clusters.
    """
    known = written(rows.dropna(subset=[cluster, outcome, lower, *features]).withColumns({f"__base_{k}": v.cast("double") for k, v in bases.items()}))
    parts = written(repeated_parts(known, cluster, repeats, seed))
    by_cluster = moments(known, [cluster], [F.col(f) for f in features], F.col(outcome))
    train = written(summed_moments(by_cluster.join(parts.filter("part = 'train'"), cluster), ["repeat"]))
    fits = train.select("repeat")
    for name, (alpha, l1, nonnegative) in learners.items():
        fits = fits.join(solved(train, alpha, l1, nonnegative, len(features) + 2).select("repeat", F.col("b").alias(f"__fit_{name}")), "repeat")
    rest = known.join(parts.filter("part <> 'train'"), cluster).join(written(fits), "repeat")
    x = F.array(F.lit(1.0), *(F.col(f).cast("double") for f in features))
    learnt = {k: F.greatest(F.col(lower), F.aggregate(F.zip_with(f"__fit_{k}", x, lambda b, v: b * v), F.lit(0.0), lambda s, v: s + v)) for k in learners}
    every = {k: F.col(f"__base_{k}") for k in bases} | {k: F.when(F.col(f"__fit_{k}").isNotNull(), v) for k, v in learnt.items()}
    methods = F.array(*(F.struct(F.lit(k).alias("method"), v.alias("base")) for k, v in every.items()))
    long = written(rest.select("repeat", "part", F.col(cluster).alias("__c"), F.col(outcome).alias("y"), F.col(lower).alias("low"), F.inline(methods)).filter("base is not null"))
    keys = ["repeat", "method"]
    residuals = long.filter("part = 'calibration'").groupBy(*keys, "__c").agg(F.max(F.col("y") - F.col("base")).alias("residual"))
    rank = F.ceil((F.col("n") + 1) * F.lit(coverage) - F.lit(1e-9))
    found = order_statistic(residuals, keys, "residual", F.least(F.col("n"), rank), "q")
    found = written(found.select(*keys, rank.alias("rank"), F.when(rank > F.col("n"), F.lit(float("inf"))).otherwise(F.col("q")).alias("correction"), F.col("n").alias("n_calibration")))
    judged = long.filter("part = 'evaluation'").join(found, keys).withColumn("upper", F.greatest("low", F.col("base") + F.col("correction")))
    judged = written(judged.withColumn("covered", F.col("y") <= F.col("upper") + TOLERANCE))
    by_target = judged.groupBy(*keys, "__c").agg(F.bool_and("covered").alias("all_covered"), F.count("*").alias("n"), F.count_if("covered").alias("k"), F.sum("upper").alias("u"), F.sum(F.col("upper") - F.col("low")).alias("w"))
    sums = by_target.groupBy(*keys).agg(F.count("*").alias("n_evaluation"), F.sum("n").alias("n_tasks"), F.avg(F.col("all_covered").cast("double")).alias("target_coverage"), (F.sum("k") / F.sum("n")).alias("task_coverage"), (F.sum("u") / F.sum("n")).alias("mean_upper"), (F.sum("w") / F.sum("n")).alias("mean_width"))
    medians = quantiles(judged, keys, F.col("upper"), {"median_upper": 0.5})
    return sums.join(medians, keys).join(found, keys)
