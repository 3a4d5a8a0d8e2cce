"""Evidence about tasks from other contexts and models: weighted source effects, nested medians, concordance, novelty and support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import vectors as vec
from veritrail.functions.ranks import quantiles
from veritrail.operators.metrics import spearman
from veritrail.sources.storage import written

#: Tolerance of a violated bound, least distance that counts for the scale, greatest scaled novelty.
TOLERANCE, LEAST_DISTANCE, MOST_NOVELTY = 1e-10, 1e-10, 5.0


def weighted_source_deltas(effects: DataFrame) -> DataFrame:
    """(context, perturbation, gene, delta, n_source_contexts, n_source_cells): the effect in all other contexts, weighted by their cells.

    effects is (context, perturbation, gene, effect, n_cells); a gene that a source lacks has effect zero there. Pairs without another
    context have no row. Everything is the perturbation's sums less the own context's.
    """
    effects = written(effects.select("context", "perturbation", "gene", "effect", "n_cells"))
    sizes = effects.select("context", "perturbation", "n_cells").distinct()
    whole = sizes.groupBy("perturbation").agg(F.sum("n_cells").alias("__w"), F.count("*").alias("__k"))
    sums = effects.groupBy("perturbation", "gene").agg(F.sum(F.col("effect") * F.col("n_cells")).alias("__s"))
    targets = sizes.join(whole, "perturbation").filter("__k > 1").join(sums, "perturbation")
    own = effects.select("context", "perturbation", "gene", "effect")
    rows = targets.join(own, ["context", "perturbation", "gene"], "left")
    cells = F.col("__w") - F.col("n_cells")
    delta = (F.col("__s") - F.col("n_cells") * F.coalesce("effect", F.lit(0.0))) / cells
    return rows.select("context", "perturbation", "gene", delta.alias("delta"), (F.col("__k") - 1).alias("n_source_contexts"), cells.alias("n_source_cells"))


def nested_medians(rows: DataFrame, levels: list[str], keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): the median over the last level's groups of the medians within them, and so on outwards; levels stand from the outermost to the innermost."""
    medians = rows.select(*keys, *levels, F.col(value).cast("double").alias("__v"))
    for k in range(len(levels), -1, -1):
        medians = quantiles(medians, [*keys, *levels[:k]], F.col("__v"), {"__m": 0.5}).withColumnRenamed("__m", "__v")
    return medians.withColumnRenamed("__v", out)


def concordance(rows: DataFrame, group: list[str], a: str, b: str, cluster: str) -> DataFrame:
    """One row for each group: how far two models' errors agree, over tasks and over clusters' means; rows that lack an error are left out."""
    known = written(rows.dropna(subset=[a, b]))
    marks = quantiles(known, group, F.col(a), {"__ma": 0.5, "__ta": 0.8}).join(quantiles(known, group, F.col(b), {"__mb": 0.5, "__tb": 0.8}), group)
    gaps = quantiles(known, group, F.abs(F.col(a) - F.col(b)), {"median_abs_gap": 0.5})
    x, y = F.col(a), F.col(b)
    high_a, high_b, top_a, top_b = x >= F.col("__ma"), y >= F.col("__mb"), x >= F.col("__ta"), y >= F.col("__tb")
    share = lambda on: F.avg(on.cast("double"))
    found = known.join(marks, group).groupBy(*group).agg(
        F.count("*").alias("n_tasks"),
        F.count_distinct(cluster).alias("n_clusters"),
        share(high_a & high_b).alias("both_high"),
        share(~high_a & ~high_b).alias("both_low"),
        share(high_a != high_b).alias("discordant"),
        share(top_a & top_b).alias("top20_overlap"),
        F.try_divide(F.count_if(top_a & top_b), F.count_if(top_a | top_b)).alias("top20_jaccard"),
        share(x < y).alias("first_lower"),
        share(y < x).alias("second_lower"),
        share(x == y).alias("ties"),
    )
    means = known.groupBy(*group, cluster).agg(F.avg(a).alias("a"), F.avg(b).alias("b"))
    rho = spearman(known, group, a, b).select(*group, F.col("rho").alias("task_rho"))
    by_cluster = spearman(means, group, "a", "b").select(*group, F.col("rho").alias("cluster_rho"))
    return found.join(gaps, group).join(rho, group).join(by_cluster, group)


def structural_features(rows: DataFrame, controls: DataFrame) -> DataFrame:
    """rows (fold, split, context, perturbation, ...) with context_novelty, support and perturbation_novelty.

    controls is (context, v), a vector for each context, of which there are few. Novelty is zero for contexts the fold trains on; else the
    distance to the nearest of those, in units of the median distance of contexts, five at most, and null without any. Support counts
    the fold's training rows of the perturbation.
    """
    controls = written(controls.select("context", "v"))
    other = controls.select(F.col("context").alias("__c"), F.col("v").alias("__v")).withColumn("__all", F.lit(0))
    pairs = written(controls.withColumn("__all", F.lit(0)).join(other, "__all").filter(F.col("context") != F.col("__c")).select("context", "__c", vec.cosine(F.col("v"), F.col("__v")).alias("__s")))
    distance = 1 - F.col("__s")
    scale = quantiles(pairs.filter((F.col("context") < F.col("__c")) & (distance > LEAST_DISTANCE)).withColumn("__all", F.lit(0)), ["__all"], distance, {"__scale": 0.5}).select(F.greatest("__scale", F.lit(1e-8)).alias("__scale"))
    train = rows.filter("split = 'train'")
    known = written(train.select("fold", "context").distinct())
    nearest = pairs.join(known.select("fold", F.col("context").alias("__c")), "__c").groupBy("fold", "context").agg(F.max("__s").alias("__near"))
    support = train.groupBy("fold", "perturbation").agg(F.count("*").alias("support"))
    out = rows.join(known.withColumn("__known", F.lit(True)), ["fold", "context"], "left").join(nearest, ["fold", "context"], "left").join(support, ["fold", "perturbation"], "left")
    whole = F.broadcast(scale)  # one row, or none for a single context
    out = out.join(whole, F.lit(True), "left")
    novelty = F.when(F.col("__known"), 0.0).when(F.col("__near").isNotNull(), F.least((1 - F.col("__near")) / F.col("__scale"), F.lit(MOST_NOVELTY)))
    count = F.coalesce("support", F.lit(0))
    return out.select(*rows.columns, novelty.alias("context_novelty"), count.alias("support"), (1.0 / (1.0 + count)).alias("perturbation_novelty"))


def pair_ladder(error_a: Column, error_b: Column, distance: Column) -> dict[str, Column]:
    """The certificate of a pair of models from their errors and their distance alone."""
    lower = distance / 2
    rms, worst = F.sqrt((error_a * error_a + error_b * error_b) / 2), F.greatest(error_a, error_b)
    tight = lambda of: F.when(of > 0, lower / of).otherwise(0.0)
    return {
        "lower": lower,
        "family_rms": rms,
        "family_worst": worst,
        "centroid_error": F.sqrt(F.greatest(rms * rms - lower * lower, F.lit(0.0))),
        "rms_tightness": tight(rms),
        "worst_tightness": tight(worst),
        "rms_violation": lower > rms + TOLERANCE,
        "worst_violation": lower > worst + TOLERANCE,
    }
