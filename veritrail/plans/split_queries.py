"""Held-out pairs and packed contexts, leave-out rankers and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions.scalars import fold
from veritrail.operators import leave_out, splits
from veritrail.plans.registry import query
from veritrail.sources import views
from veritrail.sources.views import CELLS


def pairs(spark, sf_dir):
    """Observed pairs of context and perturbation of each batch, as tasks."""
    rows = views.cells(spark, sf_dir).select("batch", "context", "perturbation").distinct()
    return rows.withColumn("task", F.concat_ws("|", "batch", "context", "perturbation"))


@query("held_out_pairs")
def held_out_pairs(spark, sf_dir):
    return splits.held_out_splits(pairs(spark, sf_dir), "batch", "task", "context", "perturbation")


@query(
    "context_packing",
    f"""WITH RECURSIVE {CELLS}, k AS (SELECT perturbation, count(DISTINCT context || '|' || batch) AS n_tasks FROM cells GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY n_tasks DESC, perturbation) AS i FROM k),
    p AS (SELECT 0 AS i, -1 AS fold, [0, 0, 0, 0]::BIGINT[] AS loads
        UNION ALL SELECT o.i, list_position(loads, list_min(loads)) - 1, [CASE WHEN j = list_position(loads, list_min(loads)) THEN loads[j] + n_tasks ELSE loads[j] END for j in range(1, 5)] FROM p JOIN o ON o.i = p.i + 1)
    SELECT perturbation, n_tasks, CAST(fold AS INTEGER) AS fold FROM o JOIN p USING (i)""",
)
def context_packing(spark, sf_dir):
    """Perturbations as contexts of one set, packed into four folds by their tasks."""
    rows = pairs(spark, sf_dir).withColumn("set", F.lit("all"))
    return splits.packed_contexts(rows, "set", "task", "perturbation", 4).select("perturbation", "n_tasks", "fold")


FEATURES = ["mean_risk", "spread", "log_support", "low_risk"]


def records(spark, sf_dir):
    """Records of kinds of events as data sets and of three predictors, a user each: features of the risks, mean error, split and fold by the user's hash."""
    ev = views.scored_events(spark, sf_dir).withColumn("predictor", F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")))
    rows = ev.groupBy("dataset", "predictor", "cluster").agg(F.avg("risk").alias("mean_risk"), F.stddev_pop("risk").alias("spread"), F.log1p(F.count("*").cast("double")).alias("log_support"), F.min("risk").alias("low_risk"), F.avg("error").alias("error"))
    user = F.sha2(F.col("cluster").cast("string"), 256)
    return views.splits(rows, "cluster").withColumn("fold", fold(F.reverse(user), 3))


@query("lodo_linear_ranker")
def lodo_linear_ranker(spark, sf_dir):
    """Errors of test records from an elastic net that has not seen their data set, one for each predictor."""
    rows = records(spark, sf_dir)
    fits = leave_out.lodo_fits(rows.filter("split <> 'test'"), "dataset", ["predictor"], FEATURES, "error", alpha=0.01, l1=0.2)
    return leave_out.scored(rows.filter("split = 'test'"), fits, ["dataset", "predictor"], FEATURES, "risk").select("dataset", "predictor", "cluster", "risk", "error")


@query("rank_target_ranker")
def rank_target_ranker(spark, sf_dir):
    """The same with the error's rank within data set, fold and predictor as the target, ranked on training records alone."""
    rows = records(spark, sf_dir)
    train = leave_out.rank_target(rows.filter("split <> 'test'"), ["dataset", "fold", "predictor"], "error", "target")
    fits = leave_out.lodo_fits(train, "dataset", [], FEATURES, "target", alpha=0.01, l1=0.0, least=24)
    return leave_out.scored(rows.filter("split = 'test'"), fits, ["dataset"], FEATURES, "risk").select("dataset", "predictor", "cluster", "risk")


@query("third_predictor_scores")
def third_predictor_scores(spark, sf_dir):
    """Test records of one predictor, scored by fits on the others: on all data sets, and without the record's own."""
    rows = records(spark, sf_dir)
    train = leave_out.rank_target(rows.filter("split <> 'test'"), ["dataset", "fold", "predictor"], "error", "target")
    fits = leave_out.crossed_fits(train, "dataset", "predictor", FEATURES, "target", alpha=0.01, l1=0.0)
    test = rows.filter("split = 'test'")
    out = leave_out.scored(test, fits["lopo"], ["predictor"], FEATURES, "lopo").select("dataset", "predictor", "cluster", "lopo")
    both = leave_out.scored(test, fits["lodo_lopo"], ["dataset", "predictor"], FEATURES, "lodo_lopo").select("dataset", "predictor", "cluster", "lodo_lopo")
    return out.join(both, ["dataset", "predictor", "cluster"])


@query("spline_crossfit")
def spline_crossfit(spark, sf_dir):
    """Expected error from a cubic spline of the mean risk with four degrees of freedom, for every record by the fits on the other folds."""
    rows = records(spark, sf_dir).dropna(subset=["mean_risk", "error"])
    return leave_out.spline_crossfitted(rows, "fold", "mean_risk", "error", "expected").select("dataset", "predictor", "cluster", "fold", "expected")
