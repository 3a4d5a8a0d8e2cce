"""Cluster bootstraps of rank correlations, their gains, selective risk, utility and medians, in folds and over data sets.

Draws are made by a generator SQL does not have; tests hold the operators against plain Python on the same draws.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions.scalars import fold, settled
from veritrail.operators import weighted
from veritrail.plans.registry import query
from veritrail.sources import views


def tasks(spark, sf_dir):
    """A task for each kind of event and user: mean risk, a second score, mean error, a study of several kinds, and a fold by the user's hash."""
    ev = views.scored_events(spark, sf_dir)
    rows = ev.groupBy("dataset", "cluster").agg(settled(F.avg("risk")).alias("risk"), F.count("*").cast("double").alias("support"), settled(F.avg("error")).alias("error"))
    user = F.col("cluster").cast("string")
    study = F.when(F.length("dataset") % 2 == 0, "even").otherwise("odd")
    return rows.withColumns({"study": study, "fold": fold(F.sha2(user, 256), 3), "id": F.concat_ws("|", "dataset", user)})


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("estimate", "low", "high")})


@query("bootstrap_spearman_gain")
def bootstrap_spearman_gain(spark, sf_dir):
    """Per study, rank correlations of two scores with the error, and the first one's gain on the same 1,000 draws of users."""
    return _rounded(weighted.bootstrap_spearman(tasks(spark, sf_dir), ["study"], "cluster", ["risk", "support"], "error"))


@query("bootstrap_aurc")
def bootstrap_aurc(spark, sf_dir):
    return _rounded(weighted.bootstrap_aurc(tasks(spark, sf_dir), ["study"], "cluster", "risk", "error", "id"))


@query("bootstrap_utility")
def bootstrap_utility(spark, sf_dir):
    return _rounded(weighted.bootstrap_utility(tasks(spark, sf_dir), ["study"], "cluster", "risk", "error", "id", [0.05, 0.1, 0.2]))


@query("bootstrap_median")
def bootstrap_median(spark, sf_dir):
    return _rounded(weighted.bootstrap_median(tasks(spark, sf_dir), ["dataset"], "cluster", "error", "id"))


@query("bootstrap_folds")
def bootstrap_folds(spark, sf_dir):
    """Per study, correlations within folds, averaged; a draw of users is one for all folds."""
    return _rounded(weighted.bootstrap_folds(tasks(spark, sf_dir), "study", "fold", "cluster", ["risk", "support"], "error"))


@query("bootstrap_hierarchical")
def bootstrap_hierarchical(spark, sf_dir):
    """Kinds of events drawn with replacement, users anew in each, correlations averaged over folds and kinds."""
    return _rounded(weighted.bootstrap_hierarchical(tasks(spark, sf_dir), "dataset", "fold", "cluster", ["risk", "support"], "error"))
