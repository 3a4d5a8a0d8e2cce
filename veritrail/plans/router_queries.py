"""Routers that score data sets they have not seen, and the worth of rankings by risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions import vectors as vec
from veritrail.functions.ranks import average_ranks_of
from veritrail.functions.scalars import fold
from veritrail.operators import routers
from veritrail.plans.certificate_queries import rounded, rounded_sql
from veritrail.plans.metric_queries import corr_sql, rank_sql
from veritrail.plans.registry import query
from veritrail.sources import views
from veritrail.sources.storage import written
from veritrail.sources.views import VECTORS


def predicted_tasks(spark, sf_dir):
    """(task, study, fold, error, disagreement, magnitude_a, magnitude_b, relative, gap) of the first two members' predictions; five studies, three folds each."""
    v = views.vectors(spark, sf_dir)
    of = lambda m, name: v.filter(F.col("member") == m).select("task", F.col("v").alias(name))
    t, x, y = F.col("t"), F.col("x"), F.col("y")
    size = lambda c: vec.norm(c) / F.sqrt(F.size(c))
    rows = of(0, "t").join(of(1, "x"), "task").join(of(2, "y"), "task")
    rows = rows.select("task", (F.col("task") % 5).alias("study"), fold(F.sha2(F.col("task").cast("string"), 256), 3).alias("fold"), vec.rmse(x, t).alias("error"), vec.rmse(x, y).alias("disagreement"), size(x).alias("magnitude_a"), size(y).alias("magnitude_b"))
    a, b = F.col("magnitude_a"), F.col("magnitude_b")
    relative = F.col("disagreement") / (F.sqrt(F.greatest(a, F.lit(1e-12)) * F.greatest(b, F.lit(1e-12))) + 1e-12)
    return written(rows.withColumns({"relative": relative, "gap": F.abs(a - b)}))


def shares(rows, group, names):
    """rows with each named column's average rank as a share of its group."""
    ranked = average_ranks_of(rows, group, {c: f"r_{c}" for c in names}, "n")
    return ranked.withColumns({f"r_{c}": F.col(f"r_{c}") / F.col("n") for c in names}).drop("n")


_SIZE = "sqrt(list_sum([{0}[i] ** 2 for i in range(1, 65)]) / 64)"
_APART = "sqrt(list_sum([({0}[i] - {1}[i]) ** 2 for i in range(1, 65)]) / 64)"
_TASKS = f"""{VECTORS}, tk AS (SELECT t.task, t.task % 5 AS study, {_APART.format('x.v', 't.v')} AS error, {_APART.format('x.v', 'y.v')} AS disagreement, {_SIZE.format('x.v')} AS magnitude_a
    FROM vec t JOIN vec x ON x.task = t.task AND x.member = 1 JOIN vec y ON y.task = t.task AND y.member = 2 WHERE t.member = 0)"""
_WORTH = ("normalized_aurc", "enrichment", "reduction", "capture", "rho")
_KEPT = " + ".join(f"{0.5 if k in (10, 20) else 1.0} * avg(error) FILTER (place <= greatest(1, ceil({k} * n / 20.0)))" for k in range(10, 21))


@query(
    "triage_worth",
    f"""WITH {_TASKS}, s AS (SELECT task, study, error, 'disagreement' AS score, disagreement AS risk FROM tk UNION ALL SELECT task, study, error, 'magnitude_a', magnitude_a FROM tk),
    o AS (SELECT *, row_number() OVER (PARTITION BY study, score ORDER BY risk, task) AS place, count(*) OVER (PARTITION BY study, score) AS n, {rank_sql('risk', 'study, score')} AS x, {rank_sql('error', 'study, score')} AS y FROM s),
    h AS (SELECT *, place > n - greatest(1, ceil(n / 5.0)) AS high FROM o),
    f AS (SELECT study, score, count(*) AS n, ({_KEPT}) * 0.05 / 0.5 / avg(error) AS normalized_aurc, avg(error) FILTER (high) / avg(error) AS enrichment, (avg(error) - avg(error) FILTER (NOT high)) / avg(error) AS reduction, sum(error) FILTER (high) / sum(error) AS capture, coalesce({corr_sql('x', 'y')}, 0.0) AS rho FROM h GROUP BY study, score)
    SELECT study, score, n, {rounded_sql(*_WORTH)} FROM f""",
)
def triage_worth(spark, sf_dir):
    """What rejecting by disagreement and by magnitude is worth in every study."""
    one = lambda name: F.struct(F.lit(name).alias("score"), F.col(name).alias("risk"))
    long = predicted_tasks(spark, sf_dir).select("task", "study", "error", F.inline(F.array(one("disagreement"), one("magnitude_a"))))
    return routers.triage(long, ["study", "score"], "risk", "error", "task").select("study", "score", "n", *rounded(*_WORTH))


META = ["disagreement", "magnitude_a", "relative"]


@query("meta_router_lodo")
def meta_router_lodo(spark, sf_dir):
    """Every task's risk by the router that was fitted on the other studies' shares of ranks within folds."""
    rows = shares(predicted_tasks(spark, sf_dir), ["study", "fold"], [*META, "error"])
    found, _ = routers.meta_router(rows, "study", "fold", [f"r_{c}" for c in META], "r_error", "risk")
    return found.select("task", "study", "fold", F.round("risk", 6).alias("risk"), F.round("error", 6).alias("error"))


BASE, EXTRA = ["magnitude_a", "magnitude_b"], ["disagreement", "relative", "gap"]


@query("residual_risk")
def residual_risk(spark, sf_dir):
    """Every task's risk from magnitudes and from what disagreement adds, both fitted on the other studies."""
    rows = shares(predicted_tasks(spark, sf_dir), ["study"], [*BASE, *EXTRA, "error"])
    found, _ = routers.residual_risk(rows, "study", [f"r_{c}" for c in BASE], [f"r_{c}" for c in EXTRA], "r_error")
    return found.select("task", "study", *rounded("base_risk", "risk", "error"))
