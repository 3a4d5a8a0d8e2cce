"""Pair features of vectors and the nested benchmark of calibrated bounds on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions import vectors as vec
from veritrail.operators import nested, pair_features
from veritrail.plans.certificate_queries import rounded, rounded_sql
from veritrail.plans.metric_queries import corr_sql, rank_sql
from veritrail.plans.registry import query
from veritrail.sources import views
from veritrail.sources.views import VECTORS


def pairs(spark, sf_dir):
    """(task, a, b, truth) of the first two members' vectors."""
    v = views.vectors(spark, sf_dir)
    of = lambda m, name: v.filter(F.col("member") == m).select("task", F.col("v").alias(name))
    return of(0, "truth").join(of(1, "a"), "task").join(of(2, "b"), "task")


_PAIRS = f"{VECTORS}, p AS (SELECT x.task, i, x.v[i] AS a, y.v[i] AS b FROM vec x JOIN vec y ON x.task = y.task AND x.member = 1 AND y.member = 2 JOIN vec t ON t.task = x.task AND t.member = 0, range(1, 65) r(i))"


@query(
    "multiscale_disagreement",
    f"""WITH {_PAIRS}, m AS (SELECT task, median(abs(a - b)) AS limit_ FROM p GROUP BY task),
    r AS (SELECT *, {rank_sql('a', 'task')} AS ra, {rank_sql('b', 'task')} AS rb, row_number() OVER (PARTITION BY task ORDER BY abs(a) DESC, i DESC) <= 32 AS ta, row_number() OVER (PARTITION BY task ORDER BY abs(b) DESC, i DESC) <= 32 AS tb,
        row_number() OVER (PARTITION BY task ORDER BY (abs(a) + abs(b)) / 2 DESC, i DESC) <= 3 AS tail FROM p JOIN m USING (task)),
    f AS (SELECT task, sqrt(avg((a - b) ** 2)) AS rmse, count(*) FILTER (sign(a) = sign(b) AND a <> 0) / count(*) FILTER (a <> 0 AND b <> 0) AS direction_agreement, {corr_sql('ra', 'rb')} AS rank_spearman, count(*) FILTER (ta AND tb) / count(*) FILTER (ta OR tb) AS topk_jaccard,
        count(*) FILTER (abs(a) > limit_ AND abs(b) > limit_) / greatest(1, count(*) FILTER (abs(a) > limit_ OR abs(b) > limit_)) AS sparsity_jaccard, 1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS cosine_distance, abs(ln(var_pop(a) / var_pop(b))) AS variance_ratio, sqrt(avg((a - b) ** 2) FILTER (tail)) AS tail_divergence FROM r GROUP BY task)
    SELECT task, {rounded_sql(*pair_features.DISAGREEMENT)} FROM f""",
)
def multiscale_disagreement(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("task", pair_features.disagreement(F.col("a"), F.col("b")).alias("f"))
    return rows.select("task", "f.*").select("task", *rounded(*pair_features.DISAGREEMENT))


@query(
    "pair_vector_features",
    f"""WITH {_PAIRS}, q AS (SELECT *, (a + b) / 2 AS e, a - b AS d FROM p), f AS (SELECT task, sqrt(avg(e * e)) AS predicted_magnitude, sqrt(avg(d * d)) / 2 AS pair_lower_bound, sqrt(avg(a * a)) AS first_magnitude, sqrt(avg(b * b)) AS second_magnitude, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS model_cosine,
        avg(abs(e)) AS ensemble_mean_abs, max(abs(e)) AS ensemble_max_abs, avg(abs(d)) AS disagreement_mean_abs, count(*) FILTER (sign(a) = sign(b)) / count(*) AS sign_agreement, quantile_cont(abs(e), 0.9) AS ensemble_abs_p90, quantile_cont(abs(e), 0.99) AS ensemble_abs_p99,
        quantile_cont(abs(d), 0.9) AS disagreement_abs_p90, quantile_cont(abs(d), 0.99) AS disagreement_abs_p99, stddev_pop(e) AS ensemble_std, stddev_pop(d) AS disagreement_std FROM q GROUP BY task)
    SELECT task, {rounded_sql(*pair_features.PAIR)} FROM f""",
)
def pair_vector_features(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("task", pair_features.pair_features(F.col("a"), F.col("b")).alias("f"))
    return rows.select("task", "f.*").select("task", *rounded(*pair_features.PAIR))


@query("nested_benchmark")
def nested_benchmark(spark, sf_dir):
    """Eight bases of an upper bound of the pair's mean error, each calibrated in fifty splits of clusters of tasks."""
    rows = pairs(spark, sf_dir)
    a, b, t = F.col("a"), F.col("b"), F.col("truth")
    rows = rows.select("task", ((vec.rmse(a, t) + vec.rmse(b, t)) / 2).alias("outcome"), pair_features.pair_features(a, b).alias("f")).select("task", "outcome", "f.*")
    rows = rows.withColumn("cluster", F.floor(F.col("task") / 4))
    bases = {"constant": F.lit(0.0), "predicted_magnitude": F.col("predicted_magnitude"), "magnitude_plus_lower": F.greatest("predicted_magnitude", "pair_lower_bound"), "disagreement_spread": F.col("disagreement_std")}
    learners = {"ridge": (0.1, 0.0, False), "ridge_nonnegative": (0.1, 0.0, True), "elastic_net": (0.001, 0.5, False), "ridge_weak": (0.001, 0.0, False)}
    out = nested.nested_benchmark(rows, "cluster", "outcome", "pair_lower_bound", bases, list(pair_features.PAIR), learners)
    return out.withColumns({c: F.round(c, 6) for c in ("correction", "target_coverage", "task_coverage", "mean_upper", "mean_width", "median_upper")})
