"""Weighted source effects, nested medians, concordance of models, novelty and support, the ladder of pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions import vectors as vec
from veritrail.functions.scalars import fold
from veritrail.operators import evidence
from veritrail.operators.programs import vector_sums
from veritrail.plans.certificate_queries import rounded, rounded_sql
from veritrail.plans.effect_queries import _EFFECT, effects
from veritrail.plans.metric_queries import corr_sql, rank_sql
from veritrail.plans.registry import query
from veritrail.sources import views
from veritrail.sources.views import EVENTS, VECTORS


@query(
    "weighted_source_delta",
    f"""WITH {_EFFECT}, z AS (SELECT DISTINCT context, perturbation, n_cells FROM eff), g AS (SELECT DISTINCT perturbation, gene FROM eff)
    SELECT t.context, t.perturbation, g.gene, round(sum(s.n_cells * coalesce(e.effect, 0)) / sum(s.n_cells), 6) AS delta, count(*) AS n_source_contexts, CAST(sum(s.n_cells) AS BIGINT) AS n_source_cells
    FROM z t JOIN g USING (perturbation) JOIN z s ON s.perturbation = t.perturbation AND s.context <> t.context LEFT JOIN eff e ON e.context = s.context AND e.perturbation = s.perturbation AND e.gene = g.gene GROUP BY ALL""",
)
def weighted_source_delta(spark, sf_dir):
    return evidence.weighted_source_deltas(effects(spark, sf_dir)).withColumn("delta", F.round("delta", 6))


@query("median_of_medians", f"WITH {EVENTS}, f AS (SELECT dataset, cluster, {views.fold_sql('event_id', 3)} AS fold, median(risk) AS m FROM ev GROUP BY ALL) SELECT dataset, cluster, round(median(m), 6) AS risk FROM f GROUP BY ALL")
def median_of_medians(spark, sf_dir):
    """Of every kind of events and user the median over folds of the folds' median risks."""
    rows = views.scored_events(spark, sf_dir).withColumn("fold", fold(F.sha2(F.col("event_id").cast("string"), 256), 3))
    return evidence.nested_medians(rows, ["fold"], ["dataset", "cluster"], "risk", "risk").withColumn("risk", F.round("risk", 6))


def errors(spark, sf_dir):
    """(task, study, cluster, a, b, distance) of the first two members' errors."""
    v = views.vectors(spark, sf_dir)
    of = lambda m, name: v.filter(F.col("member") == m).select("task", F.col("v").alias(name))
    rows = of(0, "t").join(of(1, "x"), "task").join(of(2, "y"), "task")
    t, x, y = F.col("t"), F.col("x"), F.col("y")
    study = F.when(F.col("task") % 2 == 0, "even").otherwise("odd")
    return rows.select("task", study.alias("study"), F.floor(F.col("task") / 4).alias("cluster"), vec.rmse(x, t).alias("a"), vec.rmse(y, t).alias("b"), vec.rmse(x, y).alias("distance"))


_RMSE = "sqrt(list_sum([({0}[i] - {1}[i]) ** 2 for i in range(1, 65)]) / 64)"
_ERRORS = f"{VECTORS}, er AS (SELECT t.task, CASE WHEN t.task % 2 = 0 THEN 'even' ELSE 'odd' END AS study, t.task // 4 AS cluster, {_RMSE.format('x.v', 't.v')} AS a, {_RMSE.format('y.v', 't.v')} AS b, {_RMSE.format('x.v', 'y.v')} AS distance FROM vec t JOIN vec x ON x.task = t.task AND x.member = 1 JOIN vec y ON y.task = t.task AND y.member = 2 WHERE t.member = 0)"
_SHARES = ("both_high", "both_low", "discordant", "top20_overlap", "top20_jaccard", "first_lower", "second_lower", "ties", "median_abs_gap", "task_rho", "cluster_rho")


@query(
    "model_concordance",
    f"""WITH {_ERRORS}, m AS (SELECT study, median(a) AS ma, median(b) AS mb, quantile_cont(a, 0.8) AS ta, quantile_cont(b, 0.8) AS tb FROM er GROUP BY study),
    k AS (SELECT er.*, a >= ma AS ha, b >= mb AS hb, a >= ta AS pa, b >= tb AS pb, {rank_sql('a', 'study')} AS ra, {rank_sql('b', 'study')} AS rb FROM er JOIN m USING (study)),
    c AS (SELECT study, cluster, avg(a) AS a, avg(b) AS b FROM er GROUP BY ALL), cr AS (SELECT study, {rank_sql('a', 'study')} AS ra, {rank_sql('b', 'study')} AS rb FROM c), cc AS (SELECT study, {corr_sql('ra', 'rb')} AS cluster_rho FROM cr GROUP BY study),
    f AS (SELECT study, count(*) AS n_tasks, count(DISTINCT cluster) AS n_clusters, avg((ha AND hb)::INT) AS both_high, avg((NOT ha AND NOT hb)::INT) AS both_low, avg((ha <> hb)::INT) AS discordant, avg((pa AND pb)::INT) AS top20_overlap, count(*) FILTER (pa AND pb) / count(*) FILTER (pa OR pb) AS top20_jaccard,
        avg((a < b)::INT) AS first_lower, avg((b < a)::INT) AS second_lower, avg((a = b)::INT) AS ties, median(abs(a - b)) AS median_abs_gap, {corr_sql('ra', 'rb')} AS task_rho FROM k GROUP BY study)
    SELECT study, n_tasks, n_clusters, {rounded_sql(*_SHARES)} FROM f JOIN cc USING (study)""",
)
def model_concordance(spark, sf_dir):
    found = evidence.concordance(errors(spark, sf_dir), ["study"], "a", "b", "cluster")
    return found.select("study", "n_tasks", "n_clusters", *rounded(*_SHARES))


_LADDER = ("lower", "family_rms", "family_worst", "centroid_error", "rms_tightness", "worst_tightness")


@query("pair_ladder", f"WITH {_ERRORS}, l AS (SELECT task, distance / 2 AS lower, sqrt((a * a + b * b) / 2) AS family_rms, greatest(a, b) AS family_worst FROM er), k AS (SELECT *, sqrt(greatest(family_rms ** 2 - lower ** 2, 0)) AS centroid_error, CASE WHEN family_rms > 0 THEN lower / family_rms ELSE 0 END AS rms_tightness, CASE WHEN family_worst > 0 THEN lower / family_worst ELSE 0 END AS worst_tightness, lower > family_rms + 1e-10 AS rms_violation, lower > family_worst + 1e-10 AS worst_violation FROM l) SELECT task, {rounded_sql(*_LADDER)}, rms_violation, worst_violation FROM k")
def pair_ladder(spark, sf_dir):
    rows = errors(spark, sf_dir)
    rows = rows.select("task", *(c.alias(k) for k, c in evidence.pair_ladder(F.col("a"), F.col("b"), F.col("distance")).items()))
    return rows.select("task", *rounded(*_LADDER), "rms_violation", "worst_violation")


@query(
    "structural_novelty",
    f"""WITH {VECTORS}, rw AS (SELECT vec_id, label AS context, vec_id // 10 AS perturbation, f AS fold, CASE WHEN {views.fold_sql('label', 3)} = f THEN 'test' ELSE 'train' END AS split FROM vec, range(0, 3) r(f)), l AS (SELECT label AS context, i, avg(v[i]) AS x FROM vec, range(1, 65) t(i) GROUP BY ALL),
    s AS (SELECT a.context AS c, b.context AS d, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS s FROM l a JOIN l b ON a.i = b.i AND a.context <> b.context GROUP BY ALL), m AS (SELECT greatest(median(1 - s), 1e-8) AS scale FROM s WHERE c < d AND 1 - s > 1e-10),
    tc AS (SELECT DISTINCT fold, context FROM rw WHERE split = 'train'), nr AS (SELECT fold, c, max(s) AS near FROM s JOIN tc ON tc.context = s.d GROUP BY ALL), sp AS (SELECT fold, perturbation, count(*) AS n FROM rw WHERE split = 'train' GROUP BY ALL)
    SELECT vec_id, rw.fold, split, round(CASE WHEN tc.context IS NOT NULL THEN 0 ELSE least((1 - near) / scale, 5) END, 6) AS context_novelty, coalesce(n, 0) AS support, round(1 / (1 + coalesce(n, 0)), 6) AS perturbation_novelty
    FROM rw LEFT JOIN tc ON tc.fold = rw.fold AND tc.context = rw.context LEFT JOIN nr ON nr.fold = rw.fold AND nr.c = rw.context LEFT JOIN sp ON sp.fold = rw.fold AND sp.perturbation = rw.perturbation, m""",
)
def structural_novelty(spark, sf_dir):
    """Labels as contexts, of which each fold leaves some out; their mean vectors are the controls."""
    v = views.vectors(spark, sf_dir).select("vec_id", F.col("label").alias("context"), "v")
    controls = vector_sums(v, ["context"], "v", "s", "n").select("context", F.transform("s", lambda x: x / F.col("n")).alias("v"))
    rows = v.select("vec_id", "context", F.floor(F.col("vec_id") / 10).alias("perturbation"), F.explode(F.array(*map(F.lit, range(3)))).alias("fold"))
    out = fold(F.sha2(F.col("context").cast("string"), 256), 3) == F.col("fold")
    rows = rows.withColumn("split", F.when(out, "test").otherwise("train"))
    found = evidence.structural_features(rows, controls)
    return found.select("vec_id", "fold", "split", *rounded("context_novelty"), "support", *rounded("perturbation_novelty"))
