"""Certificates, conformal bounds and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions import vectors as vec
from veritrail.functions.ranks import quantiles
from veritrail.operators import certificates as cert
from veritrail.plans.registry import query
from veritrail.sources import views
from veritrail.sources.storage import written
from veritrail.sources.views import EVENTS, LONG, VECTORS

CERTIFICATE = (
    LONG
    + """, cen AS (SELECT task, position, avg(prediction) AS c, var_pop(prediction) AS s FROM pred GROUP BY ALL),
    bym AS (SELECT task, member, avg((prediction - truth) ** 2) AS mse, avg((prediction - c) ** 2) AS shift FROM pred JOIN truth USING (task, position) JOIN cen USING (task, position) GROUP BY ALL),
    wor AS (SELECT task, count(*) AS n_members, avg(mse) AS fm, max(mse) AS wm, max(shift) AS rm FROM bym GROUP BY ALL),
    cem AS (SELECT task, avg((c - truth) ** 2) AS cm, avg(s) AS dm FROM cen JOIN truth USING (task, position) GROUP BY ALL),
    dia AS (SELECT task, max(a) AS am FROM (SELECT p.task, p.member, q.member AS m2, avg((p.prediction - q.prediction) ** 2) AS a FROM pred p JOIN pred q ON p.task = q.task AND p.position = q.position AND p.member < q.member GROUP BY ALL) GROUP BY ALL),
    cert AS (SELECT task, n_members, sqrt(fm) AS family_rms_error, sqrt(cm) AS centroid_rmse, sqrt(dm) AS diversity_lower, sqrt(wm) AS worst_member_error, sqrt(am) / 2 AS diameter_lower, sqrt(rm) AS family_radius, abs(fm - cm - dm) AS identity_residual
        FROM wor JOIN cem USING (task) JOIN dia USING (task))"""
)
_NUMBERS = ("family_rms_error", "centroid_rmse", "diversity_lower", "worst_member_error", "diameter_lower", "family_radius", "identity_residual")


def rounded(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def rounded_sql(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def certificates(spark, sf_dir):
    return cert.family_certificate(*views.predictions(spark, sf_dir), ["task"])


@query(
    "family_certificate",
    f"""WITH {CERTIFICATE} SELECT task, n_members, {rounded_sql(*_NUMBERS)}, diversity_lower > family_rms_error + 1e-10 AS family_violation, diameter_lower > worst_member_error + 1e-10 AS worst_violation,
    round(diversity_lower / family_rms_error, 6) AS family_tightness, round(diameter_lower / worst_member_error, 6) AS worst_tightness FROM cert""",
)
def family_certificate(spark, sf_dir):
    return certificates(spark, sf_dir).select("task", "n_members", *rounded(*_NUMBERS), "family_violation", "worst_violation", *rounded("family_tightness", "worst_tightness"))


@query(
    "pair_certificate",
    f"""WITH {VECTORS}, p AS (SELECT t.task, t.v AS t, a.v AS a, b.v AS b FROM vec t JOIN vec a ON a.task = t.task AND a.member = 1 JOIN vec b ON b.task = t.task AND b.member = 2 WHERE t.member = 0),
    e AS (SELECT task, sqrt(list_sum([(a[i] - t[i]) ** 2 for i in range(1, 65)]) / 64) AS error_a, sqrt(list_sum([(b[i] - t[i]) ** 2 for i in range(1, 65)]) / 64) AS error_b, sqrt(list_sum([(a[i] - b[i]) ** 2 for i in range(1, 65)]) / 64) AS apart FROM p)
    SELECT task, round(error_a, 6) AS error_a, round(error_b, 6) AS error_b, round(apart, 6) AS apart, apart / 2 <= (error_a + error_b) / 2 + 1e-10 AS mean_holds, apart / 2 <= greatest(error_a, error_b) + 1e-10 AS max_holds FROM e""",
)
def pair_certificate(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    of = lambda m, name: v.filter(F.col("member") == m).select("task", F.col("v").alias(name))
    rows = of(0, "t").join(of(1, "a"), "task").join(of(2, "b"), "task")
    rows = rows.select("task", vec.rmse(F.col("a"), F.col("t")).alias("error_a"), vec.rmse(F.col("b"), F.col("t")).alias("error_b"), vec.rmse(F.col("a"), F.col("b")).alias("apart"))
    half = F.col("apart") / 2
    checks = {"mean_holds": half <= (F.col("error_a") + F.col("error_b")) / 2 + cert.TOLERANCE, "max_holds": half <= F.greatest("error_a", "error_b") + cert.TOLERANCE}
    return rows.withColumns(checks).select("task", *rounded("error_a", "error_b", "apart"), *checks)


_TRANSPORT = CERTIFICATE + (
    f", cal AS (SELECT centroid_rmse, row_number() OVER (ORDER BY centroid_rmse) AS pos, count(*) OVER () AS n FROM cert WHERE {views.split_sql('task')} <> 'test'), k AS (SELECT max(centroid_rmse) AS u FROM cal WHERE pos = least(n, ceil((n + 1) * 0.9 - 1e-9))), ref AS (SELECT task, position, avg(prediction) AS r FROM pred WHERE member <= 2 GROUP BY ALL),"
    " sh AS (SELECT task, sqrt(avg((c - r) ** 2)) AS s FROM cen JOIN ref USING (task, position) GROUP BY ALL),"
    " up AS (SELECT *, u + s AS transported_upper, sqrt((u + s) ** 2 + diversity_lower ** 2) AS family_upper, u + s + family_radius AS worst_upper FROM cert JOIN sh USING (task), k WHERE " + views.split_sql("task") + " = 'test')"
)


def transported(spark, sf_dir):
    """Upper bounds of test tasks, from the conformal quantile over the other tasks."""
    members, truth = views.predictions(spark, sf_dir)
    rows = views.splits(written(cert.family_certificate(members, truth, ["task"])), "task")
    limit = cert.conformal_quantile(rows.filter("split <> 'test'").withColumn("all", F.lit(0)), ["all"], "centroid_rmse", 0.9, "u").select("u")
    rows = rows.filter("split = 'test'")
    centre = members.groupBy("task", "position").agg(F.avg("prediction").alias("c"), F.avg(F.when(F.col("member") <= 2, F.col("prediction"))).alias("r"))
    gap = F.col("c") - F.col("r")
    shift = centre.groupBy("task").agg(F.sqrt(F.avg(gap * gap)).alias("s"))
    return cert.transported(rows.join(shift, "task").join(F.broadcast(limit)), "u", "s")  # limit is one row


@query("family_upper_transport", f"WITH {_TRANSPORT} SELECT task, {rounded_sql('transported_upper', 'family_upper', 'worst_upper')}, family_rms_error <= family_upper + 1e-10 AS family_covered, worst_member_error <= worst_upper + 1e-10 AS worst_covered, round(family_upper - diversity_lower, 6) AS family_width, round(worst_upper - diameter_lower, 6) AS worst_width FROM up")
def family_upper_transport(spark, sf_dir):
    return transported(spark, sf_dir).select("task", *rounded("transported_upper", "family_upper", "worst_upper"), "family_covered", "worst_covered", *rounded("family_width", "worst_width"))


@query("family_coverage_by_target", f"WITH {_TRANSPORT} SELECT task % 20 AS target, count(*) AS n_tasks, count(*) FILTER (family_rms_error <= family_upper + 1e-10) AS n_covered, bool_and(family_rms_error <= family_upper + 1e-10) AS all_covered, bool_or(worst_member_error > worst_upper + 1e-10) AS any_worst_missed FROM up GROUP BY 1")
def family_coverage_by_target(spark, sf_dir):
    rows = transported(spark, sf_dir).withColumn("target", F.col("task") % 20)
    return rows.groupBy("target").agg(F.count("*").alias("n_tasks"), F.count_if("family_covered").alias("n_covered"), F.bool_and("family_covered").alias("all_covered"), F.bool_or(~F.col("worst_covered")).alias("any_worst_missed"))


def _embedded(name: str):
    sql_norm = "sqrt(list_sum([y * y for y in w]))"
    centre = "v" if name == "cosine" else "[x - list_sum(v) / 64 for x in v]"
    sql = VECTORS.replace("vec AS", "raw AS") + f""", cen0 AS (SELECT task, member, vec_id, label, {centre} AS w FROM raw), vec AS (SELECT task, member, vec_id, label, [x / {sql_norm} / sqrt(2.0) for x in w] AS v FROM cen0)"""
    return CERTIFICATE.replace(VECTORS, sql)


def _geometry(name: str):
    @query(f"geometry_{name}_certificate", f"WITH {_embedded(name)} SELECT task, {rounded_sql('family_rms_error', 'centroid_rmse', 'diversity_lower', 'worst_member_error', 'diameter_lower')} FROM cert")
    def run(spark, sf_dir):
        v = F.col("v")
        base = views.vectors(spark, sf_dir)
        unit = base.withColumn("v", vec.unit(v if name == "cosine" else vec.centred(v))).filter("v is not null")
        long = unit.select("task", "member", F.posexplode("v").alias("position", "x")).withColumn("x", F.col("x") / F.sqrt(F.lit(2.0)))
        rows = cert.family_certificate(long.filter("member > 0").withColumnRenamed("x", "prediction"), long.filter("member = 0").select("task", "position", F.col("x").alias("truth")), ["task"])
        return rows.select("task", *rounded("family_rms_error", "centroid_rmse", "diversity_lower", "worst_member_error", "diameter_lower"))


for _name in ("cosine", "pearson"):
    _geometry(_name)


@query(
    "governed_family_weighted",
    f"""WITH {LONG}, w AS (SELECT *, CASE WHEN member <= 2 THEN 0.25 ELSE CASE member WHEN 3 THEN 0.3 ELSE 0.2 END END AS weight FROM pred JOIN truth USING (task, position)),
    c AS (SELECT task, position, sum(weight * prediction) AS c FROM w GROUP BY ALL)
    SELECT task, round(sqrt(sum(weight * (prediction - truth) ** 2) / 64), 6) AS weighted_rms_error, round(sqrt(sum(weight * (prediction - c) ** 2) / 64), 6) AS weighted_diversity, round(1 / (0.25 ** 2 * 2 + 0.3 ** 2 + 0.2 ** 2), 6) AS effective_members FROM w JOIN c USING (task, position) GROUP BY task""",
)
def governed_family_weighted(spark, sf_dir):
    members, truth = views.predictions(spark, sf_dir)
    weights = spark.createDataFrame([(1, 0.25), (2, 0.25), (3, 0.3), (4, 0.2)], "member long, weight double")
    rows = members.join(F.broadcast(weights), "member").join(truth, ["task", "position"])  # four rows
    centre = rows.groupBy("task", "position").agg(F.sum(F.col("weight") * F.col("prediction")).alias("c"))
    e, d, w = F.col("prediction") - F.col("truth"), F.col("prediction") - F.col("c"), F.col("weight")
    sums = rows.join(centre, ["task", "position"]).groupBy("task").agg(F.sum(w * e * e).alias("e"), F.sum(w * d * d).alias("d"), F.count_distinct("position").alias("g"))
    effective = weights.agg((1 / F.sum(w * w)).alias("effective_members"))
    out = sums.select("task", F.sqrt(F.col("e") / F.col("g")).alias("weighted_rms_error"), F.sqrt(F.col("d") / F.col("g")).alias("weighted_diversity")).join(F.broadcast(effective))
    return out.select("task", *rounded("weighted_rms_error", "weighted_diversity", "effective_members"))


@query(
    "member_spread",
    f"WITH {LONG}, s AS (SELECT task, position, var_pop(prediction) AS v FROM pred GROUP BY ALL) SELECT task, round(sqrt(avg(v)), 6) AS member_spread, round(avg(v), 6) AS effect_variance FROM s GROUP BY task",
)
def member_spread(spark, sf_dir):
    members, _ = views.predictions(spark, sf_dir)
    spread = members.groupBy("task", "position").agg(F.var_pop("prediction").alias("v")).groupBy("task")
    return spread.agg(F.round(F.sqrt(F.avg("v")), 6).alias("member_spread"), F.round(F.avg("v"), 6).alias("effect_variance"))


@query(
    "proxy_seed_uncertainty",
    f"WITH {LONG}, c AS (SELECT task, position, avg(prediction) AS c FROM pred GROUP BY ALL) SELECT task, member, round(sqrt(avg((prediction - c) ** 2)), 6) AS risk, 'PROXY' AS tag FROM pred JOIN c USING (task, position) GROUP BY task, member",
)
def proxy_seed_uncertainty(spark, sf_dir):
    members, _ = views.predictions(spark, sf_dir)
    centre = members.groupBy("task", "position").agg(F.avg("prediction").alias("c"))
    off = F.col("prediction") - F.col("c")
    return members.join(centre, ["task", "position"]).groupBy("task", "member").agg(F.round(F.sqrt(F.avg(off * off)), 6).alias("risk"), F.lit("PROXY").alias("tag"))


@query(
    "conformal_cluster_upper",
    f"""WITH {EVENTS}, r AS (SELECT dataset, cluster, max(error - risk) AS resid FROM ev GROUP BY ALL),
    o AS (SELECT dataset, resid, row_number() OVER (PARTITION BY dataset ORDER BY resid) AS k, count(*) OVER (PARTITION BY dataset) AS n FROM r),
    q AS (SELECT dataset, n AS n_clusters, least(n, CAST(ceil((n + 1) * 0.9 - 1e-9) AS BIGINT)) AS conformal_rank, resid FROM o WHERE k = least(n, CAST(ceil((n + 1) * 0.9 - 1e-9) AS BIGINT)))
    SELECT dataset, n_clusters, conformal_rank, round(resid, 6) AS threshold, (SELECT count(*) FROM ev WHERE ev.dataset = q.dataset AND error <= greatest(risk + resid, 0)) AS n_covered FROM q""",
)
def conformal_cluster_upper(spark, sf_dir):
    ev = views.scored_events(spark, sf_dir)
    worst = ev.groupBy("dataset", "cluster").agg(F.max(F.col("error") - F.col("risk")).alias("resid"))
    q = cert.conformal_quantile(worst, ["dataset"], "resid", 0.9, "threshold")
    covered = F.count_if(F.col("error") <= F.greatest(F.col("risk") + F.col("threshold"), F.lit(0.0)))
    return ev.join(q, "dataset").groupBy("dataset", "n_clusters", "conformal_rank", "threshold").agg(covered.alias("n_covered")).withColumn("threshold", F.round("threshold", 6))


_RANK = "least(m, CAST(ceil((m + 1) * 0.9 - 1e-9) AS BIGINT))"


@query(
    "conformal_setting_matched",
    f"""WITH {EVENTS}, s AS (SELECT *, CASE WHEN cluster % 4 = 0 THEN 'rare' ELSE 'common' END AS setting, abs(error - risk) AS off FROM ev), known AS (SELECT * FROM s WHERE off IS NOT NULL),
    o AS (SELECT dataset, setting, off, row_number() OVER (PARTITION BY dataset, setting ORDER BY off) AS k, count(*) OVER (PARTITION BY dataset, setting) AS m FROM known), own AS (SELECT dataset, setting, m, off AS q FROM o WHERE k = {_RANK}),
    a AS (SELECT off, row_number() OVER (ORDER BY off) AS k, count(*) OVER () AS m FROM known), pooled AS (SELECT off AS p FROM a WHERE k = {_RANK}), sizes AS (SELECT dataset, setting, count(*) AS n FROM s GROUP BY ALL)
    SELECT sizes.dataset, sizes.setting, n, round(CASE WHEN m >= 30 THEN q ELSE p END, 6) AS threshold FROM sizes LEFT JOIN own ON own.dataset = sizes.dataset AND own.setting = sizes.setting LEFT JOIN pooled ON true""",
)
def conformal_setting_matched(spark, sf_dir):
    """Order statistics over all clusters, of a dataset's setting or, below 30 scores, of both settings of all datasets."""
    ev = views.scored_events(spark, sf_dir).withColumn("setting", F.when(F.col("cluster") % 4 == 0, "rare").otherwise("common")).withColumn("off", F.abs(F.col("error") - F.col("risk")))
    sizes = ev.groupBy("dataset", "setting").agg(F.count("*").alias("n"))
    own = cert.conformal_quantile(ev, ["dataset", "setting"], "off", 0.9, "q").select("dataset", "setting", "n_clusters", "q")
    pooled = cert.conformal_quantile(ev.withColumn("pool", F.lit(0)), ["pool"], "off", 0.9, "p").select("p")
    threshold = F.when(F.col("n_clusters") >= 30, F.col("q")).otherwise(F.col("p"))
    return sizes.join(own, ["dataset", "setting"], "left").join(F.broadcast(pooled), how="left").select("dataset", "setting", "n", F.round(threshold, 6).alias("threshold"))


@query(
    "unsafe_flags",
    f"""WITH {EVENTS}, s AS (SELECT *, {views.split_sql("event_id")} AS split FROM ev), q AS (SELECT dataset, quantile_cont(risk, 0.8) AS t FROM s WHERE split = 'val' GROUP BY ALL)
    SELECT dataset, count(*) AS n, count(*) FILTER (risk > t) AS n_unsafe, round(avg(error) FILTER (risk <= t), 6) AS safe_error FROM s JOIN q USING (dataset) WHERE split = 'test' GROUP BY dataset""",
)
def unsafe_flags(spark, sf_dir):
    ev = views.splits(views.scored_events(spark, sf_dir), "event_id")
    of = lambda split: quantiles(ev, ["dataset"], F.when(F.col("split") == split, F.col("risk")), {split: 0.8})
    limits = of("val").join(of("train"), "dataset").select("dataset", F.coalesce("val", "train").alias("t"))
    rows = ev.filter("split = 'test'").join(limits, "dataset")
    return rows.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(F.col("risk") > F.col("t")).alias("n_unsafe"), F.round(F.avg(F.when(F.col("risk") <= F.col("t"), F.col("error"))), 6).alias("safe_error"))
