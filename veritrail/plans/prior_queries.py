"""Label priors and predictions from alike tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions.vectors import rmse
from veritrail.operators import priors, programs
from veritrail.plans.certificate_queries import rounded
from veritrail.plans.program_queries import tasks
from veritrail.plans.registry import query
from veritrail.sources import views
from veritrail.sources.tables import table
from veritrail.sources.views import VECTORS

_MARKS = ", ".join(f"CASE WHEN regexp_matches(upper(perturbation || ' ' || context), '{'|'.join(words)}') THEN 1.0 ELSE 0.0 END" for words in priors.PATHWAYS.values())


@query(
    "prior_features",
    f"""WITH l AS (SELECT DISTINCT p_type AS perturbation, p_brand AS context, p_type || '::' || p_brand AS label FROM part), t AS (SELECT label, unnest(list_filter(list_prepend(label, string_split_regex(label, '[_+,-]')), lambda x: x <> '')) AS part FROM l), d AS (SELECT label, sha256(part) AS h FROM t),
    m AS (SELECT label, CAST(concat('0x', substr(h, 2 * j + 1, 2)) AS INT) % 64 AS place, CASE WHEN CAST(concat('0x', substr(h, 2 * j + 3, 2)) AS INT) % 2 = 1 THEN 1 ELSE -1 END AS s FROM d, range(0, 32, 2) r(j)), v AS (SELECT label, place, sum(s) AS x FROM m GROUP BY ALL),
    u AS (SELECT label, place + 6 AS place, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM v UNION ALL SELECT label, k - 1, [{_MARKS}][k] FROM l, range(1, 7) r(k))
    SELECT perturbation, context, CAST(place AS INTEGER) AS place, round(x / greatest(n, 1e-8), 6) AS x FROM l JOIN (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS n FROM u) USING (label) WHERE x <> 0""",
)
def prior_features(spark, sf_dir):
    """Pathway marks and hashed places of every type and brand of parts."""
    labels = table(spark, sf_dir, "part").select(F.col("p_type").alias("perturbation"), F.col("p_brand").alias("context")).distinct()
    rows = labels.select("*", F.posexplode(priors.prior_features(F.col("perturbation"), F.col("context"))).alias("place", "x"))
    return rows.filter("x <> 0").withColumn("x", F.round("x", 6))


@query(
    "control_transport",
    f"""WITH {VECTORS}, tk AS (SELECT vec_id AS id, member AS context, task AS perturbation, v, {views.split_sql('vec_id')} = 'train' AS train FROM vec),
    c AS (SELECT context, list(m ORDER BY i) AS c FROM (SELECT context, i, avg(v[i]) AS m FROM tk, range(1, 65) r(i) WHERE train GROUP BY ALL) GROUP BY context), g AS (SELECT i, avg(v[i]) AS m FROM tk, range(1, 65) r(i) WHERE train GROUP BY i),
    s AS (SELECT q.id, q.context <> s.context AS other, s.v, list_dot_product(a.c, b.c) / (sqrt(list_dot_product(a.c, a.c)) * sqrt(list_dot_product(b.c, b.c)) + 1e-8) AS sim FROM tk q JOIN tk s ON s.perturbation = q.perturbation AND s.train JOIN c a ON a.context = q.context JOIN c b ON b.context = s.context),
    u AS (SELECT * FROM s QUALIFY other OR NOT bool_or(other) OVER (PARTITION BY id)), p AS (SELECT id, i, sum(exp(5 * sim) * v[i]) / sum(exp(5 * sim)) AS x, max(sim) AS likeness FROM u, range(1, 65) r(i) GROUP BY ALL)
    SELECT tk.id, tk.train, round(sqrt(avg((coalesce(p.x, g.m) - tk.v[g.i]) ** 2)), 6) AS rmse, round(coalesce(max(p.likeness), 0), 6) AS likeness, coalesce(max(p.likeness), 0) < 0.35 AS unsafe
    FROM tk JOIN c USING (context) CROSS JOIN g LEFT JOIN p ON p.id = tk.id AND p.i = g.i GROUP BY ALL""",
)
def control_transport(spark, sf_dir):
    """Of every task the error of transport from the perturbation's other contexts by likeness of controls."""
    rows = priors.control_transported(tasks(spark, sf_dir), "out")
    return rows.select("id", "train", F.round(rmse(F.col("out"), F.col("effect")), 6).alias("rmse"), F.round("likeness", 6).alias("likeness"), "unsafe")


def studies(spark, sf_dir):
    """Tasks of five studies, each a pool of its own."""
    return tasks(spark, sf_dir).withColumn("study", F.col("perturbation") % 5)


@query("alike_task_baselines")
def alike_task_baselines(spark, sf_dir):
    """Of every task the errors of smoothing by labels, of barycentres by controls and labels, of blends in program space and of ridge on labels."""
    rows = studies(spark, sf_dir)
    bank = programs.fit_programs(rows.filter("train"), "effect", 24, "combo")
    rows = priors.barycentric(priors.prior_smoothed(rows, ["study"], "smoothed"), ["study"], "barycentre")
    rows = priors.label_ridge(priors.latent_delta(rows, bank, ["study"], "latent"), "ridge")
    names = ["smoothed", "barycentre", "latent", "ridge"]
    return rows.withColumns({n: rmse(F.col(n), F.col("effect")) for n in names}).select("id", "study", "train", *rounded(*names))


@query("graph_prior_transport")
def graph_prior_transport(spark, sf_dir):
    """Of every task the errors of the strong baseline and of transport with alike labels, and how little support it has."""
    rows = priors.with_support(priors.graph_transported(studies(spark, sf_dir), ["study"], "out", 24))
    return rows.withColumns({"base": rmse(F.col("base"), F.col("effect")), "transport": rmse(F.col("out"), F.col("effect"))}).select("id", "study", "train", *rounded("base", "transport", "uncertainty"))
