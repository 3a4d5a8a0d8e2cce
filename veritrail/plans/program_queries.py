"""Hashed labels, vector baselines, program banks and transport in program space."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions.vectors import rmse
from veritrail.operators import modules, programs
from veritrail.plans.registry import query
from veritrail.sources import views
from veritrail.sources.tables import table
from veritrail.sources.views import VECTORS


@query(
    "hashed_labels",
    """WITH l AS (SELECT DISTINCT p_type AS label FROM part), t AS (SELECT label, unnest(list_filter(list_prepend(label, string_split_regex(label, '[_+,-]')), lambda x: x <> '')) AS part FROM l), d AS (SELECT label, sha256(part) AS h FROM t),
    m AS (SELECT label, CAST(concat('0x', substr(h, 2 * j + 1, 2)) AS INT) % 64 AS place, CASE WHEN CAST(concat('0x', substr(h, 2 * j + 3, 2)) AS INT) % 2 = 1 THEN 1 ELSE -1 END AS s FROM d, range(0, 32, 2) r(j)), v AS (SELECT label, CAST(place AS INTEGER) AS place, sum(s) AS x FROM m GROUP BY ALL)
    SELECT label, place, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM v WHERE x <> 0""",
)
def hashed_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "part").select(F.col("p_type").alias("label")).distinct()
    return labels.select("label", F.posexplode(programs.hashed_label(F.col("label"))).alias("place", "x")).filter("x <> 0").withColumn("x", F.round("x", 6))


def tasks(spark, sf_dir):
    """Vectors as tasks: blocks of five share a perturbation, the place in the block is the context, whose training mean is its control."""
    rows = views.vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("member").alias("context"), F.col("task").alias("perturbation"), F.col("v").alias("effect"))
    rows = views.splits(rows, "id").withColumn("train", F.col("split") == "train").drop("split")
    control = programs.vector_sums(rows.filter("train"), ["context"], "effect", "s", "n")
    return rows.join(control.select("context", F.transform("s", lambda x: x / F.col("n")).alias("control")), "context")


_TASKS = f"{VECTORS}, tk AS (SELECT vec_id AS id, member AS context, task AS perturbation, i AS position, v[i] AS x, {views.split_sql('vec_id')} = 'train' AS train FROM vec, range(1, 65) t(i))"


@query(
    "vector_baseline",
    f"""WITH {_TASKS}, tr AS (SELECT * FROM tk WHERE train), p AS (SELECT perturbation, position, sum(x) AS s, count(*) AS n FROM tr GROUP BY ALL), b AS (SELECT perturbation, context, position, sum(x) AS s, count(*) AS n FROM tr GROUP BY ALL),
    c AS (SELECT context, position, avg(x) AS m FROM tr GROUP BY ALL), g AS (SELECT position, avg(x) AS m FROM tr GROUP BY ALL)
    SELECT id, CAST(tk.position - 1 AS INTEGER) AS position, round(CASE WHEN c.m IS NULL THEN coalesce(p.s / p.n, g.m) ELSE 0.85 * coalesce(p.s / p.n, g.m) + 0.15 * c.m END, 6) AS base,
        round(CASE WHEN p.n > coalesce(b.n, 0) THEN (p.s - coalesce(b.s, 0)) / (p.n - coalesce(b.n, 0)) ELSE coalesce(p.s / p.n, g.m) END, 6) AS source
    FROM tk LEFT JOIN p USING (perturbation, position) LEFT JOIN b USING (perturbation, context, position) LEFT JOIN c USING (context, position) JOIN g USING (position)""",
)
def vector_baseline(spark, sf_dir):
    """The strong baseline of every task and the mean effect of its perturbation in other contexts, position by position."""
    rows = programs.baseline_and_source(tasks(spark, sf_dir))
    long = rows.select("id", F.posexplode(F.arrays_zip("base", "source")).alias("position", "x"))
    return long.select("id", "position", F.round("x.base", 6).alias("base"), F.round("x.source", 6).alias("source"))


@query("program_bank")
def program_bank(spark, sf_dir):
    """Programs of the training vectors, a third each of components, factors and variable positions, with their entries."""
    bank = programs.fit_programs(tasks(spark, sf_dir).filter("train"), "effect", 24, "combo")
    rows = [(k, kind, [float(x) for x in row]) for k, (kind, row) in enumerate(zip(bank.kinds, bank.components, strict=True))]
    return spark.createDataFrame(rows, "program int, kind string, v array<double>").select("program", "kind", F.posexplode("v").alias("position", "weight"))


@query("pca_projection")
def pca_projection(spark, sf_dir):
    """Every vector on the eight leading components of all vectors."""
    rows = views.vectors(spark, sf_dir).select("vec_id", "v")
    bank = programs.fit_programs(rows, "v", 8, "pca")
    return rows.select("vec_id", F.posexplode(bank.scores(F.col("v"))).alias("component", "score")).withColumn("score", F.round("score", 6))


@query("program_transport")
def program_transport(spark, sf_dir):
    """Of every task the errors of the strong baseline and of transport in program space."""
    rows = programs.transported(tasks(spark, sf_dir), 24, "combo")
    return rows.select("id", "train", F.round(rmse(F.col("base"), F.col("effect")), 6).alias("base_rmse"), F.round(rmse(F.col("prediction"), F.col("effect")), 6).alias("transport_rmse"))


@query("network_modules")
def network_modules(spark, sf_dir):
    """Modules of the vectors' positions with their members' weights, and the single positions that fill the bank up."""
    table = modules.network_modules(views.vectors(spark, sf_dir).select("v"), "v", 24)[1]
    return table.select("program", "kind", "position", F.round("weight", 6).alias("weight"), F.round("hub", 6).alias("hub"))
