"""Similarity, retrieval, projections, graphs, meta-analysis, models and streams."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import functions as F

from veritrail.functions import scalars
from veritrail.functions.ranks import average_ranks
from veritrail.operators import graphs, metrics, scaling, similarity, small
from veritrail.plans.certificate_queries import rounded
from veritrail.plans.registry import query
from veritrail.sources import views
from veritrail.sources.tables import table
from veritrail.sources.views import EVENTS, VECTORS
from veritrail.streaming import windows

_COS = "list_sum([p.v[i] * q.v[i] for i in range(1, 65)]) / (sqrt(list_sum([x * x for x in p.v])) * sqrt(list_sum([x * x for x in q.v])))"


@query("knn_similarity_join", f"WITH {VECTORS}, s AS (SELECT p.label, p.vec_id AS id, q.vec_id AS source, {_COS} AS cosine FROM vec p JOIN vec q ON p.label = q.label AND p.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, source) AS nth FROM s) SELECT label, id, source, round(cosine, 6) AS cosine, CAST(nth AS INT) AS nth FROM r WHERE nth <= 3")
def knn_similarity_join(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    found = similarity.neighbours(v.select("label", F.col("vec_id").alias("id"), "v"), v.select("label", F.col("vec_id").alias("source"), F.col("v").alias("w")), ["label"], 3, others=True)
    return found.withColumn("cosine", F.round("cosine", 6))


_KNN = f"{VECTORS}, s AS (SELECT p.label, p.vec_id AS id, q.vec_id AS source, {_COS} AS cosine FROM vec p JOIN vec q ON p.label = q.label AND p.member = 0 AND q.member > 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, source) AS nth FROM s), k AS (SELECT *, exp((cosine - max(cosine) OVER (PARTITION BY id)) / 0.1) AS e FROM r WHERE nth <= 4), w AS (SELECT *, e / sum(e) OVER (PARTITION BY id) AS weight FROM k)"


@query("context_sim_prediction", f"WITH {_KNN} SELECT w.id, i AS position, round(sum(weight * v[i + 1]) / sum(weight), 6) AS prediction FROM w JOIN vec ON vec.vec_id = w.source, range(0, 64) t(i) GROUP BY w.id, i")
def context_sim_prediction(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    found = similarity.neighbours(v.filter("member = 0").select("label", F.col("vec_id").alias("id"), "v"), v.filter("member > 0").select("label", F.col("vec_id").alias("source"), F.col("v").alias("w")), ["label"], 4)
    values = v.select(F.col("vec_id").alias("source"), F.posexplode("v").alias("position", "x"))
    out = similarity.weighted_prediction(similarity.softmax_weights(found, ["label"], 0.1), values, ["label"])
    return out.select("id", F.col("position").cast("long").alias("position"), F.round("prediction", 6).alias("prediction"))


@query("context_similarity_max", f"WITH {VECTORS}, s AS (SELECT p.vec_id AS id, {_COS} AS c FROM vec p JOIN vec q ON p.label = q.label AND q.member <> p.member AND p.member = 0) SELECT id, round(max(c), 6) AS context_similarity_max, round(avg(c), 6) AS context_similarity_mean, round(1 - max(c), 6) AS ood_nearest_distance FROM s GROUP BY id")
def context_similarity_max(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    found = similarity.likeness(v.filter("member = 0").select("label", F.col("vec_id").alias("id"), "v"), v.filter("member <> 0").select("label", F.col("vec_id").alias("source"), F.col("v").alias("w")), ["label"])
    return found.select("id", F.round("greatest", 6).alias("context_similarity_max"), F.round("mean", 6).alias("context_similarity_mean"), F.round(1 - F.col("greatest"), 6).alias("ood_nearest_distance"))


def _pool(spark, sf_dir):
    v = views.vectors(spark, sf_dir).withColumn("pool", F.col("task") % 5)
    return v.filter("member = 1").select("pool", F.col("task").alias("id"), "v"), v.filter("member = 0").select("pool", F.col("task").alias("source"), F.col("v").alias("w"))


_PAIRS = f"{VECTORS}, s AS (SELECT p.task % 5 AS pool, p.task AS id, q.task AS source, {_COS} AS c, sqrt(list_sum([(p.v[i] - q.v[i]) ** 2 for i in range(1, 65)]) / 64) AS d FROM vec p JOIN vec q ON p.task % 5 = q.task % 5 AND p.member = 1 AND q.member = 0), o AS (SELECT *, max(c) FILTER (id = source) OVER (PARTITION BY id) AS oc, max(d) FILTER (id = source) OVER (PARTITION BY id) AS od FROM s)"


@query("identity_retrieval_rank", f"WITH {_PAIRS}, g AS (SELECT pool, id, count(*) AS n, count(*) FILTER (c > oc) + (count(*) FILTER (c = oc) + 1) / 2 AS rank FROM o GROUP BY ALL) SELECT pool, id, n, rank, round(1 - (rank - 1) / (n - 1), 6) AS score FROM g WHERE n >= 10")
def identity_retrieval_rank(spark, sf_dir):
    return similarity.retrieval(*_pool(spark, sf_dir), ["pool"], 10).withColumn("score", F.round("score", 6))


@query("centroid_accuracy", f"WITH {_PAIRS} SELECT pool, id, round(avg(CASE WHEN od < d THEN 1.0 ELSE 0 END), 6) AS accuracy FROM o WHERE id <> source GROUP BY pool, id")
def centroid_accuracy(spark, sf_dir):
    return similarity.centroid_accuracy(*_pool(spark, sf_dir), ["pool"]).withColumn("accuracy", F.round("accuracy", 6))


@query("pathway_projection", f"WITH {VECTORS} SELECT vec_id, k AS component, round(sum(v[i] * ((i * (k + 3)) % 7 - 3)), 6) AS x FROM vec, range(1, 65) a(i), range(0, 3) b(k) GROUP BY vec_id, k")
def pathway_projection(spark, sf_dir):
    long = views.vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("position", "x"))
    weight = ((F.col("position") + 1) * (F.col("component") + 3)) % 7 - 3
    weights = spark.range(64).select(F.col("id").cast("int").alias("position"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("component")).withColumn("w", weight)
    return similarity.projected(long, weights, ["vec_id"]).withColumn("x", F.round("x", 6))


@query(
    "bfs_distance",
    """WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(node, hops) AS (SELECT 's1', 0 UNION SELECT u.b, r.hops + 1 FROM r JOIN u ON r.node = u.a WHERE r.hops < (SELECT count(DISTINCT a) FROM u)) SELECT node, min(hops) AS hops FROM r GROUP BY node""",
)
def bfs_distance(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    return graphs.distances(edges, spark.createDataFrame([("s1",)], "node string"))


@query("protocol_scores_long", f"""WITH {EVENTS}, s AS (SELECT event_id, dataset, {views.split_sql('event_id')} AS split, risk AS ctx, ln(1 + cluster) AS sup, error AS dis FROM ev),
    q AS (SELECT dataset, """ + ", ".join(f"median({c}) FILTER (split = 'train') AS m_{c}, quantile_cont({c}, 0.75) FILTER (split = 'train') - quantile_cont({c}, 0.25) FILTER (split = 'train') AS i_{c}" for c in ("ctx", "sup", "dis")) + """ FROM s GROUP BY ALL),
    z AS (SELECT event_id, dataset, (ctx - m_ctx) / i_ctx AS zc, (sup - m_sup) / i_sup AS zs, (dis - m_dis) / i_dis AS zd FROM s JOIN q USING (dataset))
    SELECT event_id, 'protocol' AS score_name, 'confidence' AS score_type, round(CASE WHEN dataset IN ('click', 'view') THEN zs - zd ELSE zc + zs - zd END, 6) AS score_value FROM z
    UNION ALL SELECT event_id, 'context', 'confidence', round(zc, 6) FROM z UNION ALL SELECT event_id, 'disagreement', 'risk', round(zd, 6) FROM z""")
def protocol_scores_long(spark, sf_dir):
    rows = views.splits(views.scored_events(spark, sf_dir), "event_id").withColumn("sup", F.log1p("cluster"))
    for c, z in (("risk", "zc"), ("sup", "zs"), ("error", "zd")):
        rows = scaling.robust_z(rows, ["dataset"], c, F.col("split") == "train", z)
    short = F.col("zs") - F.col("zd")
    score = F.when(F.col("dataset").isin("click", "view"), short).otherwise(F.col("zc") + short)
    one = lambda name, kind, value: F.struct(F.lit(name).alias("score_name"), F.lit(kind).alias("score_type"), F.round(value, 6).alias("score_value"))
    scores = F.array(one("protocol", "confidence", score), one("context", "confidence", F.col("zc")), one("disagreement", "risk", F.col("zd")))
    return rows.select("event_id", F.inline(scores))


@query("weight_grid_tuning", f"""WITH {EVENTS}, g AS (SELECT a, b FROM (VALUES (0.25), (0.5), (1.0)) x(a), (VALUES (0.0), (0.5), (1.0)) y(b)), s AS (SELECT dataset, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, risk * a + cluster * b AS score, error FROM ev, g WHERE {views.split_sql('event_id')} = 'val'),
    r AS (SELECT *, (rank() OVER (PARTITION BY dataset, a, b ORDER BY score) + (count(*) OVER (PARTITION BY dataset, a, b, score) - 1) / 2.0) AS x, (rank() OVER (PARTITION BY dataset, a, b ORDER BY error) + (count(*) OVER (PARTITION BY dataset, a, b, error) - 1) / 2.0) AS y FROM s),
    k AS (SELECT dataset, a, b, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS rho FROM r GROUP BY ALL) SELECT dataset, a, b, rho FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY rho DESC, a, b) AS k FROM k) WHERE k = 1""")
def weight_grid_tuning(spark, sf_dir):
    rows = views.splits(views.scored_events(spark, sf_dir), "event_id").filter("split = 'val'")
    grid = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0.25, 0.5, 1.0) for b in (0.0, 0.5, 1.0)))
    scored = rows.select("dataset", "risk", "cluster", "error", F.inline(grid)).withColumn("score", F.col("risk") * F.col("a") + F.col("cluster") * F.col("b"))
    rho = metrics.spearman(scored, ["dataset", "a", "b"], "score", "error").withColumn("rho", F.round("rho", 6))
    best = rho.groupBy("dataset").agg(F.min(F.struct((-F.col("rho")).alias("down"), "a", "b")).alias("x"))
    return best.select("dataset", "x.a", "x.b", (-F.col("x.down")).alias("rho"))


@query("fixed_rank_blends", f"WITH {EVENTS}, r AS (SELECT event_id, (rank() OVER (PARTITION BY dataset ORDER BY risk) + (count(*) OVER (PARTITION BY dataset, risk) - 1) / 2.0) / count(*) OVER (PARTITION BY dataset) AS a, (rank() OVER (PARTITION BY dataset ORDER BY cluster) + (count(*) OVER (PARTITION BY dataset, cluster) - 1) / 2.0) / count(*) OVER (PARTITION BY dataset) AS b FROM ev) SELECT event_id, round(0.5 * a + 0.5 * b, 6) AS blend_50, round(0.25 * a + 0.75 * b, 6) AS blend_25, round(0.75 * a + 0.25 * b, 6) AS blend_75 FROM r")
def fixed_rank_blends(spark, sf_dir):
    rows = average_ranks(average_ranks(views.scored_events(spark, sf_dir), ["dataset"], "risk", "ra", "n"), ["dataset"], "cluster", "rb")
    a, b = F.col("ra") / F.col("n"), F.col("rb") / F.col("n")
    return rows.select("event_id", *(F.round(w * a + (1 - w) * b, 6).alias(f"blend_{round(100 * w)}") for w in (0.5, 0.25, 0.75)))


@query("predictor_selection_pairs", f"WITH {EVENTS}, k AS (SELECT cluster, avg(error) FILTER (dataset = 'click') AS a, avg(error) FILTER (dataset = 'view') AS b FROM ev GROUP BY cluster) SELECT cluster, round(a, 6) AS error_a, round(b, 6) AS error_b, CASE WHEN a <= b THEN 'a' ELSE 'b' END AS winner, round(least(a, b), 6) AS oracle_error FROM k WHERE a IS NOT NULL AND b IS NOT NULL")
def predictor_selection_pairs(spark, sf_dir):
    wide = views.scored_events(spark, sf_dir).groupBy("cluster").pivot("dataset", ["click", "view"]).agg(F.avg("error")).dropna()
    a, b = F.col("click"), F.col("view")
    return wide.select("cluster", F.round(a, 6).alias("error_a"), F.round(b, 6).alias("error_b"), F.when(a <= b, "a").otherwise("b").alias("winner"), F.round(F.least(a, b), 6).alias("oracle_error"))


@query("scalar_functions", "SELECT s_suppkey, regexp_replace(lower(trim(s_name)), '[^a-z0-9]+', '', 'g') AS key, 'sha256:' || sha256(s_name || chr(10) || s_nationkey) AS order_hash, round(atanh(greatest(-0.999999, least(0.999999, s_acctbal / 10000))), 6) AS z, round(ln(1 + abs(s_acctbal)), 6) AS magnitude, CAST(concat('0x', substr(sha256(CAST(s_suppkey AS VARCHAR)), 1, 8)) AS BIGINT) % 7 AS fold FROM supplier")
def scalar_functions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    order = F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\n", "s_name", F.col("s_nationkey").cast("string")), 256))
    fold = scalars.fold(F.sha2(F.col("s_suppkey").cast("string"), 256), 7)
    return s.select("s_suppkey", scalars.name_key(F.col("s_name")).alias("key"), order.alias("order_hash"), F.round(scalars.fisher_z(F.col("s_acctbal") / 10000), 6).alias("z"), F.round(F.log1p(F.abs("s_acctbal")), 6).alias("magnitude"), fold.alias("fold"))


@query("tumbling_windows", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    return windows.hourly(table(spark, sf_dir, "events")).withColumn("mean_value", F.round("mean_value", 6))


@query("random_effects_meta")
def random_effects_meta(spark, sf_dir):
    """Effect of each cluster group within a dataset as a study."""
    studies = views.scored_events(spark, sf_dir).withColumn("study", F.col("cluster") % 8).groupBy("dataset", "study").agg(F.avg("error").alias("y"), (F.stddev_samp("error") / F.sqrt(F.count("*").cast("double"))).alias("se"))
    return small.meta_analysis(studies, "dataset", "y", "se")


@query("error_ranker_ml")
def error_ranker_ml(spark, sf_dir):
    """Boosted trees fitted on train and val rows, scored on test rows."""
    rows = views.splits(views.scored_events(spark, sf_dir), "event_id").dropna(subset=["risk", "error"])
    ready = VectorAssembler(inputCols=["risk", "cluster"], outputCol="features").transform(rows.withColumn("cluster", F.col("cluster").cast("double")))
    model = GBTRegressor(labelCol="error", maxIter=5, maxDepth=3, seed=7).fit(ready.filter("split <> 'test'"))
    return model.transform(ready.filter("split = 'test'")).select("event_id", F.col("prediction").alias("expected_error"))


@query("isotonic_crossfit")
def isotonic_crossfit(spark, sf_dir):
    """Out-of-fold isotonic calibration of risk, folds by hash of the cluster."""
    rows = views.scored_events(spark, sf_dir).dropna(subset=["risk", "error"]).withColumn("fold", scalars.fold(F.sha2(F.col("cluster").cast("string"), 256), 3))
    parts = []
    for k in range(3):
        model = IsotonicRegression(featuresCol="risk", labelCol="error").fit(rows.filter(F.col("fold") != k))
        parts.append(model.transform(rows.filter(F.col("fold") == k)))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("event_id", "fold", F.col("prediction").alias("expected_error"))
