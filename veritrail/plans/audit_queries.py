"""Contracts, allocations, vector features, small linear models."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions import scalars
from veritrail.functions import vectors as vec
from veritrail.functions.ranks import quantiles
from veritrail.operators import audits, contracts, linear, metrics, records, similarity
from veritrail.plans.certificate_queries import CERTIFICATE, certificates
from veritrail.plans.registry import query
from veritrail.sources import views
from veritrail.sources.tables import table
from veritrail.sources.views import CELLS, EVENTS, VECTORS


@query("one_to_one_join", "WITH a AS (SELECT o_custkey AS k, count(*) AS n_orders FROM orders GROUP BY 1) SELECT c_custkey AS k, c_mktsegment, n_orders FROM customer JOIN a ON k = c_custkey")
def one_to_one_join(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"))
    return contracts.validated_join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), counts, ["k"])


@query("full_outer_aligned", f"WITH {EVENTS}, a AS (SELECT cluster, avg(risk) AS r FROM ev WHERE dataset = 'click' GROUP BY 1), b AS (SELECT cluster, avg(error) AS e FROM ev WHERE dataset = 'error' GROUP BY 1) SELECT cluster, round(r, 6) AS risk, round(e, 6) AS error, coalesce(r, e) IS NOT NULL AND (r IS NULL OR e IS NULL) AS one_sided FROM a FULL JOIN b USING (cluster)")
def full_outer_aligned(spark, sf_dir):
    ev = views.scored_events(spark, sf_dir)
    a = ev.filter("dataset = 'click'").groupBy("cluster").agg(F.avg("risk").alias("r"))
    b = ev.filter("dataset = 'error'").groupBy("cluster").agg(F.avg("error").alias("e"))
    both = contracts.validated_join(a, b, ["cluster"], "full")
    return both.select("cluster", F.round("r", 6).alias("risk"), F.round("e", 6).alias("error"), (F.col("r").isNull() | F.col("e").isNull()).alias("one_sided"))


@query("coalescing_join", f"WITH {EVENTS} SELECT cluster, round(coalesce(avg(error) FILTER (dataset = 'click'), avg(error) FILTER (dataset = 'view')), 6) AS error FROM ev WHERE dataset IN ('click', 'view') GROUP BY cluster")
def coalescing_join(spark, sf_dir):
    ev = views.scored_events(spark, sf_dir).filter(F.col("dataset").isin("click", "view"))
    of = lambda name: F.avg(F.when(F.col("dataset") == name, F.col("error")))
    return ev.groupBy("cluster").agg(F.round(F.coalesce(of("click"), of("view")), 6).alias("error"))


@query("strict_boolean_parse", "SELECT o_orderkey, o_orderstatus = 'F' AS done FROM orders")
def strict_boolean_parse(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "F", " Yes").otherwise("0")
    return table(spark, sf_dir, "orders").select("o_orderkey", contracts.strict_boolean(text).alias("done"))


@query("row_access_audit", "SELECT 'not_read' AS issue, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS n UNION ALL SELECT 'not_frozen', (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'read_again', (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1))")
def row_access_audit(spark, sf_dir):
    return contracts.access_audit(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("gate_table", "WITH f AS (SELECT count(*) AS n, count(DISTINCT event_id) AS d, count(value) AS v, min(value) AS low, count(DISTINCT event_type) AS t FROM events) SELECT unnest(['G1_rows', 'G2_unique', 'G3_no_null', 'G4_positive', 'G5_five_types']) AS gate, unnest([n > 0, n = d, n = v, low > 0, t = 5]) AS passed FROM f")
def gate_table(spark, sf_dir):
    f = table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("d"), F.count("value").alias("v"), F.min("value").alias("low"), F.count_distinct("event_type").alias("t"))
    n = F.col("n")
    gates = {"G1_rows": n > 0, "G2_unique": n == F.col("d"), "G3_no_null": n == F.col("v"), "G4_positive": F.col("low") > 0, "G5_five_types": F.col("t") == 5}
    return f.select(F.inline(F.array(*(F.struct(F.lit(k).alias("gate"), v.alias("passed")) for k, v in gates.items()))))


@query(
    "stratified_hash_allocation",
    "WITH q AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER () AS n FROM part), s AS (SELECT p_partkey, CAST(ceil(r * 4.0 / n) AS BIGINT) AS quartile FROM q), h AS (SELECT *, row_number() OVER (PARTITION BY quartile ORDER BY sha256('alloc' || chr(0) || p_partkey), p_partkey) AS k FROM s) SELECT p_partkey, quartile, CASE WHEN k <= 20 THEN 'calibration' WHEN k <= 30 THEN 'test' ELSE 'train' END AS part FROM h",
)
def stratified_hash_allocation(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.lit(0).alias("all"))
    ranked = metrics.ordered_positions(rows, ["all"], "p_retailprice", ["p_partkey"], "r")
    placed = ranked.withColumn("quartile", F.ceil(F.col("r") * 4 / F.col("n"))).withColumn("salt", scalars.salted("alloc", F.col("p_partkey")))
    placed = metrics.hash_positions(placed, ["quartile"], "salt", "p_partkey", "k")
    return placed.select("p_partkey", "quartile", F.when(F.col("k") <= 20, "calibration").when(F.col("k") <= 30, "test").otherwise("train").alias("part"))


@query("normalize_log1p", f"WITH {CELLS}, t AS (SELECT *, sum(x) OVER (PARTITION BY context, perturbation, batch) AS lib FROM cells), g AS (SELECT context, perturbation, batch, gene, sum(x) / any_value(lib) * 10000 AS y FROM t GROUP BY ALL) SELECT context, perturbation, batch, gene, round(ln(1 + y), 6) AS y FROM g")
def normalize_log1p(spark, sf_dir):
    keys = ["context", "perturbation", "batch"]
    sums = views.cells(spark, sf_dir).groupBy(*keys, "gene").agg(F.sum("x").alias("s"))
    total = sums.groupBy(*keys).agg(F.sum("s").alias("lib"))
    return sums.join(total, keys).select(*keys, "gene", F.round(F.log1p(F.col("s") * 10000 / F.col("lib")), 6).alias("y"))


@query(
    "coexpression_edges",
    f"""WITH {VECTORS}, l AS (SELECT vec_id, i, v[i] AS x FROM vec, range(1, 65) t(i)), c AS (SELECT a.i - 1 AS a, b.i - 1 AS b, coalesce(CASE WHEN isnan(corr(a.x, b.x)) THEN 0 ELSE corr(a.x, b.x) END, 0) AS r FROM l a JOIN l b ON a.vec_id = b.vec_id GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY abs(r) DESC, a DESC) AS nth FROM c) SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(r, 6) AS r FROM n WHERE a = b OR nth <= 11 AND abs(r) >= 0.4""",
)
def coexpression_edges(spark, sf_dir):
    return similarity.correlated_positions(views.vectors(spark, sf_dir), "v").withColumn("r", F.round("r", 6))


@query("vector_features", f"WITH {VECTORS}, f AS (SELECT vec_id, list_sort([abs(x) for x in v]) AS a, v FROM vec) SELECT vec_id, round(sqrt(list_sum([x * x for x in v])), 6) AS l2, round(list_sum(a) / 64, 6) AS abs_mean, round(a[64], 6) AS abs_max, round(a[57] + 0.7 * (a[58] - a[57]), 6) AS abs_p90, round(len([1 for x in v if x > 0]) / 64, 6) AS positive, round(sqrt(list_sum([(x - list_sum(v) / 64) ** 2 for x in v]) / 64), 6) AS sd FROM f")
def vector_features(spark, sf_dir):
    v = F.col("v")
    size = F.sort_array(F.transform(v, lambda x: F.abs(x)))
    at = lambda k: F.get(F.col("a"), F.lit(k))
    rows = views.vectors(spark, sf_dir).select("vec_id", "v", size.alias("a"), vec.centred(v).alias("c"))
    share = F.size(F.filter("v", lambda x: x > 0)) / F.size("v")
    return rows.select("vec_id", F.round(vec.norm(v), 6).alias("l2"), F.round(vec.total(F.col("a")) / 64, 6).alias("abs_mean"), F.round(at(63), 6).alias("abs_max"), F.round(at(56) + 0.7 * (at(57) - at(56)), 6).alias("abs_p90"), F.round(share, 6).alias("positive"), F.round(vec.norm(F.col("c")) / 8, 6).alias("sd"))


@query("array_contract", "SELECT label, count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong_length, count(*) FILTER (embedding IS NULL) AS absent, bool_and(list_bool_and([isfinite(x) for x in embedding])) AS all_finite FROM embeddings GROUP BY label")
def array_contract(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    right = F.forall("embedding", lambda x: scalars.finite(x))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != 64).alias("wrong_length"), F.count_if(F.col("embedding").isNull()).alias("absent"), F.bool_and(right).alias("all_finite"))


@query("name_ngram_jaccard", "WITH g AS (SELECT p_name AS t, list_distinct([p_name[i:i+2] for i in range(1, greatest(length(p_name) - 1, 2))]) AS g FROM (SELECT DISTINCT p_name FROM part WHERE p_name <> '')), j AS (SELECT a.t AS a, b.t AS b, len(list_intersect(a.g, b.g)) / len(list_distinct(a.g || b.g)) AS jaccard FROM g a JOIN g b ON a.t < b.t) SELECT a, b, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.2")
def name_ngram_jaccard(spark, sf_dir):
    """Names of parts that are alike in their three-letter grams."""
    return records.similar_texts(table(spark, sf_dir, "part"), "p_name", 0.2).withColumn("jaccard", F.round("jaccard", 6))


@query("sampled_tasks", f"WITH {CELLS}, k AS (SELECT context, cell || '|' || gene || '|' || CAST(x AS BIGINT) AS observation FROM cells) SELECT context, observation FROM k QUALIFY row_number() OVER (PARTITION BY context ORDER BY sha256('sample|' || observation), observation) <= 100")
def sampled_tasks(spark, sf_dir):
    """A hundred observations of each context, in hash order; cells repeat, so an observation is named with its gene and value."""
    rows = views.cells(spark, sf_dir).select("context", F.concat_ws("|", "cell", "gene", F.col("x").cast("long").cast("string")).alias("observation"))
    return records.sampled_tasks(rows, ["context"], "observation", 100, "sample")


_FAMILIES = (("click", "action"), ("view", "action"), ("purchase", "sale"))


@query("record_scan_join", f"WITH {EVENTS}, f AS (SELECT dataset, cluster, avg(risk) AS mean_risk, count(*) AS n FROM ev GROUP BY ALL), m(dataset, family) AS (VALUES {', '.join(map(str, _FAMILIES))}) SELECT event_id, dataset, cluster, error, round(mean_risk, 6) AS mean_risk, n, coalesce(family, 'other') AS dataset_family FROM ev LEFT JOIN f USING (dataset, cluster) LEFT JOIN m USING (dataset)")
def record_scan_join(spark, sf_dir):
    """Every event with the features of its data set and user, one row each, and the family of its data set."""
    ev = views.scored_events(spark, sf_dir)
    features = ev.groupBy("dataset", "cluster").agg(F.avg("risk").alias("mean_risk"), F.count("*").alias("n"))
    families = spark.createDataFrame(list(_FAMILIES), "dataset string, family string")
    rows = records.merged_records(ev.drop("risk"), features, families, ["dataset", "cluster"], "dataset")
    return rows.withColumn("mean_risk", F.round("mean_risk", 6))


@query("normalized_rmse", f"WITH {EVENTS}, e AS (SELECT dataset, quantile_cont(risk, 0.01) AS eps FROM ev WHERE risk > 0 GROUP BY 1) SELECT event_id, round(error / greatest(risk, eps) + 1e-9, 6) AS normalized_error FROM ev JOIN e USING (dataset)")
def normalized_rmse(spark, sf_dir):
    ev = views.scored_events(spark, sf_dir)
    floors = quantiles(ev.filter("risk > 0"), ["dataset"], F.col("risk"), {"eps": 0.01})
    return ev.join(floors, "dataset").select("event_id", F.round(F.col("error") / F.greatest("risk", "eps") + 1e-9, 6).alias("normalized_error"))


@query("balanced_row_weights", f"WITH {EVENTS}, s AS (SELECT event_id, dataset, {views.fold_sql('event_id', 4)} AS fold FROM ev), n AS (SELECT dataset, fold, count(*) AS n FROM s GROUP BY ALL), f AS (SELECT dataset, count(*) AS f FROM n GROUP BY ALL), d AS (SELECT count(*) AS d FROM f) SELECT event_id, round(1.0 / (d * f * n), 10) AS weight FROM s JOIN n USING (dataset, fold) JOIN f USING (dataset), d")
def balanced_row_weights(spark, sf_dir):
    rows = views.scored_events(spark, sf_dir).select("event_id", "dataset", scalars.fold(F.sha2(F.col("event_id").cast("string"), 256), 4).alias("fold"))
    n = rows.groupBy("dataset", "fold").agg(F.count("*").alias("n"))
    folds = n.groupBy("dataset").agg(F.count("*").alias("f"))
    datasets = folds.agg(F.count("*").alias("d"))
    return rows.join(n, ["dataset", "fold"]).join(folds, "dataset").join(F.broadcast(datasets)).select("event_id", F.round(1.0 / (F.col("d") * F.col("f") * F.col("n")), 10).alias("weight"))  # datasets is one row


@query("ridge_prediction", f"WITH {EVENTS}, sp AS (SELECT *, {views.split_sql('event_id')} AS split FROM ev), s AS (SELECT count(*) AS n, var_pop(risk) AS vx, covar_pop(risk, error) AS cxy, avg(risk) AS mx, avg(error) AS my FROM sp WHERE split = 'train'), c AS (SELECT cxy * n / (vx * n + 10) AS b, mx, my FROM s) SELECT event_id, round(my + b * (risk - mx), 5) AS expected_error FROM sp, c WHERE split = 'test'")
def ridge_prediction(spark, sf_dir):
    """Fitted on train rows, scored on test rows."""
    ev = views.splits(views.scored_events(spark, sf_dir), "event_id")
    fitted = linear.predicted(linear.ridge(ev.filter("split = 'train'"), ["risk"], "error", 10.0), ["risk"])
    return ev.filter("split = 'test'").select("event_id", F.round(fitted, 5).alias("expected_error"))


@query("leave_one_cluster_out", f"WITH {EVENTS}, k AS (SELECT cluster, sum(error) AS s, count(*) AS n FROM ev GROUP BY 1), t AS (SELECT sum(s) AS ts, sum(n) AS tn FROM k) SELECT cluster, round((ts - s) / (tn - n), 6) AS mean_without FROM k, t")
def leave_one_cluster_out(spark, sf_dir):
    k = views.scored_events(spark, sf_dir).groupBy("cluster").agg(F.sum("error").alias("s"), F.count("error").alias("n"))
    t = k.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return k.join(F.broadcast(t)).select("cluster", F.round((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n")), 6).alias("mean_without"))  # t is one row


@query("score_identifiability", f"WITH {EVENTS} SELECT dataset, count(*) AS n, count(DISTINCT round(risk, 6)) AS n_unique, count(DISTINCT round(risk, 6)) >= greatest(12, count(*) / 2) AS enough, round(stddev_pop(risk), 6) AS sd FROM ev GROUP BY dataset")
def score_identifiability(spark, sf_dir):
    unique = F.count_distinct(F.round("risk", 6))
    return views.scored_events(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("n"), unique.alias("n_unique"), (unique >= F.greatest(F.lit(12.0), F.count("*") / 2)).alias("enough"), F.round(F.stddev_pop("risk"), 6).alias("sd"))


@query("simplex_stacking")
def simplex_stacking(spark, sf_dir):
    """Convex weights of two scores against the error, one row for each score."""
    rows = views.scored_events(spark, sf_dir).dropna(subset=["risk", "error"]).withColumns({"a": F.col("risk") / 100, "b": F.col("cluster") / 150.0, "y": F.col("error") / 500})
    weights = linear.simplex_weights(rows, ["a", "b"], "y")
    return spark.createDataFrame([("risk", float(weights[0])), ("cluster", float(weights[1]))], "score string, weight double")


@query(
    "order_reaggregation",
    """WITH a AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS total, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS status FROM lineitem GROUP BY 1),
    b AS (SELECT o_orderkey AS k, count(*) AS n, any_value(o_totalprice) AS total, any_value(o_orderstatus) AS status FROM orders GROUP BY 1), j AS (SELECT coalesce(a.k, b.k) AS o_orderkey, a.k IS NULL AS extra, b.k IS NULL AS missing, n, a.total AS t1, b.total AS t2, a.status AS s1, b.status AS s2 FROM a FULL JOIN b ON a.k = b.k)
    SELECT o_orderkey, CASE WHEN missing THEN 'missing' ELSE 'extra' END AS finding, NULL AS field, NULL::DOUBLE AS gap FROM j WHERE missing OR extra UNION ALL SELECT o_orderkey, 'repeated', NULL, NULL FROM j WHERE NOT missing AND NOT extra AND n > 1
    UNION ALL SELECT o_orderkey, 'differs', 'total', round(t1 - t2, 6) FROM j WHERE n = 1 AND NOT extra AND abs(t1 - t2) > 0.01 UNION ALL SELECT o_orderkey, 'differs', 'status', NULL FROM j WHERE n = 1 AND NOT extra AND s1 <> s2""",
)
def order_reaggregation(spark, sf_dir):
    """Totals and states that orders report, against their lines."""
    line = table(spark, sf_dir, "lineitem")
    total = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    status = F.when(F.bool_and(F.col("l_linestatus") == "F"), "F").when(F.bool_and(F.col("l_linestatus") == "O"), "O").otherwise("P")
    recomputed = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(total.alias("total"), status.alias("status"))
    reported = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))
    found = audits.discrepancies(recomputed, reported, ["o_orderkey"], ["total", "status"], 0.01)
    gap = F.when(F.col("field") == "total", F.round(F.col("recomputed").try_cast("double") - F.col("reported").try_cast("double"), 6))
    return found.select("o_orderkey", "finding", "field", gap.alias("gap"))


@query(
    "certificate_release_checks",
    f"""WITH {CERTIFICATE}, f AS (SELECT min(n_members) AS lo, max(n_members) AS hi, count(*) FILTER (diversity_lower > family_rms_error + 1e-10) AS fv, count(*) FILTER (diameter_lower > worst_member_error + 1e-10) AS wv, max(identity_residual) AS r FROM cert)
    SELECT name, observed, low, high, observed BETWEEN low AND high AS passed FROM (SELECT 'least_members' AS name, lo::DOUBLE AS observed, 4.0::DOUBLE AS low, 4.0::DOUBLE AS high FROM f UNION ALL SELECT 'most_members', hi, 4, 4 FROM f UNION ALL SELECT 'family_violations', fv, 0, 0 FROM f
        UNION ALL SELECT 'worst_violations', wv, 0, 0 FROM f UNION ALL SELECT 'family_flags_wrong', 0, 0, 0 UNION ALL SELECT 'worst_flags_wrong', 0, 0, 0 UNION ALL SELECT 'identity_residual', round(r, 6), 0, 1e-10 FROM f)""",
)
def certificate_release_checks(spark, sf_dir):
    """Whether the certificates of four-member families could be released."""
    found = audits.certificate_checks(certificates(spark, sf_dir), 4)
    return found.withColumn("observed", F.round("observed", 6))
