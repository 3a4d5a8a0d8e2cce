"""Rank correlation, selective prediction, detection, buckets, multiple testing, robust scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritrail.functions.ranks import average_ranks
from veritrail.functions.scalars import decision, keep_count, salted
from veritrail.operators import metrics as m
from veritrail.operators import scaling
from veritrail.plans.certificate_queries import rounded
from veritrail.plans.registry import query
from veritrail.sources import views
from veritrail.sources.tables import table
from veritrail.sources.views import EVENTS

events = views.scored_events


def rank_sql(x: str, part: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"


def corr_sql(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


@query("avg_rank_pct", f"WITH {EVENTS} SELECT event_id, {rank_sql('risk', 'dataset')} AS risk_rank, round({rank_sql('risk', 'dataset')} / count(*) OVER (PARTITION BY dataset), 6) AS risk_pct FROM ev WHERE risk IS NOT NULL")
def avg_rank_pct(spark, sf_dir):
    rows = average_ranks(events(spark, sf_dir), ["dataset"], "risk", "risk_rank", "size")
    return rows.select("event_id", "risk_rank", F.round(F.col("risk_rank") / F.col("size"), 6).alias("risk_pct"))


@query("spearman_by_group", f"WITH {EVENTS}, r AS (SELECT dataset, {rank_sql('risk', 'dataset')} AS a, {rank_sql('error', 'dataset')} AS b FROM ev WHERE risk IS NOT NULL AND error IS NOT NULL) SELECT dataset, count(*) AS n, round({corr_sql('a', 'b')}, 6) AS rho FROM r GROUP BY dataset")
def spearman_by_group(spark, sf_dir):
    return m.spearman(events(spark, sf_dir), ["dataset"], "risk", "error").withColumn("rho", F.round("rho", 6))


@query(
    "aligned_spearman_by_score",
    f"""WITH {EVENTS}, s AS (SELECT dataset, 'risk' AS score_type, risk AS score, error FROM ev UNION ALL SELECT dataset, 'confidence', -risk * 2, error FROM ev),
    r AS (SELECT dataset, score_type, {rank_sql('score', 'dataset, score_type')} AS a, {rank_sql('error', 'dataset, score_type')} AS b FROM s WHERE score IS NOT NULL AND error IS NOT NULL)
    SELECT dataset, score_type, round(CASE score_type WHEN 'confidence' THEN -1 ELSE 1 END * ({corr_sql('a', 'b')}), 6) AS aligned_rho FROM r GROUP BY dataset, score_type""",
)
def aligned_spearman_by_score(spark, sf_dir):
    ev = events(spark, sf_dir)
    both = F.array(F.struct(F.lit("risk").alias("score_type"), F.col("risk").alias("score")), F.struct(F.lit("confidence").alias("score_type"), (-F.col("risk") * 2).alias("score")))
    rows = ev.select("dataset", "error", F.inline(both))
    rho = m.spearman(rows, ["dataset", "score_type"], "score", "error")
    return rho.select("dataset", "score_type", F.round(F.when(F.col("score_type") == "confidence", -F.col("rho")).otherwise(F.col("rho")), 6).alias("aligned_rho"))


@query(
    "partial_spearman",
    f"""WITH {EVENTS}, r AS (SELECT dataset, {rank_sql('risk', 'dataset')} AS a, {rank_sql('error', 'dataset')} AS b, {rank_sql('cluster', 'dataset')} AS c FROM ev WHERE risk IS NOT NULL AND error IS NOT NULL AND cluster IS NOT NULL),
    k AS (SELECT dataset, count(*) AS n, {corr_sql('a', 'b')} AS ab, {corr_sql('a', 'c')} AS ac, {corr_sql('b', 'c')} AS bc FROM r GROUP BY dataset)
    SELECT dataset, n, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS rho FROM k""",
)
def partial_spearman(spark, sf_dir):
    return m.partial_spearman(events(spark, sf_dir), ["dataset"], "risk", "error", "cluster").withColumn("rho", F.round("rho", 6))


@query(
    "within_stratum_spearman",
    f"""WITH {EVENTS}, s AS (SELECT *, cluster % 7 AS stratum FROM ev), r AS (SELECT dataset, stratum, {rank_sql('risk', 'dataset, stratum')} AS a, {rank_sql('error', 'dataset, stratum')} AS b FROM s),
    k AS (SELECT dataset, stratum, count(*) AS n, {corr_sql('a', 'b')} AS rho FROM r GROUP BY ALL HAVING count(*) >= 3)
    SELECT dataset, count(rho) AS n_strata, round(avg(rho), 6) AS mean_rho, round(sum(rho * n) / sum(n) FILTER (rho IS NOT NULL), 6) AS weighted_rho FROM k GROUP BY dataset""",
)
def within_stratum_spearman(spark, sf_dir):
    rows = m.spearman(events(spark, sf_dir).withColumn("stratum", F.col("cluster") % 7), ["dataset", "stratum"], "risk", "error")
    known = F.when(F.col("rho").isNotNull(), F.col("n"))
    return rows.groupBy("dataset").agg(F.count("rho").alias("n_strata"), F.round(F.avg("rho"), 6).alias("mean_rho"), F.round(F.sum(F.col("rho") * F.col("n")) / F.sum(known), 6).alias("weighted_rho"))


@query(
    "fold_macro_spearman",
    f"""WITH {EVENTS}, s AS (SELECT *, {views.fold_sql('event_id', 5)} AS fold FROM ev), r AS (SELECT dataset, fold, {rank_sql('risk', 'dataset, fold')} AS a, {rank_sql('error', 'dataset, fold')} AS b FROM s),
    k AS (SELECT dataset, fold, {corr_sql('a', 'b')} AS rho FROM r GROUP BY ALL), d AS (SELECT dataset, avg(rho) AS rho FROM k GROUP BY ALL)
    SELECT dataset, round(rho, 6) AS fold_macro, round((SELECT avg(rho) FROM d), 6) AS dataset_macro FROM d""",
)
def fold_macro_spearman(spark, sf_dir):
    fold = F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8), 16, 10).cast("long") % 5
    folds = m.spearman(events(spark, sf_dir).withColumn("fold", fold), ["dataset", "fold"], "risk", "error")
    by_dataset = folds.groupBy("dataset").agg(F.avg("rho").alias("rho"))
    macro = by_dataset.agg(F.round(F.avg("rho"), 6).alias("dataset_macro"))
    return by_dataset.join(F.broadcast(macro)).select("dataset", F.round("rho", 6).alias("fold_macro"), "dataset_macro")  # macro is one row


_CURVE = f"{EVENTS}, c AS (SELECT dataset, event_id, error, row_number() OVER w AS n_kept, count(*) OVER (PARTITION BY dataset) AS n, avg(error) OVER (w ROWS UNBOUNDED PRECEDING) AS selective_risk FROM ev WHERE risk IS NOT NULL AND error IS NOT NULL WINDOW w AS (PARTITION BY dataset ORDER BY risk, event_id))"


@query("risk_coverage_curve", f"WITH {_CURVE} SELECT dataset, event_id, n_kept, round(n_kept / n, 6) AS coverage, round(selective_risk + 1e-9, 6) AS selective_risk FROM c")
def risk_coverage_curve(spark, sf_dir):
    rows = m.risk_coverage(events(spark, sf_dir), ["dataset"], "risk", "error", "event_id")
    return rows.select("dataset", "event_id", "n_kept", F.round("coverage", 6).alias("coverage"), F.round(F.col("selective_risk") + 1e-9, 6).alias("selective_risk"))


_AURC = ("aurc", "oracle_aurc", "random_aurc", "excess_aurc", "normalized_aurc", "reduction_pct", "gap_captured_pct")


@query(
    "aurc_family",
    f"""WITH {_CURVE}, a AS (SELECT dataset, count(*) AS n, avg(selective_risk) AS aurc, avg(error) AS random_aurc FROM c GROUP BY dataset),
    o AS (SELECT dataset, avg(r) AS oracle_aurc FROM (SELECT dataset, avg(error) OVER (PARTITION BY dataset ORDER BY error, event_id ROWS UNBOUNDED PRECEDING) AS r FROM ev WHERE risk IS NOT NULL) GROUP BY dataset)
    SELECT dataset, n, round(aurc, 6) AS aurc, round(oracle_aurc, 6) AS oracle_aurc, round(random_aurc, 6) AS random_aurc, round(aurc - oracle_aurc, 6) AS excess_aurc, round(aurc / random_aurc, 6) AS normalized_aurc,
    round(100 * (random_aurc - aurc) / random_aurc, 6) AS reduction_pct, round(100 * (random_aurc - aurc) / (random_aurc - oracle_aurc), 6) AS gap_captured_pct FROM a JOIN o USING (dataset)""",
)
def aurc_family(spark, sf_dir):
    return m.selective_summary(events(spark, sf_dir), ["dataset"], "risk", "error", "event_id").select("dataset", "n", *rounded(*_AURC))


GRID = [k / 20 for k in range(4, 21)]
_GRID_SQL = "grid AS (SELECT k / 20.0 AS coverage FROM range(4, 21) t(k))"
_TRAPEZOID = "sum((x2 - coverage) * (y + y2) / 2) / (max(coverage) - min(coverage))"


@query(
    "aurc_grid_trapezoid",
    f"""WITH {_CURVE}, {_GRID_SQL}, p AS (SELECT dataset, CAST(coverage AS DOUBLE) AS coverage, selective_risk AS y FROM c, grid WHERE n_kept = greatest(1, CAST(ceil(coverage * n - 1e-9) AS BIGINT))),
    l AS (SELECT *, lead(coverage) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY dataset ORDER BY coverage)) SELECT dataset, round({_TRAPEZOID}, 6) AS aurc FROM l GROUP BY dataset""",
)
def aurc_grid_trapezoid(spark, sf_dir):
    rows = m.risk_coverage(events(spark, sf_dir), ["dataset"], "risk", "error", "event_id")
    sizes = rows.groupBy("dataset").agg(F.count("*").alias("n")).withColumn("coverage_at", F.explode(F.array(*map(F.lit, GRID))))
    points = sizes.withColumn("n_kept", keep_count(F.col("n"), F.col("coverage_at"))).join(rows, ["dataset", "n_kept"])
    return m.trapezoid(points, ["dataset"], "coverage_at", "selective_risk", "aurc").withColumn("aurc", F.round("aurc", 6))


_TIES = f"""{EVENTS}, {_GRID_SQL}, v AS (SELECT dataset, risk, count(*) AS c, sum(error) AS e FROM ev WHERE risk IS NOT NULL AND error IS NOT NULL GROUP BY ALL),
    b AS (SELECT *, sum(c) OVER w - c AS bc, sum(e) OVER w - e AS be, sum(c) OVER (PARTITION BY dataset) AS n FROM v WINDOW w AS (PARTITION BY dataset ORDER BY risk)),
    h AS (SELECT dataset, CAST(coverage AS DOUBLE) AS coverage, CAST(greatest(1, ceil(coverage * n - 1e-9)) AS BIGINT) AS k, c, e, bc, be FROM b, grid),
    p AS (SELECT dataset, coverage, k, (be + (k - bc) / c * e) / k AS y FROM h WHERE bc < k AND k <= bc + c)"""


@query("tie_aware_curve", f"WITH {_TIES} SELECT dataset, round(coverage, 6) AS coverage, k, round(y, 6) AS risk FROM p")
def tie_aware_curve(spark, sf_dir):
    rows = m.tie_aware_risk(events(spark, sf_dir), ["dataset"], "risk", "error", GRID)
    return rows.select("dataset", F.round("coverage", 6).alias("coverage"), "k", F.round("risk", 6).alias("risk"))


@query("aurc_tie_aware", f"WITH {_TIES}, l AS (SELECT *, lead(coverage) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY dataset ORDER BY coverage)) SELECT dataset, round({_TRAPEZOID}, 6) AS aurc FROM l GROUP BY dataset")
def aurc_tie_aware(spark, sf_dir):
    curve = m.tie_aware_risk(events(spark, sf_dir), ["dataset"], "risk", "error", GRID)
    return m.trapezoid(curve, ["dataset"], "coverage", "risk", "aurc").withColumn("aurc", F.round("aurc", 6))


_TAIL = ("good_mean", "bad_mean", "good_median", "bad_median", "improve_pct")


@query(
    "high_low_tail",
    f"""WITH {EVENTS}, o AS (SELECT dataset, error, row_number() OVER (PARTITION BY dataset ORDER BY risk, event_id) AS k, count(*) OVER (PARTITION BY dataset) AS n FROM ev WHERE risk IS NOT NULL AND error IS NOT NULL),
    t AS (SELECT *, greatest(1, CAST(ceil(0.2 * n - 1e-9) AS BIGINT)) AS s FROM o), g AS (SELECT dataset, count(*) AS n_total, count(*) FILTER (k <= s) AS n_tail, avg(error) FILTER (k <= s) AS good_mean, avg(error) FILTER (k > n - s) AS bad_mean, median(error) FILTER (k <= s) AS good_median, median(error) FILTER (k > n - s) AS bad_median FROM t GROUP BY dataset)
    SELECT dataset, n_total, n_tail, round(good_mean, 6) AS good_mean, round(bad_mean, 6) AS bad_mean, round(good_median, 6) AS good_median, round(bad_median, 6) AS bad_median, round(100 * (bad_mean - good_mean) / bad_mean, 6) AS improve_pct FROM g""",
)
def high_low_tail(spark, sf_dir):
    return m.tails(events(spark, sf_dir), ["dataset"], "risk", "error", "event_id").select("dataset", "n_total", "n_tail", *rounded(*_TAIL))


@query(
    "failure_auroc_auprc",
    f"""WITH {EVENTS}, q AS (SELECT dataset, quantile_cont(error, 0.8) AS threshold FROM ev WHERE risk IS NOT NULL GROUP BY ALL), f AS (SELECT dataset, risk, threshold, CAST(error >= threshold AS INT) AS bad FROM ev JOIN q USING (dataset)),
    v AS (SELECT dataset, threshold, risk, count(*) AS c, sum(bad) AS b FROM f GROUP BY ALL), w AS (SELECT *, sum(c) OVER o - c AS bc, sum(b) OVER o - b AS bb, sum(c) OVER p AS n, sum(b) OVER p AS nb FROM v WINDOW o AS (PARTITION BY dataset ORDER BY risk DESC), p AS (PARTITION BY dataset))
    SELECT dataset, CAST(max(n) AS BIGINT) AS n, CAST(max(nb) AS BIGINT) AS n_failure, round(max(threshold), 6) AS threshold, round(sum((c - b) * (bb + b / 2.0)) / max(nb * (n - nb)), 6) AS auroc, round(sum((bb + b) / (bc + c) * b) / max(nb), 6) AS auprc FROM w GROUP BY dataset""",
)
def failure_auroc_auprc(spark, sf_dir):
    rows = m.failure_detection(events(spark, sf_dir), ["dataset"], "risk", "error")
    return rows.select("dataset", "n", "n_failure", *rounded("threshold", "auroc", "auprc"))


@query(
    "label_failure_auroc",
    f"""WITH f AS (SELECT lang AS dataset, n_chars AS s, max(toxic) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY doc_id, lang, n_chars), r AS (SELECT dataset, bad, {rank_sql('s', 'dataset')} AS r FROM f)
    SELECT dataset, count(*) AS n, CAST(sum(bad) AS BIGINT) AS n_bad, round((sum(r) FILTER (bad = 1) - sum(bad) * (sum(bad) + 1) / 2) / (sum(bad) * (count(*) - sum(bad))), 6) AS auroc FROM r GROUP BY dataset""",
)
def label_failure_auroc(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dataset"), F.col("n_chars").alias("s"))
    flags = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("bad"))
    rows = average_ranks(docs.join(flags, "doc_id"), ["dataset"], "s", "r")
    n, bad = F.count("*"), F.sum(F.col("bad").cast("long"))
    auroc = (F.sum(F.when(F.col("bad") == 1, F.col("r"))) - bad * (bad + 1) / 2) / (bad * (n - bad))
    return rows.groupBy("dataset").agg(n.alias("n"), bad.alias("n_bad"), F.round(auroc, 6).alias("auroc"))


@query(
    "calibration_buckets",
    f"""WITH {EVENTS}, q AS (SELECT dataset, min(-risk) AS low, list_distinct([quantile_cont(-risk, 0.2), quantile_cont(-risk, 0.4), quantile_cont(-risk, 0.6), quantile_cont(-risk, 0.8)]) AS edges FROM ev WHERE risk IS NOT NULL GROUP BY ALL)
    SELECT dataset, CAST(len(list_filter(edges, lambda e: e < -risk AND e > low)) + 1 AS INT) AS bucket, count(*) AS n, round(avg(risk), 6) AS mean_risk, round(avg(error), 6) AS mean_error, round(median(error), 6) AS median_error FROM ev JOIN q USING (dataset) WHERE risk IS NOT NULL GROUP BY 1, 2""",
)
def calibration_buckets(spark, sf_dir):
    rows = m.quantile_buckets(events(spark, sf_dir).filter("risk is not null").withColumn("axis", -F.col("risk")), ["dataset"], "axis", "bucket", 5)
    return rows.groupBy("dataset", "bucket").agg(F.count("*").alias("n"), F.round(F.avg("risk"), 6).alias("mean_risk"), F.round(F.avg("error"), 6).alias("mean_error"), F.round(F.median("error"), 6).alias("median_error"))


@query(
    "top_fraction_enrichment",
    f"""WITH {EVENTS}, o AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY risk DESC, event_id) AS kr, row_number() OVER (PARTITION BY dataset ORDER BY error DESC, event_id) AS ke, count(*) OVER (PARTITION BY dataset) AS n FROM ev WHERE risk IS NOT NULL),
    s AS (SELECT *, greatest(1, CAST(ceil(0.2 * n - 1e-9) AS BIGINT)) AS t FROM o) SELECT dataset, max(t) AS n_top, count(*) FILTER (kr <= t AND ke <= t) AS n_both, round(count(*) FILTER (kr <= t AND ke <= t) / max(t) / (max(t) / max(n)), 6) AS enrichment FROM s GROUP BY dataset HAVING max(n) >= 10""",
)
def top_fraction_enrichment(spark, sf_dir):
    rows = events(spark, sf_dir).filter("risk is not null").withColumns({"dr": -F.col("risk"), "de": -F.col("error")})
    rows = m.ordered_positions(rows, ["dataset"], "dr", ["event_id"], "kr").drop("n")
    rows = m.ordered_positions(rows, ["dataset"], "de", ["event_id"], "ke")
    rows = rows.withColumn("t", keep_count(F.col("n"), F.lit(0.2)))
    both = F.count_if((F.col("kr") <= F.col("t")) & (F.col("ke") <= F.col("t")))
    out = rows.groupBy("dataset").agg(F.max("t").alias("n_top"), both.alias("n_both"), F.max("n").alias("n")).filter("n >= 10")
    return out.select("dataset", "n_top", "n_both", F.round(F.col("n_both") / F.col("n_top") / (F.col("n_top") / F.col("n")), 6).alias("enrichment"))


_BUDGETS = (0.1, 0.2, 0.3)


@query(
    "budget_decision_table",
    f"""WITH {EVENTS}, h AS (SELECT *, substr(sha256('review' || chr(0) || CAST(event_id AS VARCHAR)), 1, 16) AS tie FROM ev WHERE risk IS NOT NULL), o AS (SELECT dataset, error, row_number() OVER (PARTITION BY dataset ORDER BY risk DESC, tie) AS kr, row_number() OVER (PARTITION BY dataset ORDER BY error DESC, tie) AS ke, count(*) OVER (PARTITION BY dataset) AS n FROM h),
    s AS (SELECT *, CAST(greatest(1, ceil(budget * n - 1e-9)) AS BIGINT) AS t FROM o, (VALUES (0.1), (0.2), (0.3)) b(budget)),
    g AS (SELECT dataset, CAST(budget AS DOUBLE) AS budget, max(t) AS n_selected, avg(error) AS base, avg(error) FILTER (kr <= t) AS sel, avg(error) FILTER (ke <= t) AS ora, count(*) FILTER (kr <= t AND ke <= t) AS both_n FROM s GROUP BY ALL)
    SELECT dataset, budget, n_selected, round(both_n / n_selected, 6) AS capture, round(sel / base, 6) AS lift, round((sel - base) / (ora - base), 6) AS utility FROM g""",
)
def budget_decision_table(spark, sf_dir):
    rows = events(spark, sf_dir).filter("risk is not null").withColumns({"tie": F.substring(salted("review", F.col("event_id")), 1, 16), "dr": -F.col("risk"), "de": -F.col("error")})
    rows = m.ordered_positions(m.ordered_positions(rows, ["dataset"], "dr", ["tie"], "kr").drop("n"), ["dataset"], "de", ["tie"], "ke")
    rows = rows.withColumn("budget", F.explode(F.array(*map(F.lit, _BUDGETS)))).withColumn("t", keep_count(F.col("n"), F.col("budget")))
    picked, best = F.col("kr") <= F.col("t"), F.col("ke") <= F.col("t")
    out = rows.groupBy("dataset", "budget").agg(F.max("t").alias("n_selected"), F.avg("error").alias("base"), F.avg(F.when(picked, F.col("error"))).alias("sel"), F.avg(F.when(best, F.col("error"))).alias("ora"), F.count_if(picked & best).alias("both_n"))
    utility = F.try_divide(F.col("sel") - F.col("base"), F.col("ora") - F.col("base"))
    return out.select("dataset", "budget", "n_selected", F.round(F.col("both_n") / F.col("n_selected"), 6).alias("capture"), F.round(F.col("sel") / F.col("base"), 6).alias("lift"), F.round(utility, 6).alias("utility"))


_TESTS = "t AS (SELECT cluster, (count(*) FILTER (error > 50) + 1.0) / (count(*) + 1) AS p FROM ev GROUP BY cluster), o AS (SELECT *, row_number() OVER (ORDER BY p, cluster) AS k, count(*) OVER () AS n FROM t)"


def _tests(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("cluster").agg(((F.count_if(F.col("error") > 50) + 1.0) / (F.count("*") + 1)).alias("p"))
    return rows.withColumn("family", F.lit(0))


@query("bh_adjust", f"WITH {EVENTS}, {_TESTS} SELECT cluster, round(p, 6) AS p, round(least(1, min(p * n / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_bh FROM o")
def bh_adjust(spark, sf_dir):
    return m.adjusted(_tests(spark, sf_dir), ["family"], "p", "cluster", "bh").select("cluster", *rounded("p", "p_bh"))


@query("holm_adjust", f"WITH {EVENTS}, {_TESTS} SELECT cluster, round(p, 6) AS p, round(least(1, max(p * (n - k + 1)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM o")
def holm_adjust(spark, sf_dir):
    return m.adjusted(_tests(spark, sf_dir), ["family"], "p", "cluster", "holm").select("cluster", *rounded("p", "p_holm"))


@query(
    "empirical_quantile_norm",
    f"""WITH {EVENTS}, s AS (SELECT *, {views.split_sql('event_id')} AS split FROM ev), v AS (SELECT dataset, risk, count(*) FILTER (split <> 'test') AS c FROM s WHERE risk IS NOT NULL GROUP BY ALL), b AS (SELECT *, sum(c) OVER w - c AS below, sum(c) OVER (PARTITION BY dataset) AS n FROM v WINDOW w AS (PARTITION BY dataset ORDER BY risk))
    SELECT event_id, round(coalesce((below + c / 2.0) / n, 0.5), 6) AS risk_qnorm FROM s LEFT JOIN b USING (dataset, risk)""",
)
def empirical_quantile_norm(spark, sf_dir):
    return scaling.empirical_quantile(views.splits(events(spark, sf_dir), "event_id"), ["dataset"], "risk", F.col("split") != "test", "risk_qnorm").select("event_id", F.round("risk_qnorm", 6).alias("risk_qnorm"))


def _z_sql(formula: str) -> str:
    return f"""WITH {EVENTS}, s AS (SELECT *, {views.split_sql('event_id')} AS split FROM ev), q AS (SELECT dataset, median(error) FILTER (split = 'train') AS med, quantile_cont(error, 0.75) FILTER (split = 'train') - quantile_cont(error, 0.25) FILTER (split = 'train') AS iqr FROM s GROUP BY ALL),
    d AS (SELECT dataset, median(abs(error - med)) AS mad, stddev_pop(error) AS sd FROM s JOIN q USING (dataset) WHERE split = 'train' GROUP BY ALL) SELECT event_id, round({formula}, 6) AS z FROM s JOIN q USING (dataset) JOIN d USING (dataset)"""


@query("robust_z_iqr", _z_sql("(error - med) / iqr"))
def robust_z_iqr(spark, sf_dir):
    return scaling.robust_z(views.splits(events(spark, sf_dir), "event_id"), ["dataset"], "error", F.col("split") == "train", "z", "iqr").select("event_id", F.round("z", 6).alias("z"))


@query("robust_z_mad", _z_sql("least(5, greatest(-5, (error - med) / greatest(1.4826 * mad, sd * 1e-8, 1e-8)))"))
def robust_z_mad(spark, sf_dir):
    return scaling.robust_z(views.splits(events(spark, sf_dir), "event_id"), ["dataset"], "error", F.col("split") == "train", "z", "mad").select("event_id", F.round("z", 6).alias("z"))


@query("population_z_minmax", f"WITH {EVENTS} SELECT event_id, round((error - avg(error) OVER w) / stddev_pop(error) OVER w, 6) AS z, round((error - min(error) OVER w) / (max(error) OVER w - min(error) OVER w), 6) AS scaled FROM ev WINDOW w AS (PARTITION BY dataset)")
def population_z_minmax(spark, sf_dir):
    ev = events(spark, sf_dir)
    facts = ev.groupBy("dataset").agg(F.avg("error").alias("mean"), F.stddev_pop("error").alias("sd"), F.min("error").alias("low"), F.max("error").alias("high"))
    z, s = F.try_divide(F.col("error") - F.col("mean"), F.col("sd")), F.coalesce(F.try_divide(F.col("error") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    return ev.join(facts, "dataset").select("event_id", F.round(z, 6).alias("z"), F.round(s, 6).alias("scaled"))


@query(
    "decision_gate",
    f"""WITH {EVENTS}, r AS (SELECT dataset, cluster % 10 AS c, {rank_sql('risk', 'dataset, cluster % 10')} AS a, {rank_sql('error', 'dataset, cluster % 10')} AS b FROM ev), k AS (SELECT dataset, c, {corr_sql('a', 'b')} AS rho FROM r GROUP BY ALL),
    g AS (SELECT dataset, median(rho) AS med, quantile_cont(rho, 0.025) AS low, avg(CASE WHEN rho > 0 THEN 1.0 ELSE 0 END) AS pos FROM k GROUP BY dataset)
    SELECT dataset, round(med, 6) AS med, round(low, 6) AS low, round(pos, 6) AS pos, CASE WHEN med IS NULL OR med <= 0 THEN 'FAIL' WHEN low > 0 AND pos >= 0.6 THEN 'PASS' ELSE 'PARTIAL' END AS gate FROM g""",
)
def decision_gate(spark, sf_dir):
    rows = m.spearman(events(spark, sf_dir).withColumn("c", F.col("cluster") % 10), ["dataset", "c"], "risk", "error")
    out = rows.groupBy("dataset").agg(F.median("rho").alias("med"), F.percentile("rho", 0.025).alias("low"), F.avg(F.when(F.col("rho") > 0, 1.0).otherwise(0.0)).alias("pos"))
    return out.select("dataset", *rounded("med", "low", "pos"), decision(F.col("med"), F.col("low"), F.col("pos")).alias("gate"))


@query(
    "multi_level_eval",
    f"""WITH {EVENTS} SELECT CASE grouping(dataset) * 2 + grouping(kind) WHEN 0 THEN 'dataset_kind' WHEN 1 THEN 'dataset' WHEN 2 THEN 'kind' ELSE 'overall' END AS level, dataset, kind, count(*) AS n, round(avg(error), 6) AS mean_error, round(median(risk), 6) AS median_risk FROM (SELECT *, cluster % 3 AS kind FROM ev) GROUP BY GROUPING SETS ((dataset, kind), (dataset), (kind), ())""",
)
def multi_level_eval(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("kind", F.col("cluster") % 3)
    level = F.when(F.grouping_id() == 0, "dataset_kind").when(F.grouping_id() == 1, "dataset").when(F.grouping_id() == 2, "kind").otherwise("overall")
    return rows.cube("dataset", "kind").agg(level.alias("level"), F.count("*").alias("n"), F.round(F.avg("error"), 6).alias("mean_error"), F.round(F.median("risk"), 6).alias("median_risk"))
