"""Eligibility, strata, labels, summaries over several levels, families and exact intervals of studies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from veritrail.functions import scalars
from veritrail.operators import certificates as cert
from veritrail.operators import contracts, resampling, small
from veritrail.operators import effects as fx
from veritrail.operators import metrics as m
from veritrail.plans.certificate_queries import CERTIFICATE, rounded
from veritrail.plans.metric_queries import corr_sql, rank_sql
from veritrail.plans.registry import query
from veritrail.sources import views
from veritrail.sources.tables import table
from veritrail.sources.views import CELLS, EVENTS, LONG

events = views.scored_events
#: Choices of columns for context and perturbation that the sets of data are audited under.
_AUDITS = {"segment": ("context", "perturbation"), "same": ("perturbation", "perturbation"), "condition": ("condition", "perturbation"), "no_context": (None, "perturbation"), "no_perturbation": ("context", None)}


def _eligibility_sql(audit: str, context: str | None, perturbation: str | None) -> str:
    c, p = context or "NULL::VARCHAR", perturbation or "NULL::VARCHAR"
    alike = f"{context == 'condition'} AND n_contexts >= 2 AND n_perturbations >= 2 AND abs(n_contexts - n_perturbations) <= greatest(2, floor(n_perturbations * 0.05))"
    return f"""SELECT '{audit}' AS audit, *, reasons = '' AND n_perturbations >= 2 AS eligible FROM (SELECT *, concat_ws(';', CASE WHEN {context is None} THEN 'no_context_col>=2' END, CASE WHEN {perturbation is None} THEN 'no_perturbation_col>=2' END, CASE WHEN {context is not None and context == perturbation} THEN 'context_equals_perturbation' END,
        CASE WHEN n_contexts < 2 THEN 'n_contexts<2' END, CASE WHEN {alike} THEN 'condition_perturbation_combinatorial_not_cross_context' END, CASE WHEN NOT has_control THEN 'no_control_in_perturbation_col' END, CASE WHEN n_eligible_pairs < 8 THEN 'n_eligible_pairs=' || n_eligible_pairs || '<8' END) AS reasons
        FROM (SELECT batch, count(DISTINCT c) AS n_contexts, count(DISTINCT p) AS n_perturbations, coalesce(bool_or(lower(trim(p)) = '{views.CONTROL.lower()}'), false) AS has_control, count(*) FILTER (c IS NOT NULL AND p IS NOT NULL AND n >= 6) AS n_eligible_pairs
        FROM (SELECT batch, {c} AS c, {p} AS p, count(*) AS n FROM rw GROUP BY ALL) GROUP BY batch))"""


@query("eligibility_reasons", f"WITH {CELLS}, rw AS (SELECT *, perturbation || '_' || (l % 2) AS condition FROM (SELECT *, length(cell) AS l FROM cells)) " + " UNION ALL ".join(_eligibility_sql(k, *v) for k, v in _AUDITS.items()))
def eligibility_reasons(spark, sf_dir):
    """Every batch as a set of data, audited under each choice of columns."""
    cells = views.cells(spark, sf_dir).withColumn("condition", F.concat_ws("_", "perturbation", (F.length("cell") % 2).cast("string")))
    parts = [contracts.eligibility(cells, ["batch"], c, p, (views.CONTROL,)).withColumn("audit", F.lit(audit)) for audit, (c, p) in _AUDITS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "support_feasibility",
    f"""WITH {CELLS}, p AS (SELECT context, perturbation, {views.split_sql("context || '|' || perturbation")} AS split FROM cells GROUP BY ALL), t AS (SELECT * FROM p WHERE split = 'train')
    SELECT context, perturbation, (SELECT count(*) FROM t WHERE t.perturbation = p.perturbation AND t.context <> p.context) AS n_sources, EXISTS (SELECT 1 FROM t WHERE t.context = p.context) AS context_seen, EXISTS (SELECT 1 FROM t WHERE t.perturbation = p.perturbation) AS perturbation_seen FROM p WHERE split = 'test'""",
)
def support_feasibility(spark, sf_dir):
    """Of each held-out pair, how many training contexts have its perturbation, and whether training has its context and its perturbation."""
    pairs = views.cells(spark, sf_dir).select("context", "perturbation").distinct().withColumn("pair", F.concat_ws("|", "context", "perturbation"))
    pairs = views.splits(pairs, "pair")
    train = pairs.filter("split = 'train'")
    contexts = train.groupBy("context").agg(F.count("*").alias("n_context"))
    sources = train.groupBy("perturbation").agg(F.count("*").alias("n_sources"))  # a held-out pair is not among them
    out = pairs.filter("split = 'test'").join(contexts, "context", "left").join(sources, "perturbation", "left")
    n = F.coalesce("n_sources", F.lit(0))
    return out.select("context", "perturbation", n.alias("n_sources"), F.col("n_context").isNotNull().alias("context_seen"), (n > 0).alias("perturbation_seen"))


@query(
    "magnitude_strata",
    f"WITH {EVENTS}, r AS (SELECT event_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY risk, event_id) AS pos, count(*) OVER (PARTITION BY dataset) AS n FROM ev WHERE risk IS NOT NULL) SELECT event_id, dataset, CAST(greatest(1, ceil((pos - 1) * 5.0 / greatest(n - 1, 1) - 1e-9)) AS INT) AS stratum FROM r",
)
def magnitude_strata(spark, sf_dir):
    """Fifths of the first-come ranks, by their interpolated edges."""
    rows = m.ordered_positions(events(spark, sf_dir).filter("risk is not null"), ["dataset"], "risk", ["event_id"], "at")
    fifth = F.ceil((F.col("at") - 1) * 5.0 / F.greatest(F.col("n") - 1, F.lit(1)) - F.lit(1e-9))
    return rows.select("event_id", "dataset", F.greatest(F.lit(1), fifth).cast("int").alias("stratum"))


@query(
    "within_magnitude_rho",
    f"""WITH {CERTIFICATE}, mg AS (SELECT task, sqrt(sum(c * c)) AS magnitude FROM cen GROUP BY task), k AS (SELECT diversity_lower AS risk, family_rms_error AS error, magnitude, row_number() OVER (ORDER BY magnitude, task) AS pos, count(*) OVER () AS n FROM cert JOIN mg USING (task)),
    b AS (SELECT *, CAST(greatest(1, ceil((pos - 1) * 4.0 / greatest(n - 1, 1) - 1e-9)) AS INT) - 1 AS bin FROM k WHERE n >= 16), r AS (SELECT *, {rank_sql('risk', 'bin')} AS a, {rank_sql('error', 'bin')} AS b FROM b)
    SELECT bin, count(*) AS n, round(min(magnitude), 6) AS low, round(max(magnitude), 6) AS high, CASE WHEN count(*) >= 5 THEN round({corr_sql('a', 'b')}, 6) END AS rho FROM r GROUP BY bin""",
)
def within_magnitude_rho(spark, sf_dir):
    """Rank correlation of a family's spread and its error within quarters of the predicted magnitude."""
    members, truth = views.predictions(spark, sf_dir)
    certificates = cert.family_certificate(members, truth, ["task"])
    centre = members.groupBy("task", "position").agg(F.avg("prediction").alias("c"))
    size = centre.groupBy("task").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("magnitude"))
    return m.within_magnitude(certificates.join(size, "task"), [], "diversity_lower", "family_rms_error", "magnitude", "task").select("bin", "n", *rounded("low", "high", "rho"))


@query("gene_macro_spearman", f"WITH {EVENTS}, g AS (SELECT dataset, cluster, avg(risk) AS risk, avg(error) AS error FROM ev GROUP BY ALL), r AS (SELECT dataset, {rank_sql('risk', 'dataset')} AS a, {rank_sql('error', 'dataset')} AS b FROM g WHERE risk IS NOT NULL AND error IS NOT NULL) SELECT dataset, count(*) AS n, round({corr_sql('a', 'b')}, 6) AS rho FROM r GROUP BY dataset")
def gene_macro_spearman(spark, sf_dir):
    means = events(spark, sf_dir).groupBy("dataset", "cluster").agg(scalars.settled(F.avg("risk")).alias("risk"), scalars.settled(F.avg("error")).alias("error"))
    return m.spearman(means, ["dataset"], "risk", "error").withColumn("rho", F.round("rho", 6))


_R = {k: corr_sql(*k) for k in (("x", "y"), ("x", "c"), ("y", "c"), ("x", "d"), ("y", "d"), ("c", "d"))}


@query(
    "partial_spearman_two",
    f"""WITH {EVENTS}, k AS (SELECT dataset, risk, error, cluster AS c0, event_id AS d0 FROM ev WHERE risk IS NOT NULL AND error IS NOT NULL AND cluster IS NOT NULL AND event_id IS NOT NULL),
    r AS (SELECT dataset, {rank_sql('risk', 'dataset')} AS x, {rank_sql('error', 'dataset')} AS y, {rank_sql('c0', 'dataset')} AS c, {rank_sql('d0', 'dataset')} AS d FROM k),
    q AS (SELECT dataset, count(*) AS n, {_R['x', 'y']} AS xy, {_R['x', 'c']} AS xc, {_R['y', 'c']} AS yc, {_R['x', 'd']} AS xd, {_R['y', 'd']} AS yd, {_R['c', 'd']} AS cd FROM r GROUP BY dataset),
    p AS (SELECT *, (xy - xc * yc) / sqrt((1 - xc * xc) * (1 - yc * yc)) AS xy_c, (xd - xc * cd) / sqrt((1 - xc * xc) * (1 - cd * cd)) AS xd_c, (yd - yc * cd) / sqrt((1 - yc * yc) * (1 - cd * cd)) AS yd_c FROM q)
    SELECT dataset, n, round((xy_c - xd_c * yd_c) / sqrt((1 - xd_c * xd_c) * (1 - yd_c * yd_c)), 6) AS rho FROM p""",
)
def partial_spearman_two(spark, sf_dir):
    """Of risk and error, with the ranks of two covariates taken out of both."""
    return m.partial_spearman_two(events(spark, sf_dir), ["dataset"], "risk", "error", "cluster", "event_id").withColumn("rho", F.round("rho", 6))


@query("occurrence_index", f"WITH {EVENTS}, o AS (SELECT event_id, dataset, cluster, row_number() OVER (PARTITION BY dataset, cluster ORDER BY event_id) - 1 AS occurrence FROM ev) SELECT event_id, occurrence, substr(sha256(dataset || '|' || cluster || '|' || occurrence), 1, 16) AS tie FROM o")
def occurrence_index(spark, sf_dir):
    """Which time a task's cluster occurs, and the tie value of cluster and occurrence: 16 hex digits order as 64-bit numbers do."""
    rows = m.ordered_positions(events(spark, sf_dir), ["dataset", "cluster"], "event_id", [], "at").withColumn("occurrence", F.col("at") - 1)
    tie = F.sha2(F.concat_ws("|", "dataset", F.col("cluster").cast("string"), F.col("occurrence").cast("string")), 256)
    return rows.select("event_id", "occurrence", F.substring(tie, 1, 16).alias("tie"))


@query(
    "condition_labels",
    r"""WITH l AS (SELECT p_partkey, 'K562_' || p_brand || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '+' || p_type ELSE '_ctrl' END || '_1+1' AS label FROM part), c AS (SELECT p_partkey, label, regexp_extract(label, '^K562_(.*)_1\+1$', 1) AS raw FROM l),
    g AS (SELECT *, list_sort(list_filter([upper(trim(x)) for x in regexp_split_to_array(raw, '[_+]')], lambda x: x <> '' AND x <> 'CTRL')) AS genes FROM c)
    SELECT p_partkey, label, CASE WHEN len(genes) = 0 THEN 'ctrl' WHEN len(genes) = 1 THEN genes[1] || '+ctrl' ELSE array_to_string(genes, '+') END AS condition, len(genes) AS n_genes FROM g""",
)
def condition_labels(spark, sf_dir):
    """Canonical conditions of labels with a cell line in front and a count behind."""
    key = F.col("p_partkey")
    tail = F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(F.lit("+"), "p_type")).otherwise("_ctrl")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("K562_"), "p_brand", tail, F.lit("_1+1")).alias("label"))
    raw = scalars.label_between(F.col("label"), "K562_", "_1+1")
    rows = rows.withColumn("genes", scalars.condition_genes(raw))
    return rows.select("p_partkey", "label", scalars.canonical_condition(F.col("genes")).alias("condition"), F.size("genes").cast("long").alias("n_genes"))


@query(
    "hash_numbers",
    f"WITH {EVENTS}, h AS (SELECT event_id, risk, sha256('label|' || event_id) AS s FROM ev) SELECT event_id, CAST(concat('0x', substr(s, 1, 8)) AS BIGINT) AS seed, round((CAST(concat('0x', substr(s, 1, 8)) AS BIGINT) * 4294967296.0 + CAST(concat('0x', substr(s, 9, 8)) AS BIGINT)) / 18446744073709551616.0, 9) AS u, round(tanh(atanh(greatest(least(risk / 50 - 1, 0.999999), -0.999999))), 6) AS back FROM h",
)
def hash_numbers(spark, sf_dir):
    """Seeds and uniform numbers of labels; Fisher's transform and back."""
    digest = F.sha2(F.concat(F.lit("label|"), F.col("event_id").cast("string")), 256)
    part = lambda k: F.conv(F.substring("s", k, 8), 16, 10).cast("long")
    u = (part(1) * F.lit(4294967296.0) + part(9)) / F.lit(18446744073709551616.0)
    rows = events(spark, sf_dir).withColumn("s", digest)
    return rows.select("event_id", part(1).alias("seed"), F.round(u, 9).alias("u"), F.round(F.tanh(scalars.fisher_z(F.col("risk") / 50 - 1)), 6).alias("back"))


@query("four_level_summary", f"WITH {EVENTS}, s AS (SELECT *, {views.split_sql('event_id')} AS split FROM ev) SELECT dataset, split, count(*) AS n, count(DISTINCT cluster) AS n_clusters, round(avg(error), 6) AS mean_error, round(avg(risk), 6) AS mean_risk FROM s GROUP BY GROUPING SETS ((), (dataset), (split), (dataset, split))")
def four_level_summary(spark, sf_dir):
    """Overall, by dataset, by split, and by both."""
    rows = views.splits(events(spark, sf_dir), "event_id")
    return rows.cube("dataset", "split").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("n_clusters"), F.round(F.avg("error"), 6).alias("mean_error"), F.round(F.avg("risk"), 6).alias("mean_risk"))


@query("leave_one_dataset_out_meta")
def leave_one_dataset_out_meta(spark, sf_dir):
    """Random-effects mean of the data sets' correlations of risk and error, on Fisher's scale, without each of them in turn."""
    rho = m.spearman(events(spark, sf_dir), ["dataset"], "risk", "error").filter("n > 3 and rho is not null")
    studies = rho.select("dataset", scalars.fisher_z(F.col("rho")).alias("z"), (1 / F.sqrt(F.col("n") - 3)).alias("se"))
    return small.leave_one_out_meta(studies, "dataset", "z", "se").withColumn("pooled_rho", F.tanh("estimate"))


@query(
    "family_enumeration",
    f"""WITH {LONG}, tw AS (SELECT task, CASE WHEN member <= 2 THEN 1 ELSE 2 END AS member, position, avg(prediction) AS prediction FROM pred GROUP BY ALL), f AS (SELECT task, 'architecture_pair' AS family, member, position, prediction FROM tw UNION ALL SELECT task, 'all_seeds', member, position, prediction FROM pred UNION ALL SELECT task, 'no_change_control', member, position, prediction FROM tw
        UNION ALL SELECT task, 'no_change_control', 0, position, 0 FROM (SELECT DISTINCT task, position FROM pred)),
    c AS (SELECT task, family, position, avg(prediction) AS c, var_pop(prediction) AS s FROM f GROUP BY ALL), n AS (SELECT task, family, count(DISTINCT member) AS n_members FROM f GROUP BY ALL),
    e AS (SELECT f.task, family, sqrt(avg((prediction - truth) ** 2)) AS family_rms_error FROM f JOIN truth USING (task, position) GROUP BY ALL),
    d AS (SELECT task, family, sqrt(avg(s)) AS lower_bound FROM c GROUP BY ALL)
    SELECT task, family, n_members, round(family_rms_error, 6) AS family_rms_error, round(lower_bound, 6) AS diversity_lower, lower_bound > family_rms_error + 1e-10 AS violation FROM n JOIN d USING (task, family) JOIN e USING (task, family)""",
)
def family_enumeration(spark, sf_dir):
    """Error and lower bound of each registered family of a task: the seed means of two architectures, all seeds, and the means with a prediction of no change."""
    members, truth = views.predictions(spark, sf_dir)
    families = cert.registered_families(members, F.when(F.col("member") <= 2, 1).otherwise(2))
    targets = truth.withColumn("family", F.explode(F.array(*map(F.lit, ("architecture_pair", "all_seeds", "no_change_control")))))
    out = cert.family_certificate(families, targets, ["task", "family"], alone=True)
    return out.select("task", "family", "n_members", *rounded("family_rms_error", "diversity_lower"), F.col("family_violation").alias("violation"))


@query("coverage_intervals")
def coverage_intervals(spark, sf_dir):
    """Of each dataset, clusters whose mean error is at most 50: exact 95 % interval of the share, the chance of so few under Beta(18, 2), Fisher's p against the others, and rows that a correlation of the share's size needs."""
    clusters = events(spark, sf_dir).groupBy("dataset", "cluster").agg((F.avg("error") <= 50).cast("int").alias("ok"))
    counts = clusters.groupBy("dataset").agg(F.sum("ok").alias("k"), F.count("ok").alias("n"))
    whole = counts.agg(F.sum("k").alias("all_k"), F.sum("n").alias("all_n"))

    @F.pandas_udf("low double, high double, p_few double, p_fisher double, least_n long")
    def exact(k: pd.Series, n: pd.Series, all_k: pd.Series, all_n: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b, c, d in zip(*(x.astype(int) for x in (k, n, all_k, all_n)), strict=True):
            rho = min(max(a / b, 0.05), 0.95)
            rows.append((*small.clopper_pearson(a, b), small.beta_binomial_cdf(a, b, 18.0, 2.0), small.fisher_exact(a, b - a, c - a, d - b - (c - a)), small.least_n(rho)))
        return pd.DataFrame(rows, columns=["low", "high", "p_few", "p_fisher", "least_n"])

    rows = counts.join(F.broadcast(whole))  # one row
    return rows.select("dataset", "k", "n", exact("k", "n", "all_k", "all_n").alias("x")).select("dataset", "k", "n", "x.*")


@query("seed_median", f"WITH {EVENTS}, s AS (SELECT dataset, cluster, {views.fold_sql('event_id', 3)} AS seed, avg(error) AS error, count(*) AS n FROM ev GROUP BY ALL) SELECT dataset, cluster, round(median(error), 6) AS error, median(n) AS sample_size, count(DISTINCT seed) AS n_seeds FROM s GROUP BY ALL")
def seed_median(spark, sf_dir):
    """Median over seeds of each seed's mean error and size; a group has three seeds at most."""
    seed = scalars.fold(F.sha2(F.col("event_id").cast("string"), 256), 3)
    runs = events(spark, sf_dir).groupBy("dataset", "cluster", seed.alias("seed")).agg(F.avg("error").alias("error"), F.count("*").alias("n"))
    return runs.groupBy("dataset", "cluster").agg(F.round(F.median("error"), 6).alias("error"), F.median("n").alias("sample_size"), F.count_distinct("seed").alias("n_seeds"))


#: The reference's halvings and the cells that each half needs.
REPEATS, LEAST_HALF = 50, 20
_COIN = "CAST(concat('0x', substr(sha256('half|coin|' || o || '|' || context || '|' || perturbation || '|' || batch || '|' || ((pos - 1) // 2)), 1, 8)) AS BIGINT)"


@query(
    "split_half_reproducibility",
    f"""WITH {CELLS}, u AS (SELECT DISTINCT context, perturbation, batch, cell FROM cells), o AS (SELECT u.*, o, row_number() OVER (PARTITION BY context, perturbation, batch, o ORDER BY sha256('half|' || o || '|' || cell), cell) AS pos FROM u, range(0, 5) t(o)),
    h AS (SELECT context, perturbation, batch, cell, o * {REPEATS // 5} + j AS repeat, ((({_COIN} >> j) & 1) = pos % 2) AS is_left FROM o, range(0, {REPEATS // 5}) t(j)),
    n AS (SELECT context, perturbation, repeat, count(*) FILTER (is_left) AS nl, count(*) FILTER (NOT is_left) AS nr FROM h GROUP BY ALL), gs AS (SELECT DISTINCT gene FROM cells),
    s AS (SELECT context, perturbation, repeat, gene, coalesce(sum(x) FILTER (is_left), 0) AS sl, coalesce(sum(x) FILTER (NOT is_left), 0) AS sr FROM cells JOIN h USING (context, perturbation, batch, cell) GROUP BY ALL),
    mm AS (SELECT n.*, gene, coalesce(sl, 0) / nl AS ml, coalesce(sr, 0) / nr AS mr FROM n CROSS JOIN gs LEFT JOIN s USING (context, perturbation, repeat, gene)),
    e AS (SELECT p.context, p.perturbation, p.repeat, p.nl + p.nr AS n, p.ml - k.ml AS a, p.mr - k.mr AS b FROM mm p JOIN mm k ON k.context = p.context AND k.repeat = p.repeat AND k.gene = p.gene AND k.perturbation = '{views.CONTROL}' WHERE p.perturbation <> '{views.CONTROL}' AND least(p.nl, p.nr, k.nl, k.nr) >= {LEAST_HALF}),
    r AS (SELECT context, perturbation, repeat, n, sqrt(avg((a - b) ** 2)) AS rmse, 1 - {corr_sql('a', 'b')} AS pe, 1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS ce FROM e GROUP BY ALL)
    SELECT context, perturbation, n AS n_cells, count(*) AS n_repeats, round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_sd, round(avg(pe), 6) AS pearson_error, round(avg(ce), 6) AS cosine_error FROM r GROUP BY ALL""",
)
def split_half_reproducibility(spark, sf_dir):
    """How far the effects of two halves of a pair's cells lie apart, halved within batches fifty times together with the control."""
    sizes, sums = resampling.half_sums(views.cells(spark, sf_dir), ["context", "perturbation"], ["batch"], "cell", "gene", "x", REPEATS, "half")
    noise = fx.noise_of_sums(sizes, sums, views.CONTROL, REPEATS, LEAST_HALF)
    return noise.select("context", "perturbation", "n_cells", "n_repeats", *rounded("rmse_mean", "rmse_sd", "pearson_error", "cosine_error"))
