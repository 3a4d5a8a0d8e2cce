"""Effects, joins, set operations, features, splits, contracts and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions import scalars
from veritrail.functions import vectors as vec
from veritrail.operators import contracts, metrics, resampling
from veritrail.operators import effects as fx
from veritrail.plans.certificate_queries import rounded
from veritrail.plans.metric_queries import corr_sql, rank_sql
from veritrail.plans.registry import query
from veritrail.sources import views
from veritrail.sources.tables import table
from veritrail.sources.views import CELLS, CONTROL, EVENTS, VECTORS

_BULK = f"{CELLS}, sz AS (SELECT context, perturbation, count(DISTINCT cell) AS n FROM cells GROUP BY ALL), bulk AS (SELECT context, perturbation, gene, sum(x) / any_value(n) AS mean, sum(x * x) AS q, any_value(n) AS n FROM cells JOIN sz USING (context, perturbation) GROUP BY ALL)"
# Absent rows are zeros: a gene that only one of perturbation and control has still has an effect.
_EFFECT = f"""{_BULK}, eff_base AS (SELECT context, gene, mean FROM bulk WHERE perturbation = '{CONTROL}'),
    eff_own AS (SELECT * FROM bulk WHERE perturbation <> '{CONTROL}' AND context IN (SELECT context FROM eff_base)),
    eff_grid AS (SELECT context, perturbation, n, gene FROM eff_own UNION SELECT o.context, o.perturbation, o.n, k.gene FROM eff_own o JOIN eff_base k ON k.context = o.context),
    eff AS (SELECT g.context, g.perturbation, g.gene, g.n AS n_cells, coalesce(o.mean, 0) - coalesce(k.mean, 0) AS effect FROM eff_grid g
        LEFT JOIN eff_own o ON o.context = g.context AND o.perturbation = g.perturbation AND o.gene = g.gene LEFT JOIN eff_base k ON k.context = g.context AND k.gene = g.gene)"""


@query("pseudobulk_mean", f"WITH {_BULK} SELECT context, perturbation, gene, round(mean, 6) AS mean, round((q - n * mean * mean) / (n - 1), 6) AS variance, n AS n_cells FROM bulk")
def pseudobulk_mean(spark, sf_dir):
    return fx.pseudobulk(views.cells(spark, sf_dir), ["context", "perturbation"]).withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 6)})


def effects(spark, sf_dir):
    return fx.control_effects(views.cells(spark, sf_dir), CONTROL, ["context"])


@query("pseudobulk_effect", f"WITH {_EFFECT} SELECT context, perturbation, gene, n_cells, round(effect, 6) AS effect FROM eff")
def pseudobulk_effect(spark, sf_dir):
    return effects(spark, sf_dir).withColumn("effect", F.round("effect", 6))


@query(
    "batch_matched_effect",
    f"""WITH {CELLS}, sz AS (SELECT context, batch, perturbation, count(DISTINCT cell) AS n FROM cells GROUP BY ALL), gs AS (SELECT DISTINCT gene FROM cells),
    b AS (SELECT s.context, s.batch, s.perturbation, g.gene, s.n, coalesce(sum(c.x), 0) / any_value(s.n) AS mean, count(c.x) AS rows FROM sz s CROSS JOIN gs g LEFT JOIN cells c ON c.context = s.context AND c.batch = s.batch AND c.perturbation = s.perturbation AND c.gene = g.gene GROUP BY s.context, s.batch, s.perturbation, g.gene, s.n),
    e AS (SELECT p.context, p.perturbation, p.gene, p.n, p.rows + k.rows AS rows, p.mean - k.mean AS effect FROM b p JOIN b k ON k.context = p.context AND k.batch = p.batch AND k.gene = p.gene AND k.perturbation = '{CONTROL}' WHERE p.perturbation <> '{CONTROL}')
    SELECT context, perturbation, gene, round(sum(n * effect) / sum(n), 6) AS effect, CAST(sum(n) AS BIGINT) AS n_cells FROM e GROUP BY ALL HAVING sum(rows) > 0""",
)
def batch_matched_effect(spark, sf_dir):
    return fx.batch_matched_effects(views.cells(spark, sf_dir), CONTROL).withColumn("effect", F.round("effect", 6))


@query("weighted_target_effect", f"WITH {_EFFECT} SELECT perturbation, gene, round(sum(n_cells * effect) / sum(n_cells), 6) AS effect, CAST(count(*) AS BIGINT) AS n_contexts FROM eff GROUP BY ALL")
def weighted_target_effect(spark, sf_dir):
    w = F.col("n_cells")
    return effects(spark, sf_dir).groupBy("perturbation", "gene").agg(F.round(F.sum(w * F.col("effect")) / F.sum(w), 6).alias("effect"), F.count("*").alias("n_contexts"))


#: A fixed dimension: three return flags by two line states.
_GENES = ("AF", "AO", "NF", "NO", "RF", "RO")


@query("effect_long_to_wide_pivot", f"WITH {_EFFECT} SELECT context, perturbation, " + ", ".join(f"round(avg(effect) FILTER (gene = '{g}'), 6) AS {g}" for g in _GENES) + " FROM eff GROUP BY ALL")
def effect_long_to_wide_pivot(spark, sf_dir):
    gene = F.when(F.col("gene").isin(*_GENES), F.col("gene")).otherwise(F.raise_error(F.concat(F.lit("no column for gene "), F.coalesce("gene", F.lit("null")))))
    wide = effects(spark, sf_dir).withColumn("gene", gene).groupBy("context", "perturbation").pivot("gene", list(_GENES)).agg(F.avg("effect"))
    return wide.select("context", "perturbation", *rounded(*_GENES))


@query("task_support_count", f"WITH {CELLS}, p AS (SELECT DISTINCT context, perturbation FROM cells WHERE {views.fold_sql('cell', 10)} < 6), t AS (SELECT DISTINCT context, perturbation FROM cells) SELECT t.context, t.perturbation, count(p.context) AS support FROM t LEFT JOIN p ON p.perturbation = t.perturbation AND p.context <> t.context GROUP BY ALL")
def task_support_count(spark, sf_dir):
    cells = views.cells(spark, sf_dir)
    train = scalars.fold(F.sha2(F.col("cell"), 256), 10) < 6
    tasks = cells.groupBy("context", "perturbation").agg(F.bool_or(train).alias("known"))
    sums = tasks.groupBy("perturbation").agg(F.count_if("known").alias("all"))
    return tasks.join(sums, "perturbation").select("context", "perturbation", (F.col("all") - F.col("known").cast("long")).alias("support"))


@query(
    "historical_residual",
    f"""WITH {_EFFECT}, s AS (SELECT *, sum(effect) OVER w AS s, count(*) OVER w AS n FROM eff WINDOW w AS (PARTITION BY perturbation, gene)), r AS (SELECT context, perturbation, sqrt(avg((effect - (s - effect) / (n - 1)) ** 2)) AS resid FROM s WHERE n > 1 GROUP BY ALL)
    SELECT perturbation, round(median(resid), 6) AS residual, count(*) AS n_contexts FROM r GROUP BY perturbation""",
)
def historical_residual(spark, sf_dir):
    rows = fx.leave_own_context_out(effects(spark, sf_dir), "effect", ["perturbation", "gene"]).filter("others_mean is not null")
    off = F.col("effect") - F.col("others_mean")
    by_context = rows.groupBy("context", "perturbation").agg(F.sqrt(F.avg(off * off)).alias("resid"))
    return by_context.groupBy("perturbation").agg(F.round(F.median("resid"), 6).alias("residual"), F.count("*").alias("n_contexts"))


@query(
    "v0_baseline_prediction",
    f"""WITH {_EFFECT}, p AS (SELECT perturbation, gene, avg(effect) AS pm FROM eff GROUP BY ALL), c AS (SELECT context, gene, avg(effect) AS cm FROM eff GROUP BY ALL), g AS (SELECT gene, avg(effect) AS gm FROM eff GROUP BY ALL)
    SELECT e.context, e.perturbation, e.gene, round(0.85 * coalesce(pm, gm) + 0.15 * coalesce(cm, gm), 6) AS prediction FROM eff e LEFT JOIN p USING (perturbation, gene) LEFT JOIN c USING (context, gene) JOIN g USING (gene)""",
)
def v0_baseline_prediction(spark, sf_dir):
    e = effects(spark, sf_dir)
    mean = lambda keys, name: e.groupBy(*keys, "gene").agg(F.avg("effect").alias(name))
    rows = e.join(mean(["perturbation"], "pm"), ["perturbation", "gene"], "left").join(mean(["context"], "cm"), ["context", "gene"], "left").join(mean([], "gm"), "gene")
    return rows.select("context", "perturbation", "gene", F.round(0.85 * F.coalesce("pm", "gm") + 0.15 * F.coalesce("cm", "gm"), 6).alias("prediction"))


@query("self_excluding_mean", f"WITH {_EFFECT}, s AS (SELECT *, sum(effect) OVER w AS s, count(*) OVER w AS n, avg(effect) OVER (PARTITION BY gene) AS g FROM eff WINDOW w AS (PARTITION BY perturbation, gene)) SELECT context, perturbation, gene, round(CASE WHEN n > 1 THEN (s - effect) / (n - 1) ELSE g END, 6) AS prediction FROM s")
def self_excluding_mean(spark, sf_dir):
    e = effects(spark, sf_dir)
    rows = fx.leave_own_context_out(e, "effect", ["perturbation", "gene"]).join(e.groupBy("gene").agg(F.avg("effect").alias("g")), "gene")
    return rows.select("context", "perturbation", "gene", F.round(F.coalesce("others_mean", "g"), 6).alias("prediction"))


@query(
    "energy_distance",
    f"""WITH {CELLS}, v AS (SELECT context, perturbation, cell, gene, sum(x) AS x FROM cells GROUP BY ALL), sz AS (SELECT context, perturbation, count(DISTINCT cell) AS n FROM v GROUP BY ALL),
    g AS (SELECT context, perturbation, gene, sum(x) / any_value(n) AS m, sum(x * x) AS q FROM v JOIN sz USING (context, perturbation) GROUP BY ALL),
    k AS (SELECT context, perturbation, any_value(n) AS n, sum(q) AS q, sum(m * m) AS m2 FROM g JOIN sz USING (context, perturbation) GROUP BY ALL),
    side AS (SELECT context, perturbation, n, q / n AS power, CASE WHEN n > 1 THEN 2 * (q - n * m2) / (n - 1) END AS sigma FROM k),
    cross_terms AS (SELECT a.context, a.perturbation, sum(a.m * b.m) AS inner_sum FROM g a JOIN g b ON a.context = b.context AND a.gene = b.gene AND b.perturbation = '{CONTROL}' GROUP BY ALL),
    d AS (SELECT a.context, a.perturbation, a.n, a.power + b.power - 2 * coalesce(inner_sum, 0) AS delta, b.sigma AS sigma_control, a.sigma FROM side a JOIN side b ON a.context = b.context AND b.perturbation = '{CONTROL}'
        LEFT JOIN cross_terms c ON c.context = a.context AND c.perturbation = a.perturbation WHERE a.perturbation <> '{CONTROL}')
    SELECT context, perturbation, n AS n_cells, round(delta, 6) AS delta, round(sigma_control, 6) AS sigma_control, round(sigma, 6) AS sigma, round(2 * delta - sigma_control - sigma, 6) AS energy FROM d""",
)
def energy_distance(spark, sf_dir):
    return fx.energy_distances(views.cells(spark, sf_dir), CONTROL, ["context"]).select("context", "perturbation", "n_cells", *rounded("delta", "sigma_control", "sigma", "energy"))


@query("two_way_anova", f"WITH {_EFFECT}, m AS (SELECT *, avg(effect) OVER () AS g, avg(effect) OVER (PARTITION BY context) AS c, avg(effect) OVER (PARTITION BY perturbation) AS p FROM eff) SELECT count(*) AS n, round(sum((effect - g) ** 2), 4) AS ss_total, round(sum((c - g) ** 2), 4) AS ss_context, round(sum((p - g) ** 2), 4) AS ss_perturbation, round(sum((effect - c - p + g) ** 2), 4) AS ss_residual FROM m")
def two_way_anova(spark, sf_dir):
    e = effects(spark, sf_dir)
    grand = e.agg(F.avg("effect").alias("g"))
    rows = e.join(e.groupBy("context").agg(F.avg("effect").alias("c")), "context").join(e.groupBy("perturbation").agg(F.avg("effect").alias("p")), "perturbation").join(F.broadcast(grand))  # one row
    square = lambda x: F.round(F.sum(x * x), 4)
    c, p, g, v = (F.col(k) for k in ("c", "p", "g", "effect"))
    return rows.agg(F.count("*").alias("n"), square(v - g).alias("ss_total"), square(c - g).alias("ss_context"), square(p - g).alias("ss_perturbation"), square(v - c - p + g).alias("ss_residual"))


@query("shared_perturbations", f"WITH {CELLS}, k AS (SELECT context, perturbation, count(*) AS n FROM cells GROUP BY ALL), s AS (SELECT perturbation, count(*) AS n_contexts, min(n) AS least, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT context) FROM cells)) SELECT * FROM s ORDER BY least DESC, total DESC, perturbation LIMIT 10")
def shared_perturbations(spark, sf_dir):
    counts = views.cells(spark, sf_dir).groupBy("context", "perturbation").agg(F.count("*").alias("n"))
    contexts = counts.agg(F.count_distinct("context").alias("__all"))
    sums = counts.groupBy("perturbation").agg(F.count("*").alias("n_contexts"), F.min("n").alias("least"), F.sum("n").alias("total"))
    full = sums.join(F.broadcast(contexts), F.col("n_contexts") == F.col("__all")).drop("__all")  # one row
    return full.orderBy(F.desc("least"), F.desc("total"), "perturbation").limit(10)


@query("gene_panel_topk", f"WITH {CELLS}, g AS (SELECT gene, count(x) AS n, var_pop(x) AS v FROM cells GROUP BY ALL) SELECT gene, n, round(v, 6) AS v FROM g ORDER BY n DESC, v DESC, gene LIMIT 3")
def gene_panel_topk(spark, sf_dir):
    return views.cells(spark, sf_dir).groupBy("gene").agg(F.count("x").alias("n"), F.var_pop("x").alias("v")).orderBy(F.desc("n"), F.desc("v"), "gene").limit(3).withColumn("v", F.round("v", 6))


@query("missingness_profile", "WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count(*) - count({c}) AS n_null, round(1 - count({c}) / count(*), 6) AS null_rate, round(avg({c}), 6) AS mean, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM d" for c in ("n_chars", "quality", "toxic")))
def missingness_profile(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    facts = lambda c: F.struct(F.lit(c).alias("name"), F.count("*").alias("n"), (F.count("*") - F.count(c)).alias("n_null"), F.round(1 - F.count(c) / F.count("*"), 6).alias("null_rate"), F.round(F.avg(c), 6).alias("mean"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"))
    return d.agg(F.array(*map(facts, ("n_chars", "quality", "toxic"))).alias("p")).select(F.inline("p"))


@query("dominant_label", f"WITH {CELLS}, k AS (SELECT context, perturbation, batch, count(*) AS c FROM cells GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY context, perturbation ORDER BY c DESC, batch) AS k, sum(c) OVER (PARTITION BY context, perturbation) AS n, count(*) OVER (PARTITION BY context, perturbation) AS n_distinct FROM k) SELECT context, perturbation, batch, round(c / n, 6) AS share, n_distinct FROM r WHERE k = 1")
def dominant_label(spark, sf_dir):
    counts = views.cells(spark, sf_dir).groupBy("context", "perturbation", "batch").agg(F.count("*").alias("c"))
    best = F.min(F.struct((-F.col("c")).alias("down"), "batch"))
    out = counts.groupBy("context", "perturbation").agg(best.alias("b"), F.sum("c").alias("n"), F.count("*").alias("n_distinct"))
    return out.select("context", "perturbation", F.col("b.batch").alias("batch"), F.round(-F.col("b.down") / F.col("n"), 6).alias("share"), "n_distinct")


@query("set_concat", f"WITH {CELLS} SELECT perturbation, string_agg(DISTINCT context, ';' ORDER BY context) AS contexts, count(DISTINCT batch) AS n_batches FROM cells GROUP BY perturbation")
def set_concat(spark, sf_dir):
    return views.cells(spark, sf_dir).groupBy("perturbation").agg(F.array_join(F.array_sort(F.collect_set("context")), ";").alias("contexts"), F.count_distinct("batch").alias("n_batches"))


@query("crosstab_counts", f"WITH {EVENTS}, s AS (SELECT *, {views.split_sql('event_id')} AS split FROM ev) SELECT dataset, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM s GROUP BY dataset")
def crosstab_counts(spark, sf_dir):
    return views.splits(views.scored_events(spark, sf_dir), "event_id").groupBy("dataset").pivot("split", ["train", "val", "test"]).count().na.fill(0)


@query("deterministic_dedup", f"WITH {EVENTS} SELECT dataset, cluster, round(median(risk), 6) AS risk, round(median(error), 6) AS error, count(*) AS n FROM ev GROUP BY ALL")
def deterministic_dedup(spark, sf_dir):
    return views.scored_events(spark, sf_dir).groupBy("dataset", "cluster").agg(F.round(F.median("risk"), 6).alias("risk"), F.round(F.median("error"), 6).alias("error"), F.count("*").alias("n"))


@query("keep_first_duplicates", f"WITH {EVENTS} SELECT dataset, cluster, min(event_id) AS event_id, arg_min(error, event_id) AS error FROM ev GROUP BY ALL")
def keep_first_duplicates(spark, sf_dir):
    return views.scored_events(spark, sf_dir).groupBy("dataset", "cluster").agg(F.min("event_id").alias("event_id"), F.min_by("error", "event_id").alias("error"))


@query("drop_all_duplicated", f"WITH {EVENTS}, k AS (SELECT *, count(*) OVER (PARTITION BY dataset, cluster, risk) AS c FROM ev) SELECT event_id, dataset, cluster, risk FROM k WHERE c = 1")
def drop_all_duplicated(spark, sf_dir):
    ev = views.scored_events(spark, sf_dir)
    return ev.groupBy("dataset", "cluster", "risk").agg(F.count("*").alias("c"), F.min("event_id").alias("event_id")).filter("c = 1").select("event_id", "dataset", "cluster", "risk")


@query("semi_anti_fresh_pool", f"WITH {EVENTS} SELECT DISTINCT cluster FROM ev WHERE dataset = 'click' AND cluster NOT IN (SELECT cluster FROM ev WHERE dataset = 'error' AND error > 60) AND cluster IN (SELECT cluster FROM ev WHERE dataset = 'view')")
def semi_anti_fresh_pool(spark, sf_dir):
    ev = views.scored_events(spark, sf_dir)
    of = lambda name: ev.filter(F.col("dataset") == name)
    return of("click").select("cluster").distinct().join(of("error").filter("error > 60"), "cluster", "left_anti").join(of("view"), "cluster", "left_semi")


@query("round_robin_sample", f"WITH {EVENTS}, r AS (SELECT dataset, event_id, row_number() OVER (PARTITION BY dataset ORDER BY error DESC, event_id) AS rn FROM ev) SELECT dataset, event_id, rn FROM r ORDER BY rn, dataset LIMIT 50")
def round_robin_sample(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("error"), "event_id")).cast("long")
    ranked = views.scored_events(spark, sf_dir).withColumn("rn", rank).filter("rn <= 50")  # pushed into the window as a top-k
    return ranked.select("dataset", "event_id", "rn").orderBy("rn", "dataset").limit(50)


@query("dataset_pair_jaccard", f"WITH {EVENTS}, s AS (SELECT dataset, list(DISTINCT cluster) AS c FROM ev GROUP BY ALL) SELECT a.dataset AS left_set, b.dataset AS right_set, round(CASE WHEN len(list_distinct(a.c || b.c)) = 0 THEN 1 ELSE len(list_intersect(a.c, b.c)) / len(list_distinct(a.c || b.c)) END, 6) AS jaccard FROM s a JOIN s b ON a.dataset < b.dataset")
def dataset_pair_jaccard(spark, sf_dir):
    held = views.scored_events(spark, sf_dir).select("dataset", "cluster").distinct()
    sizes = held.groupBy("dataset").agg(F.count("*").alias("n"))
    common = held.alias("a").join(held.alias("b"), F.expr("a.cluster = b.cluster and a.dataset < b.dataset")).groupBy(F.col("a.dataset").alias("left_set"), F.col("b.dataset").alias("right_set")).agg(F.count("*").alias("both"))
    named = lambda side: sizes.select(F.col("dataset").alias(f"{side}_set"), F.col("n").alias(f"n_{side}"))
    pairs = named("left").join(named("right"), F.col("left_set") < F.col("right_set")).join(common, ["left_set", "right_set"], "left")
    both = F.coalesce("both", F.lit(0))
    return pairs.select("left_set", "right_set", F.round(both / (F.col("n_left") + F.col("n_right") - both), 6).alias("jaccard"))


@query("topk_overlap", f"WITH {VECTORS}, k AS (SELECT task, member, list_transform(list_sort([{{'x': -abs(v[i]), 'i': i}} for i in range(1, 65)])[1:10], lambda s: s.i) AS t FROM vec) SELECT a.task, round(len(list_intersect(a.t, b.t)) / 10, 6) AS overlap FROM k a JOIN k b ON a.task = b.task AND a.member = 1 AND b.member = 2")
def topk_overlap(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    of = lambda m, name: v.filter(F.col("member") == m).select("task", F.col("v").alias(name))
    return of(1, "a").join(of(2, "b"), "task").select("task", F.round(vec.top_k_overlap(F.col("a"), F.col("b"), 10), 6).alias("overlap"))


_DIS = "[p[i] * q[i] for i in range(1, 65)]"


@query(
    "model_disagreement",
    f"""WITH {VECTORS}, j AS (SELECT a.task, a.v AS p, b.v AS q FROM vec a JOIN vec b ON a.task = b.task AND a.member = 1 AND b.member = 2)
    SELECT task, round(sqrt(list_sum([(p[i] - q[i]) ** 2 for i in range(1, 65)]) / 64), 6) AS rmse, round(1 - list_sum({_DIS}) / sqrt(list_sum([x * x for x in p]) * list_sum([x * x for x in q])), 6) AS cosine_distance, round(len([1 for i in range(1, 65) if p[i] * q[i] > 0]) / 64, 6) AS sign_agreement FROM j""",
)
def model_disagreement(spark, sf_dir):
    v = views.vectors(spark, sf_dir)
    of = lambda m, name: v.filter(F.col("member") == m).select("task", F.col("v").alias(name))
    a, b = F.col("a"), F.col("b")
    return of(1, "a").join(of(2, "b"), "task").select("task", F.round(vec.rmse(a, b), 6).alias("rmse"), F.round(1 - vec.cosine(a, b), 6).alias("cosine_distance"), F.round(vec.sign_agreement(a, b), 6).alias("sign_agreement"))


@query("perturbation_stability", f"WITH {VECTORS}, u AS (SELECT label, vec_id, [x / sqrt(list_sum([y * y for y in v])) for x in v] AS u FROM vec), s AS (SELECT label, i, sum(u[i]) AS s FROM u, range(1, 65) t(i) GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM u GROUP BY ALL) SELECT label, n, round((sum(s * s) - any_value(n)) / (any_value(n) * (any_value(n) - 1)), 6) AS mean_cosine FROM s JOIN n USING (label) GROUP BY label, n")
def perturbation_stability(spark, sf_dir):
    unit = views.vectors(spark, sf_dir).select("label", vec.unit(F.col("v")).alias("u")).filter("u is not null")
    sums = unit.select("label", F.posexplode("u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"))
    n = F.col("n")
    squares = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("q")).join(unit.groupBy("label").agg(F.count("*").alias("n")), "label")
    return squares.select("label", "n", F.round((F.col("q") - n) / (n * (n - 1)), 6).alias("mean_cosine"))


# Aliases of nations as another catalogue writes them: brackets, blanks, hyphens, case; the last three digits tell nations apart.
_ALIASES = "SELECT n_nationkey AS alias_id, CASE n_nationkey % 3 WHEN 0 THEN ' ' || upper(n_name) || ' ' WHEN 1 THEN replace(n_name, '_', ' ') || ' (draft)' ELSE replace(n_name, '_', '-') END AS alias FROM nation"
_KEY_SQL = "regexp_replace(lower(trim(regexp_replace({x}, '\\([^)]*\\)', '', 'g'))), '[^a-z0-9]+', '', 'g')"


@query(
    "alias_join",
    f"""WITH al AS ({_ALIASES}), k AS (SELECT alias_id, alias, {_KEY_SQL.format(x='alias')} AS key FROM al), n AS (SELECT n_nationkey, n_name, {_KEY_SQL.format(x='n_name')} AS key FROM nation),
    c AS (SELECT key, min(n_name) AS name, count(*) AS n_names FROM n GROUP BY key)
    SELECT alias_id, alias, k.key, CASE WHEN n_names = 1 THEN name END AS canonical, CASE WHEN n_names IS NULL THEN 'unknown' WHEN n_names > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM k LEFT JOIN c ON c.key = k.key""",
)
def alias_join(spark, sf_dir):
    """Aliases matched to canonical names by their normalised form, with what had no name or several."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    kind, name = F.col("n_nationkey") % 3, F.col("n_name")
    written = F.when(kind == 0, F.concat(F.lit(" "), F.upper(name), F.lit(" "))).when(kind == 1, F.concat(F.replace(name, F.lit("_"), F.lit(" ")), F.lit(" (draft)"))).otherwise(F.replace(name, F.lit("_"), F.lit("-")))
    aliases = nation.select(F.col("n_nationkey").alias("alias_id"), written.alias("alias"))
    return contracts.alias_join(aliases, nation, "alias", "n_name").select("alias_id", "alias", "key", "canonical", "status")


@query("control_and_missing_labels", "SELECT l AS label, CASE WHEN l IS NULL THEN true ELSE lower(trim(l)) IN ('', 'control', 'ctrl', 'non-targeting', 'nt', 'mock', 'vehicle', 'dmso', 'nan', 'none', 'null') OR starts_with(lower(trim(l)), 'ctrl') OR starts_with(lower(trim(l)), 'control') END AS is_control, l IS NULL OR lower(trim(l)) IN ('', 'nan', 'none', 'null') AS is_missing, count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN ' Ctrl_1' WHEN 'O' THEN 'geneA' WHEN 'P' THEN 'NaN' END AS l FROM orders) GROUP BY l")
def control_and_missing_labels(spark, sf_dir):
    status = F.col("o_orderstatus")
    label = F.when(status == "F", " Ctrl_1").when(status == "O", "geneA").when(status == "P", "NaN")
    rows = table(spark, sf_dir, "orders").select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return rows.select("label", scalars.is_control(F.col("label")).alias("is_control"), scalars.is_missing(F.col("label")).alias("is_missing"), "n")


@query("identity_hash_split", "WITH h AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('split' || chr(0) || CAST(c_custkey AS VARCHAR))) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, CASE WHEN k <= round_even(n * 0.6, 0) THEN 'fit' WHEN k <= round_even(n * 0.8, 0) THEN 'calibration' ELSE 'test' END AS part FROM h")
def identity_hash_split(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", scalars.salted("split", F.col("c_custkey")).alias("salt"))
    rows = metrics.hash_positions(rows, ["c_mktsegment"], "salt", "c_custkey", "k")
    upto = lambda share: F.bround(F.col("n") * share, 0)
    return rows.select("c_custkey", F.when(F.col("k") <= upto(0.6), "fit").when(F.col("k") <= upto(0.8), "calibration").otherwise("test").alias("part"))


@query("cartesian_setting_split", f"WITH {CELLS}, p AS (SELECT context, perturbation, count(*) AS n_cells FROM cells GROUP BY ALL), s AS (SELECT *, context = 'BUILDING' AS uc, {views.fold_sql('perturbation', 5)} = 0 AS up FROM p) SELECT context, perturbation, n_cells, CASE WHEN uc AND up THEN 'context_and_perturbation_unseen' WHEN uc THEN 'context_unseen_row' WHEN up THEN 'perturbation_unseen_column' WHEN {views.fold_sql('''context || '|' || perturbation''', 10)} = 0 THEN 'random_missing_pair' ELSE 'source_train_pair' END AS setting FROM s")
def cartesian_setting_split(spark, sf_dir):
    pairs = views.cells(spark, sf_dir).groupBy("context", "perturbation").agg(F.count("*").alias("n_cells"))
    fold = lambda c, n: scalars.fold(F.sha2(c, 256), n)
    row, column = F.col("context") == "BUILDING", fold(F.col("perturbation"), 5) == 0
    missing = fold(F.concat_ws("|", "context", "perturbation"), 10) == 0
    setting = F.when(row & column, "context_and_perturbation_unseen").when(row, "context_unseen_row").when(column, "perturbation_unseen_column").when(missing, "random_missing_pair").otherwise("source_train_pair")
    return pairs.withColumn("setting", setting)


@query("leakage_audit", f"WITH {EVENTS}, s AS (SELECT *, {views.split_sql('event_id')} AS split FROM ev), t AS (SELECT DISTINCT dataset, cluster FROM s WHERE split = 'train') SELECT s.dataset, count(*) AS n_test, count(t.cluster) AS n_seen FROM s LEFT JOIN t USING (dataset, cluster) WHERE split = 'test' GROUP BY s.dataset")
def leakage_audit(spark, sf_dir):
    rows = views.splits(views.scored_events(spark, sf_dir), "event_id")
    pairs = rows.groupBy("dataset", "cluster").agg(F.count_if(F.col("split") == "test").alias("test"), F.bool_or(F.col("split") == "train").alias("seen")).filter("test > 0")
    return pairs.groupBy("dataset").agg(F.sum("test").alias("n_test"), F.sum(F.when(F.col("seen"), F.col("test")).otherwise(0)).alias("n_seen"))


@query(
    "contract_issues",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey FROM orders)
    SELECT 'status_outside_enum' AS rule, count(*) AS n FROM o WHERE o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL UNION ALL SELECT 'price_not_positive', count(*) FROM o WHERE o_totalprice <= 0 OR o_totalprice IS NULL
    UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT o_orderkey FROM o GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unknown_customer', count(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def contract_issues(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    count = lambda rule, rows: rows.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
    fails = {
        "status_outside_enum": o.filter(~F.coalesce(F.col("o_orderstatus").isin("F", "O"), F.lit(False))),
        "price_not_positive": o.filter(~F.coalesce(F.col("o_totalprice") > 0, F.lit(False))),
        "repeated_key": o.groupBy("o_orderkey").count().filter("count > 1"),
        "unknown_customer": o.join(known, "o_custkey", "left_anti"),
    }
    first, *rest = (count(*x) for x in fails.items())
    for more in rest:
        first = first.unionByName(more)
    return first


@query("predictor_set_audit", f"WITH {EVENTS} SELECT cluster, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS observed, count(DISTINCT dataset) = 5 AS complete FROM ev GROUP BY cluster")
def predictor_set_audit(spark, sf_dir):
    seen = F.array_sort(F.collect_set("dataset"))  # a set of at most five names
    return views.scored_events(spark, sf_dir).groupBy("cluster").agg(F.array_join(seen, ",").alias("observed"), (F.size(seen) == 5).alias("complete"))


#: The reference's counts.
_REPLICATES, _PERMUTATIONS = 1000, 200
_SEED = "sha256('boot|' || dataset || '|' || r || '|' || slot)"


@query(
    "cluster_bootstrap_ci",
    f"""WITH {EVENTS}, k AS (SELECT dataset, cluster, sum(error) AS s, count(error) AS n FROM ev GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY cluster) - 1 AS slot, count(*) OVER (PARTITION BY dataset) AS m FROM k),
    d AS (SELECT dataset, r, CAST(concat('0x', substr({_SEED}, 1, 8)) AS BIGINT) % m AS pick FROM i, range(0, {_REPLICATES}) t(r)), b AS (SELECT d.dataset, d.r, sum(i.s) / sum(i.n) AS mean FROM d JOIN i ON i.dataset = d.dataset AND i.slot = d.pick GROUP BY ALL)
    SELECT dataset, round((SELECT avg(error) FROM ev WHERE ev.dataset = b.dataset), 6) AS estimate, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM b GROUP BY dataset""",
)
def cluster_bootstrap_ci(spark, sf_dir):
    return resampling.bootstrap_mean(views.scored_events(spark, sf_dir), ["dataset"], "cluster", "error", _REPLICATES, "boot").select("dataset", *rounded("estimate", "low", "high"))


@query(
    "permutation_null",
    f"""WITH {EVENTS}, k AS (SELECT cluster, avg(risk) AS risk FROM ev GROUP BY ALL HAVING avg(risk) IS NOT NULL AND cluster IS NOT NULL), er AS (SELECT dataset, cluster, avg(error) AS error FROM ev GROUP BY ALL),
    d AS (SELECT r, cluster, risk, row_number() OVER (PARTITION BY r ORDER BY CAST(concat('0x', substr(sha256('perm|' || r || '|' || cluster), 1, 8)) AS BIGINT), cluster) AS pos FROM k, range(0, {_PERMUTATIONS} + 1) t(r)),
    g AS (SELECT d.r, d.cluster, CASE WHEN d.r = 0 THEN d.risk ELSE b.risk END AS given FROM d JOIN d b ON b.r = 0 AND b.pos = d.pos),
    q AS (SELECT r, dataset, {rank_sql('given', 'r, dataset')} AS a, {rank_sql('error', 'r, dataset')} AS b FROM g JOIN er USING (cluster) WHERE error IS NOT NULL), s AS (SELECT r, dataset, {corr_sql('a', 'b')} AS rho FROM q GROUP BY ALL HAVING count(*) >= 3),
    t AS (SELECT r, median(rho) AS stat FROM s WHERE rho IS NOT NULL GROUP BY r), o AS (SELECT stat AS observed FROM t WHERE r = 0)
    SELECT round(observed, 6) AS observed, count(*) AS n_null, round((1 + count(*) FILTER (stat >= observed)) / (1 + count(*)), 6) AS p FROM t, o WHERE r > 0 GROUP BY observed""",
)
def permutation_null(spark, sf_dir):
    """Median over kinds of events of the correlation between a user's mean risk and mean error, against permutations of the users' risks."""
    ev = views.scored_events(spark, sf_dir)
    risk = ev.groupBy("cluster").agg(scalars.settled(F.avg("risk")).alias("risk"))
    errors = ev.groupBy("dataset", "cluster").agg(scalars.settled(F.avg("error")).alias("error"))
    rows = resampling.association_null(risk, errors, "cluster", "dataset", _PERMUTATIONS, "perm")
    return rows.select("n_null", *rounded("observed", "p"))


@query(
    "permuted_flags",
    f"""WITH {EVENTS}, k AS (SELECT dataset, cluster, sum(error) AS s, count(error) AS n, coalesce(avg(risk) > 50, false) AS f FROM ev GROUP BY ALL), m AS (SELECT dataset, count(*) FILTER (f) AS flagged FROM k GROUP BY ALL),
    d AS (SELECT k.dataset, r, s, n, CASE WHEN r = 0 THEN f ELSE row_number() OVER (PARTITION BY k.dataset, r ORDER BY CAST(concat('0x', substr(sha256('perm|' || r || '|' || cluster), 1, 8)) AS BIGINT), cluster) <= flagged END AS f FROM k JOIN m USING (dataset), range(0, {_PERMUTATIONS} + 1) t(r)),
    t AS (SELECT dataset, r, sum(s) FILTER (f) / sum(n) FILTER (f) - sum(s) FILTER (NOT f) / sum(n) FILTER (NOT f) AS stat FROM d GROUP BY ALL), o AS (SELECT dataset, stat AS observed FROM t WHERE r = 0)
    SELECT dataset, round(observed, 6) AS observed, round((1 + count(*) FILTER (r > 0 AND stat >= observed)) / ({_PERMUTATIONS} + 1), 6) AS p FROM t JOIN o USING (dataset) GROUP BY dataset, observed""",
)
def permuted_flags(spark, sf_dir):
    """Mean error of clusters whose mean risk exceeds 50 less that of the others, against permutations of which clusters these are."""
    ev = views.scored_events(spark, sf_dir)
    rows = resampling.permutation_p(ev, ["dataset"], "cluster", F.avg("risk") > 50, "error", _PERMUTATIONS, "perm")
    return rows.select("dataset", *rounded("observed", "p"))
