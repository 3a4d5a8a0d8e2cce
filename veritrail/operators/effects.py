"""Effects of perturbations from long observations (cell, context, perturbation, gene, x), where absent rows are zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.sources.storage import Scratch, written

#: Rows of a task that adds up cells, about.
TASK_ROWS = 1 << 18


def pseudobulk(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gene, mean, variance, n_cells): sample statistics over all cells of a key, zeros of absent genes included."""
    sizes = cells.groupBy(*keys).agg(F.count_distinct("cell").alias("n_cells"))
    x = F.col("x")
    sums = cells.groupBy(*keys, "gene").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    n = F.col("n_cells")
    mean = F.col("s") / n
    return sums.join(sizes, keys).select(*keys, "gene", mean.alias("mean"), F.try_divide(F.col("q") - n * mean * mean, n - 1).alias("variance"), "n_cells")


def control_effects(cells: DataFrame, control: str, context: list[str], least_cells: int = 1) -> DataFrame:
    """(context, perturbation, gene, effect, n_cells): mean of a perturbation less the control's mean in the same context.

    Means and effects are written, as they are far smaller than the cells and have several readers.
    """
    means = written(pseudobulk(cells, [*context, "perturbation"]))
    base = means.filter(F.col("perturbation") == control).select(*context, "gene", F.col("mean").alias("base"))
    treated = means.filter((F.col("perturbation") != control) & (F.col("n_cells") >= least_cells)).join(base.select(*context).distinct(), context, "left_semi")
    # a gene that only one side has counts as zero on the other
    sizes = treated.select(*context, "perturbation", "n_cells").distinct()
    grid = sizes.join(base, context)
    both = grid.join(treated.drop("n_cells", "variance"), [*context, "perturbation", "gene"], "left").select(*context, "perturbation", "gene", "n_cells", (F.coalesce("mean", F.lit(0.0)) - F.col("base")).alias("effect"))
    alone = treated.join(base, [*context, "gene"], "left_anti").select(*context, "perturbation", "gene", "n_cells", F.col("mean").alias("effect"))
    return written(both.unionByName(alone))


def batch_matched_effects(cells: DataFrame, control: str) -> DataFrame:
    """Effects against control means of each batch, weighted by the batches' perturbed cells; batches without control are left out."""
    by_batch = control_effects(cells, control, ["context", "batch"])
    keys = ["context", "perturbation"]
    weights = by_batch.select(*keys, "batch", "n_cells").distinct().groupBy(*keys).agg(F.sum("n_cells").alias("all_cells"))
    sums = by_batch.groupBy(*keys, "gene").agg(F.sum(F.col("n_cells") * F.col("effect")).alias("s"))  # a gene without rows in a batch adds nothing
    return sums.join(weights, keys).select(*keys, "gene", (F.col("s") / F.col("all_cells")).alias("effect"), F.col("all_cells").alias("n_cells"))


def leave_own_context_out(effects: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """effects with others_mean: over the same keys in all other contexts, from sums less the row's own; null if there are none."""
    sums = effects.groupBy(*keys).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    return effects.join(sums, keys).withColumn("others_mean", F.try_divide(F.col("__s") - F.col(value), F.col("__n") - 1)).drop("__s", "__n")


def energy_distances(cells: DataFrame, control: str, context: list[str]) -> DataFrame:
    """(context, perturbation, n_cells, delta, sigma_control, sigma, energy): cells as vectors over genes, against the context's control.

    delta is the mean squared distance between the two sides' cells, sigma that between two cells of a side (with n - 1; null for one
    cell), energy 2 delta less both sigmas. All from counts, sums and sums of squares of each gene; absent genes are zeros. Cells are dealt
    to tasks of about TASK_ROWS rows, so more rows are more tasks and not larger ones.
    """
    keys = [*context, "perturbation"]
    x, n, m = F.col("x"), F.col("n_cells"), F.col("mean")
    with Scratch(cells.sparkSession) as scratch:
        rows = scratch.written(cells.select(*keys, "cell", "gene", "x"))
        tasks = max(-(-rows.count() // TASK_ROWS), 1)
        vectors = rows.repartition(tasks, *keys, "cell").groupBy(*keys, "cell", "gene").agg(F.sum("x").alias("x"))  # a cell's repeated rows add up
        first = F.row_number().over(Window.partitionBy(*keys, "cell").orderBy("gene")) == 1  # a cell's genes
        vectors = vectors.withColumn("first", first & F.col("cell").isNotNull())
        sums = written(vectors.groupBy(*keys, "gene").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.count_if("first").alias("first")))
    sizes = sums.groupBy(*keys).agg(F.sum("first").alias("n_cells"))
    genes = written(sums.drop("first").join(sizes, keys).withColumn("mean", F.col("s") / n))
    sides = genes.groupBy(*keys, "n_cells").agg(F.sum("q").alias("q"), F.sum(m * m).alias("m2"))
    sides = sides.withColumn("sigma", F.try_divide(2 * (F.col("q") - n * F.col("m2")), n - 1)).withColumn("power", F.col("q") / n)
    is_control = F.col("perturbation") == control
    base = sides.filter(is_control).select(*context, F.col("sigma").alias("sigma_control"), F.col("power").alias("base_power"))
    base_genes = genes.filter(is_control).select(*context, "gene", m.alias("base_mean"))
    across = genes.filter(~is_control).join(base_genes, [*context, "gene"]).groupBy(*keys).agg(F.sum(m * F.col("base_mean")).alias("inner"))
    rows = sides.filter(~is_control).join(base, context).join(across, keys, "left")
    delta = F.col("power") + F.col("base_power") - 2 * F.coalesce("inner", F.lit(0.0))
    return rows.withColumn("delta", delta).select(*keys, "n_cells", "delta", "sigma_control", "sigma", (2 * F.col("delta") - F.col("sigma_control") - F.col("sigma")).alias("energy"))


def split_half_noise(cells: DataFrame, masks: DataFrame, control: str, repeats: int, least: int) -> DataFrame:
    """(context, perturbation, n_cells, n_repeats, rmse_mean, rmse_sd, pearson_error, cosine_error): how far effects of two halves of the cells lie apart.

    masks is (context, perturbation, batch, cell, mask) of half_masks, for controls too. An effect is a half's mean less that of the
    control's half; absent rows are zeros, over all genes of cells. Repeats with fewer than least cells in a half, of the perturbation or
    of its control, do not count; errors are 1 - r and 1 - cosine, null where an effect is constant or zero.
    """
    keys = ["context", "perturbation"]
    left = lambda r: F.col("mask").bitwiseAND(1 << r) != 0
    sizes = masks.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.count_if(left(r)) for r in range(repeats))).alias("n_left"))
    joined = cells.join(masks, [*keys, "batch", "cell"])
    sums = joined.groupBy(*keys, "gene").agg(F.sum("x").alias("s"), F.array(*(F.coalesce(F.sum(F.when(left(r), F.col("x"))), F.lit(0.0)) for r in range(repeats))).alias("s_left"))
    return noise_of_sums(sizes, sums, control, repeats, least)


def noise_of_sums(sizes: DataFrame, sums: DataFrame, control: str, repeats: int, least: int) -> DataFrame:
    """split_half_noise from (context, perturbation, n, n_left) and (context, perturbation, gene, s, s_left), arrays of a number for each repeat."""
    keys = ["context", "perturbation"]
    sizes, sums = written(sizes), written(sums)
    of = lambda df, own, **names: df.filter((F.col("perturbation") == control) == F.lit(not own)).select(*(F.col(c).alias(names.get(c, c)) for c in df.columns if own or c != "perturbation"))
    base = of(sums, False, s="cs", s_left="cs_left")
    pairs = of(sizes, True).join(of(sizes, False, n="cn", n_left="cn_left"), "context")
    treated = of(sums, True)
    grid = pairs.join(base, "context").join(treated, [*keys, "gene"], "left")
    alone = pairs.join(treated, keys).join(base.select("context", "gene"), ["context", "gene"], "left_anti").withColumns({"cs": F.lit(None).cast("double"), "cs_left": F.lit(None).cast("array<double>")})
    both = grid.unionByName(alone)
    zeros = F.array_repeat(F.lit(0.0), repeats)
    both = both.withColumns({"s": F.coalesce("s", F.lit(0.0)), "cs": F.coalesce("cs", F.lit(0.0)), "s_left": F.coalesce("s_left", zeros), "cs_left": F.coalesce("cs_left", zeros)})
    rows = both.select(*keys, "n", "cn", "s", "cs", F.posexplode(F.arrays_zip("s_left", "cs_left", "n_left", "cn_left")).alias("repeat", "h")).select(*keys, "n", "cn", "s", "cs", "repeat", "h.*")
    enough = F.least("n_left", F.col("n") - F.col("n_left"), "cn_left", F.col("cn") - F.col("cn_left")) >= least
    a = F.col("s_left") / F.col("n_left") - F.col("cs_left") / F.col("cn_left")
    b = (F.col("s") - F.col("s_left")) / (F.col("n") - F.col("n_left")) - (F.col("cs") - F.col("cs_left")) / (F.col("cn") - F.col("cn_left"))
    rows = rows.filter(enough).select(*keys, "n", "repeat", a.alias("a"), b.alias("b"))
    moments = {"aa": "a * a", "bb": "b * b", "ab": "a * b", "sa": "a", "sb": "b"}
    found = rows.groupBy(*keys, "n", "repeat").agg(*(F.sum(F.expr(e)).alias(k) for k, e in moments.items()))
    genes = sums.agg(F.count_distinct("gene").alias("g"))
    found = found.join(F.broadcast(genes))  # one row
    g, c = F.col("g"), F.col
    spread = lambda q, s: c(q) - c(s) * c(s) / g
    rmse = F.sqrt(F.greatest(c("aa") + c("bb") - 2 * c("ab"), F.lit(0.0)) / g)
    size, wide = c("aa") * c("bb"), spread("aa", "sa") * spread("bb", "sb")
    pearson = F.when(wide > 1e-18, 1 - (c("ab") - c("sa") * c("sb") / g) / F.sqrt(wide))
    cosine = F.when(size > 1e-18, 1 - c("ab") / F.sqrt(size))
    by_repeat = found.select(*keys, "n", rmse.alias("rmse"), pearson.alias("pearson"), cosine.alias("cosine"))
    return by_repeat.groupBy(*keys, F.col("n").alias("n_cells")).agg(F.count("*").alias("n_repeats"), F.avg("rmse").alias("rmse_mean"), F.stddev_samp("rmse").alias("rmse_sd"), F.avg("pearson").alias("pearson_error"), F.avg("cosine").alias("cosine_error"))
