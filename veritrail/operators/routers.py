"""Risk models that carry over to a data set they have not seen, and what a ranking by risk is worth there.

Fits follow from sums of products: each cell (a data set, or a fold of one) is summed up once, and the rows that a fit leaves out are
taken from the whole. Data sets are few, so a row may meet every data set; it is never joined with other rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.scalars import keep_count
from veritrail.operators.leave_out import moments, scored, summed_moments
from veritrail.operators.metrics import ordered_positions, spearman
from veritrail.sources.storage import written

#: Shares kept when areas under the error curve of what is kept are taken.
COVERAGES = tuple(k / 20 for k in range(10, 21))


def ridge(m: np.ndarray, penalty: float, nonnegative: bool = False, least: int = 2) -> list[float] | None:
    """Intercept and coefficients from moments (the upper triangle of products of 1, features, target): squared error plus penalty times squared coefficients, features as they are; None below least rows."""
    size = int((np.sqrt(8 * len(m) + 1) - 1) / 2)
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = m
    full = full + np.triu(full, 1).T
    n = full[0, 0]
    if n < least:
        return None
    mean = full[0, 1:] / n
    centred = full[1:, 1:] - n * np.outer(mean, mean)
    gram, cross = centred[:-1, :-1] + penalty * np.eye(size - 2), centred[:-1, -1]
    if not nonnegative:
        b = np.linalg.lstsq(gram, cross, rcond=1e-12)[0]
    else:
        b = np.zeros(size - 2)
        for _ in range(20_000):
            before = b.copy()
            for j in range(len(b)):
                if gram[j, j] > 0:
                    b[j] = max(0.0, b[j] + (cross[j] - gram[j] @ b) / gram[j, j])
            if np.abs(b - before).max(initial=0.0) < 1e-14:
                break
    return [float(mean[-1] - mean[:-1] @ b), *map(float, b)]


def meta_fits(train: DataFrame, dataset: str, fold: str, features: list[str], target: str, penalty: float = 10.0) -> DataFrame:
    """(dataset, n, b): of each data set the ridge without negative coefficients on the rows of all others.

    Every other data set weighs the same, within it every fold, within that every row; weights add up to n, the rows fitted on. Rows that
    lack a value are left out. b is null where there is no other data set.
    """
    cells = moments(train, [dataset, fold], [F.col(f) for f in features], F.col(target))
    cells = cells.select(dataset, fold, F.get("m", F.lit(0)).alias("__n"), F.posexplode("m").alias("__k", "__v"))
    sets = cells.groupBy(dataset, "__k").agg(F.avg(F.col("__v") / F.col("__n")).alias("__v"), F.sum("__n").alias("__n"))
    sets = written(sets.groupBy(dataset).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__v"))), lambda s: s["__v"]).alias("m"), F.max("__n").alias("__n")).withColumn("__all", F.lit(0)))
    whole = summed_moments(sets, ["__all"]).withColumnRenamed("m", "__w").join(sets.groupBy("__all").agg(F.count("*").alias("__sets"), F.sum("__n").alias("__rows")), "__all")
    rows = F.col("__rows") - F.col("__n")
    rest = F.zip_with("__w", "m", lambda w, own: (w - own) / F.nullif(F.col("__sets") - 1, F.lit(0)) * rows)
    fits = sets.join(whole, "__all").select(dataset, F.round(rows).cast("long").alias("n"), rest.alias("m"))

    @F.arrow_udf("array<double>")
    def solve(m: pa.Array) -> pa.Array:
        found = [None if None in row else ridge(np.array(row), penalty, nonnegative=True) for row in m.to_pylist()]
        return pa.array(found, pa.list_(pa.float64()))

    return written(fits.withColumn("b", solve("m")).drop("m"))


def meta_router(rows: DataFrame, dataset: str, fold: str, features: list[str], target: str, out: str, penalty: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """rows with out, the risk by the fit that leaves their data set out, and the fits (dataset, n, b).

    Rows of a data set that is alone are left out, and out is null where a feature is missing.
    """
    fits = meta_fits(rows, dataset, fold, features, target, penalty)
    return scored(rows, fits, [dataset], features, out), fits


def _dot(b: Column, features: list[str]) -> Column:
    x = F.array(F.lit(1.0), *(F.col(f).cast("double") for f in features))
    return F.aggregate(F.zip_with(b, x, lambda w, v: w * v), F.lit(0.0), lambda s, v: s + v)


def _chosen_fits(rows: DataFrame, dataset: str, features: list[str], target: str, penalties: list[float]) -> tuple[DataFrame, DataFrame]:
    """Of rows (__target, dataset, ...): (__target, __penalty, __b) and (__target, dataset, __b), fits on all rows of a target and on those of all its other data sets.

    A target's penalty has the least mean absolute error over its rows, each judged by a fit without its data set; of equal ones the least.
    """
    cells = written(moments(rows, ["__target", dataset], [F.col(f) for f in features], F.col(target)))
    whole = written(summed_moments(cells, ["__target"]).withColumnRenamed("m", "__w"))

    @F.arrow_udf("array<array<double>>")
    def solve(m: pa.Array) -> pa.Array:
        found = [[ridge(np.array(row), p) for p in penalties] for row in m.to_pylist()]
        return pa.array(found, pa.list_(pa.list_(pa.float64())))

    rest = F.zip_with("__w", "m", lambda w, own: w - own)
    without = written(cells.join(whole, "__target").select("__target", dataset, solve(rest).alias("__bs")))
    apart = [F.abs(_dot(F.get("__bs", F.lit(k)), features) - F.col(target)) for k in range(len(penalties))]
    judged = rows.join(without, ["__target", dataset]).groupBy("__target").agg(F.array(*(F.avg(a) for a in apart)).alias("__maes"))
    place = F.greatest(F.array_position("__maes", F.array_min("__maes")) - 1, F.lit(0)).cast("int")
    choice = written(judged.select("__target", F.coalesce(place, F.lit(0)).alias("__at")))
    of = lambda df, m: df.join(choice, "__target").withColumn("__b", F.get(m, F.col("__at")))
    final = of(whole.withColumn("__bs", solve("__w")), F.col("__bs"))
    penalty = F.get(F.array(*map(F.lit, penalties)), F.col("__at"))
    return written(final.select("__target", penalty.alias("__penalty"), "__b")), written(of(without, F.col("__bs")).select("__target", dataset, "__b"))


def residual_risk(rows: DataFrame, dataset: str, base: list[str], extra: list[str], target: str, penalties: tuple[float, ...] = (0.0, 0.1, 1.0, 10.0, 100.0)) -> tuple[DataFrame, DataFrame]:
    """rows with base_risk and risk, and the fits (dataset, base_penalty, base_b, residual_penalty, residual_b).

    For each data set a ridge of the target on the base features is fitted on all others, then a ridge on the extra features of what the
    base leaves, as seen by base fits without the row's data set. Penalties are chosen among the other data sets alone. risk is the sum
    of both. Rows that lack a value are not fitted on; with fewer than three data sets risk is null.
    """
    penalties = sorted(penalties)
    known = rows.select(dataset, *dict.fromkeys([*base, *extra, target])).dropna()
    sets = rows.select(F.col(dataset).alias("__target")).distinct()  # few
    listed = sets.groupBy().agg(F.collect_set("__target").alias("__targets"))  # one row
    source = known.join(F.broadcast(listed)).withColumn("__target", F.explode("__targets")).drop("__targets").filter(F.col("__target") != F.col(dataset))
    base_fits, out_of_fold = _chosen_fits(source, dataset, base, target, penalties)
    seen = source.join(out_of_fold, ["__target", dataset]).withColumn("__left", F.col(target) - _dot(F.col("__b"), base)).drop("__b").filter("__left is not null")
    residual_fits = _chosen_fits(written(seen.select("__target", dataset, *extra, "__left")), dataset, extra, "__left", penalties)[0]
    named = lambda df, name: df.select(F.col("__target").alias(dataset), F.col("__penalty").alias(f"{name}_penalty"), F.col("__b").alias(f"{name}_b"))
    fits = written(named(base_fits, "base").join(named(residual_fits, "residual"), dataset, "left"))
    both = rows.join(fits.select(dataset, F.col("base_b").alias("__b"), F.col("residual_b").alias("__r")), dataset, "left")
    out = both.withColumn("base_risk", _dot(F.col("__b"), base))
    return out.withColumn("risk", F.col("base_risk") + _dot(F.col("__r"), extra)).select(*rows.columns, "base_risk", "risk"), fits


def triage(df: DataFrame, group: list[str], score: str, error: str, tie: str, share: float = 0.2) -> DataFrame:
    """What rejecting the riskiest rows is worth, for each group: the rank correlation (0 where there is none), the area under the mean
    error of what is kept from half of the rows to all over the mean error, and of the riskiest share of rows their mean error over all,
    the part of the mean error that goes with them and their part of all error. Rows of equal score stand in the order of tie; rows
    that lack a value or a group are left out; ratios are null where all errors are zero.
    """
    known = df.dropna(subset=[*group, score, error])
    rows = ordered_positions(known, group, score, [tie], "__at")
    keep = {c: keep_count(F.col("n"), F.lit(c)) for c in COVERAGES}
    kept = [F.avg(F.when(F.col("__at") <= k, F.col(error))) for k in keep.values()]
    high = F.col("__at") > F.col("n") - keep_count(F.col("n"), F.lit(share))
    found = rows.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.avg(error).alias("__mean"),
        F.sum(error).alias("__sum"),
        F.array(*kept).alias("__kept"),
        F.avg(F.when(high, F.col(error))).alias("__high"),
        F.avg(F.when(~high, F.col(error))).alias("__low"),
        F.sum(F.when(high, F.col(error))).alias("__part"),
    )
    step, last = COVERAGES[1] - COVERAGES[0], len(COVERAGES) - 1
    area = sum((F.get("__kept", F.lit(k)) * (0.5 if k in (0, last) else 1.0) for k in range(last + 1)), F.lit(0.0)) * step / (COVERAGES[-1] - COVERAGES[0])
    out = found.select(
        *group,
        "n",
        F.try_divide(area, F.col("__mean")).alias("normalized_aurc"),
        F.try_divide("__high", "__mean").alias("enrichment"),
        F.try_divide(F.col("__mean") - F.col("__low"), F.col("__mean")).alias("reduction"),
        F.try_divide("__part", "__sum").alias("capture"),
    )
    return out.join(spearman(known, group, score, error).select(*group, F.coalesce("rho", F.lit(0.0)).alias("rho")), group)
