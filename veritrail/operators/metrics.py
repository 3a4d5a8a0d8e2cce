"""Reliability statistics of scored rows: rank correlation, selective prediction, detection, multiple testing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions.ranks import average_ranks_of, by_value, quantiles, running
from veritrail.functions.scalars import keep_count
from veritrail.sources.storage import written


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null if one side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, group: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(group, n, rho) with average ranks; rho is null below least rows or if one side is constant."""
    ranked = average_ranks_of(df, group, {x: "__rx", y: "__ry"})
    out = ranked.groupBy(*group).agg(F.count("*").alias("n"), correlation("__rx", "__ry").alias("rho"))
    return out.withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))


def partial_spearman(df: DataFrame, group: list[str], x: str, y: str, control: str, least: int = 5) -> DataFrame:
    """(group, n, rho) of x and y with the control's ranks taken out of both."""
    rows = average_ranks_of(df, group, {x: "__x", y: "__y", control: "__c"})
    out = rows.groupBy(*group).agg(F.count("*").alias("n"), correlation("__x", "__y").alias("xy"), correlation("__x", "__c").alias("xc"), correlation("__y", "__c").alias("yc"))
    rest = (1 - F.col("xc") * F.col("xc")) * (1 - F.col("yc") * F.col("yc"))
    rho = F.when((rest > 1e-12) & (F.col("n") >= least), (F.col("xy") - F.col("xc") * F.col("yc")) / F.sqrt(rest))
    return out.select(*group, "n", rho.alias("rho"))


def partial_spearman_two(df: DataFrame, group: list[str], x: str, y: str, first: str, second: str, least: int = 6) -> DataFrame:
    """(group, n, rho) of x and y with the ranks of two covariates taken out of both, from the correlations of all ranks."""
    rows = average_ranks_of(df, group, {x: "__x", y: "__y", first: "__c", second: "__d"})
    pairs = [("x", "y"), ("x", "c"), ("y", "c"), ("x", "d"), ("y", "d"), ("c", "d")]
    out = rows.groupBy(*group).agg(F.count("*").alias("n"), *(correlation(f"__{a}", f"__{b}").alias(a + b) for a, b in pairs))

    def without(ab: Column, ac: Column, bc: Column) -> Column:
        rest = (1 - ac * ac) * (1 - bc * bc)
        return F.when(rest > 1e-12, (ab - ac * bc) / F.sqrt(rest))

    r = {k: F.col(k) for k in ("xy", "xc", "yc", "xd", "yd", "cd")}
    once = without(r["xy"], r["xc"], r["yc"]), without(r["xd"], r["xc"], r["cd"]), without(r["yd"], r["yc"], r["cd"])
    return out.select(*group, "n", F.when(F.col("n") >= least, without(*once)).alias("rho"))


def risk_coverage(df: DataFrame, group: list[str], risk: str, error: str, tie: str) -> DataFrame:
    """Rows in order of risk (then tie): n_kept, coverage and the mean error of what is kept so far."""
    known = df.filter(F.col(risk).isNotNull() & F.col(error).isNotNull())
    rows = running(known, group, risk, {"rows": F.lit(1), "error": F.col(error)}, [tie])
    kept = F.col("before_rows") + 1
    return rows.select(*group, tie, risk, error, kept.alias("n_kept"), (kept / F.col("total_rows")).alias("coverage"), ((F.col("before_error") + F.col(error)) / kept).alias("selective_risk"))


def selective_summary(df: DataFrame, group: list[str], risk: str, error: str, tie: str) -> DataFrame:
    """AURC over all thresholds with those of a perfect and of a random order, and what these say together."""
    curve = risk_coverage(df, group, risk, error, tie).groupBy(*group).agg(F.count("*").alias("n"), F.avg("selective_risk").alias("aurc"), F.avg(error).alias("random_aurc"))
    known = df.filter(F.col(risk).isNotNull() & F.col(error).isNotNull()).withColumn("__error", F.col(error))
    best = risk_coverage(known, group, "__error", error, tie).groupBy(*group).agg(F.avg("selective_risk").alias("oracle_aurc"))
    out = curve.join(best, group)
    gap = F.col("random_aurc") - F.col("aurc")
    return out.select(
        *group,
        "n",
        "aurc",
        "oracle_aurc",
        "random_aurc",
        (F.col("aurc") - F.col("oracle_aurc")).alias("excess_aurc"),
        F.try_divide("aurc", "random_aurc").alias("normalized_aurc"),
        (100 * F.try_divide(gap, F.col("random_aurc"))).alias("reduction_pct"),
        (100 * F.try_divide(gap, F.col("random_aurc") - F.col("oracle_aurc"))).alias("gap_captured_pct"),
    ).filter("n >= 2")


def tie_aware_risk(df: DataFrame, group: list[str], risk: str, error: str, coverages: list[float]) -> DataFrame:
    """Mean error at each coverage, expected over all orders of rows with equal risk."""
    values = by_value(df.filter(F.col(risk).isNotNull() & F.col(error).isNotNull()), group, risk, {"error": F.col(error)})
    grid = values.withColumn("coverage", F.explode(F.array(*map(F.lit, coverages))))
    k = keep_count(F.col("total_n"), F.col("coverage"))
    held = grid.withColumn("k", k).filter((F.col("before_n") < F.col("k")) & (F.col("k") <= F.col("before_n") + F.col("n")))
    part = F.col("before_error") + (F.col("k") - F.col("before_n")) / F.col("n") * F.col("error")
    return held.select(*group, "coverage", "k", (part / F.col("k")).alias("risk"))


def trapezoid(curve: DataFrame, group: list[str], x: str, y: str, out: str) -> DataFrame:
    """Area under y over x, divided by the span of x; a curve has few points."""
    w = Window.partitionBy(*group).orderBy(x)
    parts = curve.withColumn("__dx", F.lead(x).over(w) - F.col(x)).withColumn("__y", (F.lead(y).over(w) + F.col(y)) / 2)
    return parts.groupBy(*group).agg((F.sum(F.col("__dx") * F.col("__y")) / (F.max(x) - F.min(x))).alias(out))


def ordered_positions(df: DataFrame, group: list[str], order: str, tie: list[str], out: str) -> DataFrame:
    """df with its position (from 1) in the order, and n, the group's size."""
    rows = running(df, group, order, {"rows": F.lit(1)}, tie)
    return rows.withColumn(out, F.col("before_rows") + 1).withColumn("n", F.col("total_rows")).drop("before_rows", "total_rows")


def hash_positions(df: DataFrame, group: list[str], digest: str, tie: str, out: str) -> DataFrame:
    """df with its position (from 1) in the order of a hex digest, then tie, and n, the group's size; the digest's first 15 digits cut the ranges."""
    rows = df.withColumn("__digits", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    rows = running(rows, group, "__digits", {"rows": F.lit(1)}, [digest, tie])
    return rows.withColumn(out, F.col("before_rows") + 1).withColumn("n", F.col("total_rows")).drop("before_rows", "total_rows", "__digits")


def tails(df: DataFrame, group: list[str], risk: str, error: str, tie: str, share: float = 0.2) -> DataFrame:
    """Mean and median error of the least and the most risky ceil(share * n) rows."""
    rows = ordered_positions(df.filter(F.col(risk).isNotNull() & F.col(error).isNotNull()), group, risk, [tie], "at")
    size = keep_count(F.col("n"), F.lit(share))
    good, bad = F.when(F.col("at") <= size, F.col(error)), F.when(F.col("at") > F.col("n") - size, F.col(error))
    out = rows.groupBy(*group).agg(F.count("*").alias("n_total"), F.count(good).alias("n_tail"), F.avg(good).alias("good_mean"), F.avg(bad).alias("bad_mean"))
    for name, side in (("good_median", good), ("bad_median", bad)):
        out = out.join(quantiles(rows, group, side, {name: 0.5}), group)
    return out.filter("n_total >= 5").withColumn("improve_pct", 100 * F.try_divide(F.col("bad_mean") - F.col("good_mean"), F.col("bad_mean")))


def failure_detection(df: DataFrame, group: list[str], risk: str, error: str, quantile: float = 0.8) -> DataFrame:
    """AUROC and average precision of risk as a detector of errors at or above their quantile."""
    known = df.filter(F.col(risk).isNotNull() & F.col(error).isNotNull())
    limits = quantiles(known, group, F.col(error), {"threshold": quantile})
    flagged = known.join(limits, group).withColumn("__bad", (F.col(error) >= F.col("threshold")).cast("long"))
    values = by_value(flagged.withColumn("__down", -F.col(risk)), group, "__down", {"bad": F.col("__bad")})
    good_here, good_ahead = F.col("n") - F.col("bad"), F.col("before_n") - F.col("before_bad")
    positives, negatives = F.col("total_bad"), F.col("total_n") - F.col("total_bad")
    wins = good_here * (F.col("before_bad") + F.col("bad") / 2)
    precision = (F.col("before_bad") + F.col("bad")) / (F.col("before_n") + F.col("n"))
    out = values.groupBy(*group).agg(
        F.max("total_n").alias("n"),
        F.max("total_bad").alias("n_failure"),
        F.try_divide(F.sum(wins), F.max(positives * negatives)).alias("auroc"),
        F.try_divide(F.sum(precision * F.col("bad")), F.max(positives)).alias("auprc"),
    )
    return out.filter("n >= 8 and n_failure > 0 and n_failure < n").join(limits, group)


def quantile_buckets(df: DataFrame, group: list[str], value: str, out: str, bins: int) -> DataFrame:
    """df with the number (from 1) of value's quantile bin in its group, right-closed, equal edges merged."""
    shares = [k / bins for k in range(1, bins)]
    marks = {f"__e{k}": share for k, share in enumerate(shares)}
    edges = quantiles(df, group, F.col(value), marks).select(*group, F.array_distinct(F.array(*marks)).alias("__edges"))
    rows = df.join(edges.join(df.groupBy(*group).agg(F.min(value).alias("__low")), group), group)
    above = F.filter("__edges", lambda e: (e < F.col(value)) & (e > F.col("__low")))
    return rows.withColumn(out, F.size(above) + 1).drop("__edges", "__low")


def adjusted(df: DataFrame, family: list[str], p: str, tie: str, method: str) -> DataFrame:
    """df with adjusted p values ("bh": step-up false discovery rate, "holm": step-down); a family is a list of tests, so small."""
    w = Window.partitionBy(*family)
    rank, n = F.row_number().over(w.orderBy(p, tie)), F.count("*").over(w)
    if method == "bh":
        raw, order = F.col(p) * n / rank, w.orderBy(F.col("__rank").desc())
        ordered = F.min("__raw").over(order.rowsBetween(Window.unboundedPreceding, 0))
    else:
        raw, order = F.col(p) * (n - rank + 1), w.orderBy("__rank")
        ordered = F.max("__raw").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumns({"__rank": rank, "__raw": raw})
    return rows.withColumn(f"{p}_{method}", F.least(ordered, F.lit(1.0))).drop("__rank", "__raw")


def within_magnitude(df: DataFrame, group: list[str], risk: str, error: str, magnitude: str, tie: str, bins: int = 4, least: int = 5) -> DataFrame:
    """(group, bin, n, low, high, rho): rank correlation of risk and error within bins of equal counts of magnitude, from 0.

    Rows that lack a value are left out, groups of fewer than 4 rows a bin give none, and rho is null below least rows of a bin.
    """
    rows = ordered_positions(df.dropna(subset=[risk, error, magnitude]).withColumn("__all", F.lit(0)), ["__all", *group], magnitude, [tie], "__at").filter(F.col("n") >= 4 * bins)
    of = F.greatest(F.lit(1), F.ceil((F.col("__at") - 1) * float(bins) / F.greatest(F.col("n") - 1, F.lit(1)) - F.lit(1e-9))).cast("int") - 1
    rows = written(rows.withColumn("bin", of).drop("n"))
    keys = [*group, "bin"]
    ranges = rows.groupBy(*keys).agg(F.min(magnitude).alias("low"), F.max(magnitude).alias("high"))
    return spearman(rows, keys, risk, error, least).join(ranges, keys)
