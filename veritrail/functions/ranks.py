"""Ranks and prefix sums over the values of a group, without ever holding a group in one task.

Rows are first summed up by distinct value, which collapses ties and hot values before the shuffle. What is ordered is sorted into
runs, ranges of even size that may hold several groups or a part of one, and written once; windows run within a run, and a small
table of run totals gives each run its offset. So every call reads its input once, and chains of calls stay linear.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.sources.storage import written


def _same(group: list[str]) -> list[Column]:
    return [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group]


def in_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with __run, its range among ranges of about even size in the order of keys; __row tells rows apart that are equal in all keys."""
    marked = df.withColumn("__row", F.monotonically_increasing_id())
    return marked.repartitionByRange(*keys, "__row").withColumn("__run", F.spark_partition_id())


def running(df: DataFrame, group: list[str], order: str, sums: Mapping[str, Column], tie: list[str] | None = None) -> DataFrame:
    """df with before_<name> and total_<name> of each sum: over a group's rows ahead in the order (order, then tie), and over all.

    Rows equal in order and tie stand in any order; give a tie that tells them apart where that matters.
    """
    keys = [order, *(tie or [])]
    runs = written(in_runs(df.withColumns({f"__{k}": v for k, v in sums.items()}), [*group, *keys]))
    of_run = runs.groupBy(*group, "__run").agg(*(F.sum(f"__{k}").alias(f"__in_{k}") for k in sums))
    whole, ahead = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("__run")  # a row for each run of a group
    offsets = of_run.select(
        *(F.col(g).alias(f"__g_{g}") for g in group),
        F.col("__run").alias("__r"),
        *(F.sum(f"__in_{k}").over(whole).alias(f"total_{k}") for k in sums),
        *((F.sum(f"__in_{k}").over(ahead) - F.col(f"__in_{k}")).alias(f"__offset_{k}") for k in sums),
    )
    within = Window.partitionBy(*group, "__run").orderBy(*keys, "__row").rowsBetween(Window.unboundedPreceding, -1)
    out = runs.withColumns({f"__before_{k}": F.coalesce(F.sum(f"__{k}").over(within), F.lit(0)) for k in sums})
    out = out.join(offsets, [*_same(group), F.col("__run") == F.col("__r")])
    out = out.withColumns({f"before_{k}": F.col(f"__offset_{k}") + F.col(f"__before_{k}") for k in sums})
    return out.select(*df.columns, *(f"{p}_{k}" for k in sums for p in ("before", "total")))


def by_value(df: DataFrame, group: list[str], value: str, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per group and distinct value: n and each sum, with before_ and total_ of all of them over lower values."""
    sums = dict(sums or {})
    counted = df.groupBy(*group, value).agg(F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in sums.items()))
    return running(counted, group, value, {"n": F.col("n"), **{k: F.col(k) for k in sums}})


def average_ranks_of(df: DataFrame, group: list[str], ranks: Mapping[str, str], total: str | None = None) -> DataFrame:
    """The rows of df that have all values (the keys of ranks), with average-tie ranks (from 1) of each within group, and the group's size."""
    known = df.dropna(subset=list(ranks))
    out = known
    for k, (value, name) in enumerate(ranks.items()):
        found = by_value(known, group, value)
        size = [F.col("total_n").alias(total)] if total and k == 0 else []
        table = found.select(*(F.col(g).alias(f"__g_{g}") for g in group), F.col(value).alias("__v"), (F.col("before_n") + (F.col("n") + 1) / 2).alias(name), *size)
        out = out.join(written(table), [*_same(group), F.col(value) == F.col("__v")]).drop("__v", *(f"__g_{g}" for g in group))
    return out


def average_ranks(df: DataFrame, group: list[str], value: str, out: str, total: str | None = None) -> DataFrame:
    """df with average-tie ranks (from 1) of value within group, and the group's size; rows without value are left out."""
    return average_ranks_of(df, group, {value: out}, total)


def quantiles(df: DataFrame, group: list[str], value: Column, shares: Mapping[str, float]) -> DataFrame:
    """(group, each name): exact interpolated quantiles of the values that aren't null, from counts of distinct values in ranges.

    Groups without values have a row of nulls. Nothing holds a group's values, as an exact percentile's buffer would.
    """
    counts = written(df.select(*group, value.cast("double").alias("__q")).groupBy(*group, "__q").agg(F.count("*").alias("n")))
    counted = running(counts.filter("__q is not null"), group, "__q", {"n": F.col("n")})

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n")), F.col("__q")))

    out = []
    for name, share in shares.items():
        place = (F.col("total_n") - 1) * F.lit(share)
        part = F.max(place - F.floor(place))
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append(F.when((part > 0) & (low != high), low + part * (high - low)).otherwise(low).alias(name))  # infinite values stay
    found = counted.groupBy(*group).agg(*out)
    named = found.select(*(F.col(g).alias(f"__g_{g}") for g in group), *shares)
    every = counts.select(*group).distinct()
    return written(every.join(named, _same(group), "left").select(*group, *shares))


def order_statistic(df: DataFrame, group: list[str], value: str, rank: Column, out: str) -> DataFrame:
    """(group, n, out): the value at a rank (from 1; rank is of n, the count of values) in a group."""
    counted = by_value(df.filter(F.col(value).isNotNull()), group, value).select(*group, value, "before_n", F.col("n").alias("__n"), F.col("total_n").alias("n"))
    return counted.filter((F.col("before_n") < rank) & (rank <= F.col("before_n") + F.col("__n"))).select(*group, "n", F.col(value).alias(out))
