"""Scales fitted on reference rows of a group and applied to all its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.ranks import by_value, quantiles


def empirical_quantile(df: DataFrame, group: list[str], value: str, reference: Column, out: str) -> DataFrame:
    """df with the mid-rank share of reference values below value; 0.5 for a null value or without reference."""
    inside = by_value(df.filter(F.col(value).isNotNull()).withColumn("__ref", F.when(reference, 1).otherwise(0)), group, value, {"ref": F.col("__ref")})
    share = F.try_divide(F.col("before_ref") + F.col("ref") / 2, F.col("total_ref")).alias("__share")
    keyed = inside.select(*(F.col(g).alias(f"__g_{g}") for g in group), F.col(value).alias("__v"), share)
    joined = df.join(keyed, [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group] + [F.col(value) == F.col("__v")], "left")
    return joined.select(*df.columns, F.coalesce("__share", F.lit(0.5)).alias(out))


def robust_z(df: DataFrame, group: list[str], value: str, reference: Column, out: str, scale: str = "iqr") -> DataFrame:
    """df with (value - median) / scale, both of the reference rows.

    "iqr": quartile range, else the sample deviation, else 1 where these vanish; a null value counts as the median. "mad": 1.4826
    times the median absolute deviation with a small floor, and the result stays within 5.
    """
    ref = F.when(reference, F.col(value))
    if scale == "iqr":
        marks = quantiles(df, group, ref, {"__low": 0.25, "__med": 0.5, "__high": 0.75})
        spread = df.groupBy(*group).agg(F.stddev_samp(ref).alias("__sd"))
        facts = marks.join(spread, group).select(*group, F.coalesce("__med", F.lit(0.0)).alias("__med"), (F.col("__high") - F.col("__low")).alias("__iqr"), "__sd")
        size = F.when(F.col("__iqr") > 1e-9, F.col("__iqr")).when(F.col("__sd") > 1e-9, F.col("__sd")).otherwise(1.0)
        z = (F.coalesce(F.col(value), F.col("__med")) - F.col("__med")) / size
        return df.join(facts, group).select(*df.columns, z.alias(out))
    medians = quantiles(df, group, ref, {"__med": 0.5}).join(df.groupBy(*group).agg(F.stddev_pop(ref).alias("__sd")), group)
    spread = medians.join(quantiles(df.join(medians, group), group, F.abs(ref - F.col("__med")), {"__mad": 0.5}), group)
    size = F.greatest(1.4826 * F.col("__mad"), F.col("__sd") * 1e-8, F.lit(1e-8))
    z = F.least(F.greatest((F.col(value) - F.col("__med")) / size, F.lit(-5.0)), F.lit(5.0))
    return df.join(spread, group).select(*df.columns, z.alias(out))
