"""Reported tables held against what their sources give when they are summed up again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _same(field: T.DataType, a: Column, b: Column, tolerance: float) -> Column:
    """Equal, both null, or numbers no farther apart than tolerance; NaN equals NaN."""
    exact = a.eqNullSafe(b)
    if not isinstance(field, T.NumericType):
        return exact
    return F.coalesce(exact | (F.abs(a.cast("double") - b.cast("double")) <= tolerance), F.lit(False))


def discrepancies(recomputed: DataFrame, reported: DataFrame, keys: list[str], values: list[str], tolerance: float = 5e-4) -> DataFrame:
    """(keys, finding, field, recomputed, reported): what of a reported table does not follow from its source, values as text.

    finding is "missing" (a key that is not reported), "extra" (one that the source lacks), "repeated" (on either side; its values are
    not compared) or "differs", a row for each field. Null keys equal each other; an empty result says that all agrees.
    """
    one = lambda df, side: df.groupBy(*keys).agg(F.count("*").alias("__n"), *(F.any_value(v).alias(v) for v in values)).select(*(F.col(k).alias(f"__{side}_{k}") for k in keys), F.col("__n").alias(f"__{side}"), *(F.col(v).alias(f"__{side}_v_{v}") for v in values))
    both = one(recomputed, "a").join(one(reported, "b"), reduce(Column.__and__, (F.col(f"__a_{k}").eqNullSafe(F.col(f"__b_{k}")) for k in keys)), "full")
    found = lambda finding, field=None, a=None, b=None: F.struct(F.lit(finding).alias("finding"), F.lit(field).cast("string").alias("field"), (F.lit(None) if a is None else a).cast("string").alias("recomputed"), (F.lit(None) if b is None else b).cast("string").alias("reported"))
    left, right = (lambda v: F.col(f"__a_v_{v}")), (lambda v: F.col(f"__b_v_{v}"))
    differs = [F.when(~_same(recomputed.schema[v].dataType, left(v), right(v), tolerance), found("differs", v, left(v), right(v))) for v in values]
    counts = found("repeated", None, F.col("__a"), F.col("__b"))
    of_row = F.when(F.col("__b").isNull(), F.array(found("missing"))).when(F.col("__a").isNull(), F.array(found("extra")))
    of_row = of_row.when((F.col("__a") > 1) | (F.col("__b") > 1), F.array(counts)).otherwise(F.array_compact(F.array(*differs)))
    named = [F.when(F.col("__a").isNull(), F.col(f"__b_{k}")).otherwise(F.col(f"__a_{k}")).alias(k) for k in keys]
    return both.select(*named, F.inline(of_row))


def checks(df: DataFrame, wanted: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """(name, observed, low, high, passed): aggregates of df, each with the range it must lie in; one pass over df. A null aggregate fails."""
    facts = df.agg(*(value.cast("double").alias(f"c{k}") for k, (value, _, _) in enumerate(wanted.values())))
    rows = [F.struct(F.lit(name).alias("name"), F.col(f"c{k}").alias("observed"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")) for k, (name, (_, low, high)) in enumerate(wanted.items())]
    return facts.select(F.inline(F.array(*rows))).withColumn("passed", F.coalesce(F.col("observed").between(F.col("low"), F.col("high")), F.lit(False)))


def certificate_checks(certificates: DataFrame, members: int, tolerance: float = 1e-10) -> DataFrame:
    """The release's checks of certificates: family size, bounds that hold, flags that say so, and the identity of errors."""
    broken = {"family": F.col("diversity_lower") > F.col("family_rms_error") + tolerance, "worst": F.col("diameter_lower") > F.col("worst_member_error") + tolerance}
    wanted = {"least_members": (F.min("n_members"), members, members), "most_members": (F.max("n_members"), members, members)}
    for name, flag in broken.items():
        wanted[f"{name}_violations"] = (F.count_if(flag), 0, 0)
        wanted[f"{name}_flags_wrong"] = (F.count_if(~flag.eqNullSafe(F.col(f"{name}_violation"))), 0, 0)
    wanted["identity_residual"] = (F.max(F.abs("identity_residual")), 0, tolerance)
    return checks(certificates, wanted)
