"""Error certificates of prediction families: exact lower bounds from their geometry, conformal upper bounds.

Families are long tables (task, member, position, prediction); truth is (task, position, truth). Everything is an aggregate over
(task, position) and then over the task, so a task's vectors are never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.ranks import order_statistic

TOLERANCE = 1e-10


def family_certificate(members: DataFrame, truth: DataFrame, task: list[str], alone: bool = False) -> DataFrame:
    """One row per task: errors of the family, its centroid and worst member, lower bounds from its spread, and checks.

    alone: families of one member too, which have no diameter; else they are left out.
    """
    place = [*task, "position"]
    sizes = members.select(*task, "member").distinct().groupBy(*task).agg(F.count("*").alias("n_members"))
    centre = members.groupBy(*place).agg(F.avg("prediction").alias("centroid"), F.var_pop("prediction").alias("spread"))
    joined = members.join(truth, place).join(centre, place)
    error, off = F.col("prediction") - F.col("truth"), F.col("prediction") - F.col("centroid")
    by_member = joined.groupBy(*task, "member").agg(F.avg(error * error).alias("mse"), F.avg(off * off).alias("shift"))
    worst = by_member.groupBy(*task).agg(F.avg("mse").alias("family_mse"), F.max("mse").alias("worst_mse"), F.max("shift").alias("radius_mse"))
    gap = F.col("centroid") - F.col("truth")
    central = centre.join(truth, place).groupBy(*task).agg(F.avg(gap * gap).alias("centroid_mse"), F.avg("spread").alias("diversity_mse"))
    other = members.select(*place, F.col("member").alias("member2"), F.col("prediction").alias("prediction2"))
    apart = (F.col("prediction") - F.col("prediction2")) * (F.col("prediction") - F.col("prediction2"))
    pairs = members.join(other, place).filter("member < member2").groupBy(*task, "member", "member2").agg(F.avg(apart).alias("apart"))
    wide = pairs.groupBy(*task).agg(F.max("apart").alias("diameter_mse"))
    out = sizes.join(worst, task).join(central, task).join(wide, task, "left" if alone else "inner")
    out = out.select(
        *task,
        "n_members",
        F.sqrt("family_mse").alias("family_rms_error"),
        F.sqrt("centroid_mse").alias("centroid_rmse"),
        F.sqrt("diversity_mse").alias("diversity_lower"),
        F.sqrt("worst_mse").alias("worst_member_error"),
        (F.sqrt("diameter_mse") / 2).alias("diameter_lower"),
        F.sqrt("radius_mse").alias("family_radius"),
        F.abs(F.col("family_mse") - F.col("centroid_mse") - F.col("diversity_mse")).alias("identity_residual"),
    )
    return out.withColumns(
        {
            "family_violation": F.col("diversity_lower") > F.col("family_rms_error") + TOLERANCE,
            "worst_violation": F.col("diameter_lower") > F.col("worst_member_error") + TOLERANCE,
            "family_tightness": F.try_divide("diversity_lower", "family_rms_error"),
            "worst_tightness": F.try_divide("diameter_lower", "worst_member_error"),
        }
    )


def transported(certificates: DataFrame, upper: str, shift: str) -> DataFrame:
    """certificates with upper bounds carried from a reference centroid by the centroids' distance, flags and widths."""
    moved = F.col(upper) + F.col(shift)
    family = F.sqrt(moved * moved + F.col("diversity_lower") * F.col("diversity_lower"))
    worst = moved + F.col("family_radius")
    return certificates.withColumns(
        {
            "transported_upper": moved,
            "family_upper": family,
            "worst_upper": worst,
            "family_covered": F.col("family_rms_error") <= family + TOLERANCE,
            "worst_covered": F.col("worst_member_error") <= worst + TOLERANCE,
            "family_width": family - F.col("diversity_lower"),
            "worst_width": worst - F.col("diameter_lower"),
        }
    )


def conformal_quantile(scores: DataFrame, group: list[str], value: str, coverage: float, out: str, beyond: str = "clip") -> DataFrame:
    """The ceil((n + 1) * coverage)-th smallest value of each group; beyond n the largest ("clip") or infinity ("inf").

    Groups hold one score per calibration cluster. Distinct values are counted and ordered in ranges.
    """
    raw = F.ceil((F.col("n") + 1) * F.lit(coverage) - F.lit(1e-9))
    found = order_statistic(scores, group, value, F.least(F.col("n"), raw), out).withColumn("conformal_rank", F.least(F.col("n"), raw))
    if beyond == "inf":
        found = found.withColumn(out, F.when(raw > F.col("n"), F.lit(float("inf"))).otherwise(F.col(out)))
    return found.select(*group, F.col("n").alias("n_clusters"), "conformal_rank", out)


def registered_families(members: DataFrame, architecture: Column, task: str = "task") -> DataFrame:
    """(task, family, member, position, prediction) of the three families: architectures' means over their seeds, all seeds, and the means with no change as a further member, 0."""
    columns = [task, "family", "member", "position", "prediction"]
    means = members.groupBy(task, architecture.cast("long").alias("member"), "position").agg(F.avg("prediction").alias("prediction"))
    none = members.select(task, "position").distinct().withColumns({"member": F.lit(0).cast("long"), "prediction": F.lit(0.0)})
    named = lambda df, name: df.withColumn("family", F.lit(name)).select(columns)
    seeds = members.withColumn("member", F.col("member").cast("long"))
    return named(means, "architecture_pair").unionByName(named(seeds, "all_seeds")).unionByName(named(means.unionByName(none), "no_change_control"))
