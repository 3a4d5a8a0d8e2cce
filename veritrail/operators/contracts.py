"""Data contracts: validated joins, strict parsers, guards against labels, issue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions.scalars import alias_key

#: Columns that hold the truth or are derived from it; no feature may be one of them.
LABEL_COLUMNS = ("true_error_rmse", "true_error_cosine", "true_effect_key", "true_effect_l2_norm", "normalized_rmse")


def duplicated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that stand in several rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", unique: str = "both") -> DataFrame:
    """left joined with right; the job fails if a key repeats on a side that must be unique ("left", "right", "both").

    The check runs with the join: each side carries its key's count, and a count above one raises.
    """

    def counted(df: DataFrame, side: str) -> DataFrame:
        if unique not in (side, "both"):
            return df
        counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
        rows = df.join(counts, keys)
        fail = F.raise_error(F.concat(F.lit(f"a key repeats on the {side} side: "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))))
        return rows.filter(F.when(F.col("__n") > 1, fail.cast("boolean")).otherwise(True)).drop("__n")

    return counted(left, "left").join(counted(right, "right"), keys, how)


def alias_join(aliases: DataFrame, names: DataFrame, alias: str, name: str) -> DataFrame:
    """aliases with key, canonical and status: the name with the same normalised form, if there is exactly one ("matched", "unknown", "ambiguous")."""
    known = names.select(alias_key(F.col(name)).alias("key"), F.col(name).alias("__name")).distinct()
    known = known.groupBy("key").agg(F.min("__name").alias("__name"), F.count("*").alias("__n"))
    joined = aliases.withColumn("key", alias_key(F.col(alias))).join(known, "key", "left")
    status = F.when(F.col("__n").isNull(), "unknown").when(F.col("__n") > 1, "ambiguous").otherwise("matched")
    return joined.withColumns({"canonical": F.when(F.col("__n") == 1, F.col("__name")), "status": status}).drop("__name", "__n")


def strict_boolean(text: Column) -> Column:
    """true, 1, yes or false, 0, no in any case; anything else raises."""
    key = F.lower(F.trim(text))
    return F.when(key.isin("true", "1", "yes"), True).when(key.isin("false", "0", "no"), False).otherwise(F.raise_error(F.concat(F.lit("no boolean: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def without_truth(df: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """df without label columns; what follows can't read them."""
    return df.drop(*(c for c in LABEL_COLUMNS if c not in allowed))


def test_rows(df: DataFrame, required: list[str], split: str = "split") -> DataFrame:
    """The test rows; lacking columns raise before anything runs."""
    if missing := sorted({*required, split} - set(df.columns)):
        raise ValueError(f"columns missing: {missing}")
    return df.filter(F.col(split) == "test")


def assert_no_labels(features: list[str]) -> None:
    if bad := sorted(set(features) & set(LABEL_COLUMNS)):
        raise ValueError(f"label columns among the features: {bad}")


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """df with columns it lacks, at their defaults."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def access_audit(read: DataFrame, frozen: DataFrame, key: str) -> DataFrame:
    """(issue, n): frozen rows not read, rows read that aren't frozen, rows read more than once."""
    count = lambda issue, rows: rows.agg(F.lit(issue).alias("issue"), F.count("*").alias("n"))
    out = count("not_read", frozen.join(read, key, "left_anti")).unionByName(count("not_frozen", read.join(frozen, key, "left_anti")))
    return out.unionByName(count("read_again", duplicated_keys(read, [key])))


#: What a set of data needs to be eligible, cells of a pair first.
LEAST_CELLS, LEAST_CONTEXTS, LEAST_PERTURBATIONS, LEAST_PAIRS = 6, 2, 2, 8
#: Labels that mean a control here, and columns that are no contexts.
ELIGIBLE_CONTROLS = ("control", "ctrl", "non-targeting", "nt", "vehicle")


def eligibility(rows: DataFrame, keys: list[str], context: str | None, perturbation: str | None, controls: tuple[str, ...] = ELIGIBLE_CONTROLS, forbidden: tuple[str, ...] = (), least_cells: int = LEAST_CELLS) -> DataFrame:
    """(keys, n_contexts, n_perturbations, has_control, n_eligible_pairs, eligible, reasons) of each set of data: which columns hold context and perturbation, or None, is one choice for all.

    Reasons, joined by semicolons: no context or perturbation column, the two are one, fewer than two contexts, a condition whose labels
    number about as many as the perturbations, no control, too few pairs of enough cells. Sets without rows do not appear: see missing_files.
    """
    ctx = F.col(context) if context else F.lit(None).cast("string")
    pert = F.col(perturbation) if perturbation else F.lit(None).cast("string")
    pairs = rows.select(*keys, ctx.cast("string").alias("__c"), pert.cast("string").alias("__p")).groupBy(*keys, "__c", "__p").agg(F.count("*").alias("__n"))
    control = F.coalesce(F.lower(F.trim("__p")).isin(*(c.lower() for c in controls)), F.lit(False))
    whole = F.col("__c").isNotNull() & F.col("__p").isNotNull() & (F.col("__n") >= least_cells)
    sets = pairs.groupBy(*keys).agg(F.count_distinct("__c").alias("n_contexts"), F.count_distinct("__p").alias("n_perturbations"), F.bool_or(control).alias("has_control"), F.count_if(whole).alias("n_eligible_pairs"))
    contexts, perturbations, found = F.col("n_contexts"), F.col("n_perturbations"), F.col("n_eligible_pairs")
    combined = F.lit(context == "condition") & (contexts >= 2) & (perturbations >= 2) & (F.abs(contexts - perturbations) <= F.greatest(F.lit(2), F.floor(perturbations * 0.05)))
    reasons = {
        "no_context_col>=2": F.lit(context is None),
        "no_perturbation_col>=2": F.lit(perturbation is None),
        "context_equals_perturbation": F.lit(context is not None and context == perturbation),
        "n_contexts<2": contexts < LEAST_CONTEXTS,
        "condition_perturbation_combinatorial_not_cross_context": combined,
        "no_control_in_perturbation_col": ~F.col("has_control"),
    }
    texts = [F.when(lacks, F.lit(name)) for name, lacks in reasons.items()]
    texts.append(F.when(found < LEAST_PAIRS, F.concat(F.lit("n_eligible_pairs="), found.cast("string"), F.lit(f"<{LEAST_PAIRS}"))))
    sets = sets.withColumn("reasons", F.concat_ws(";", *texts))
    eligible = (F.col("reasons") == "") & (perturbations >= LEAST_PERTURBATIONS) & F.lit(context not in forbidden)
    return sets.withColumn("eligible", eligible).withColumn("reasons", F.when(~eligible & (F.col("reasons") == ""), "unknown").otherwise(F.col("reasons")))


def missing_files(named: DataFrame, audited: DataFrame, key: str) -> DataFrame:
    """audited with a row for each name of named that has none: nothing counted, reason file_missing."""
    absent = named.select(key).distinct().join(audited, key, "left_anti")
    counts = {c: F.lit(0).cast("long") for c in ("n_contexts", "n_perturbations", "n_eligible_pairs")}
    return audited.unionByName(absent.withColumns(counts | {"has_control": F.lit(False), "eligible": F.lit(False), "reasons": F.lit("file_missing")}))
