"""Splits of tasks into folds: held-out pairs that keep training siblings, and contexts packed into folds of even load."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.operators.contracts import duplicated_keys
from veritrail.operators.metrics import hash_positions, ordered_positions
from veritrail.sources.storage import written

#: Rounds of exchanges before a task that leaves its context or perturbation without a sibling is not tested.
ROUNDS = 20
#: The share of a fold's training pool that becomes validation, and the tasks that stay for training at least.
VAL_SHARE, LEAST_TRAIN = 0.15, 3


def _digest(seed: str, *parts: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(p).cast("string") for p in parts)), 256)


def _held_whole(state: DataFrame, dataset: str, vertex: str, size: str) -> DataFrame:
    """(dataset, vertex, fold) where one fold tests all tasks of a context or perturbation."""
    counts = state.filter("fold >= 0").groupBy(dataset, vertex, "fold").agg(F.count("*").alias("__n"), F.max(size).alias("__all"))
    return counts.filter("__n >= __all").select(dataset, vertex, "fold")


def held_out_folds(tasks: DataFrame, dataset: str, task: str, context: str, perturbation: str, seed: str = "folds") -> DataFrame:
    """(dataset, task, context, perturbation, fold, n_folds): the fold that tests each task, -1 for tasks that are only trained on.

    Tasks are candidates if their context and their perturbation have another task; 15 candidates or more give 5 folds, 6 or more give 3.
    No fold tests all tasks of a context or of a perturbation, and a data set's folds differ by one task at most, but for tasks that
    had to be left out. A pair of context and perturbation is one task; a repeated one raises. Rows without data set, context or perturbation
    are left out.

    Candidates stand in an order that keeps a perturbation's tasks together and are dealt to the folds in turn, which spreads every
    perturbation. Where a fold still has a whole context, one of its tasks changes folds with its neighbour in the order; neighbours
    are couples that do not overlap, so all exchanges of a round are made at once and sizes stay.
    """
    keys = [dataset, context, perturbation]
    rows = tasks.select(dataset, task, context, perturbation).dropna(subset=keys)
    if not duplicated_keys(rows, keys).isEmpty():
        raise ValueError("a pair of context and perturbation repeats")
    of = lambda c, name: rows.groupBy(dataset, c).agg(F.count("*").alias(name))
    rows = written(rows.join(of(context, "__nc"), [dataset, context]).join(of(perturbation, "__np"), [dataset, perturbation]).withColumn("__hash", _digest(seed, *keys)))
    candidates = rows.filter("__nc >= 2 and __np >= 2").withColumn("__pert", F.concat(_digest(seed, dataset, perturbation), F.lit("|"), F.col(perturbation).cast("string")))
    placed = ordered_positions(candidates, [dataset], "__pert", ["__hash"], "__at").drop("__pert")
    n_folds = F.when(F.col("n") >= 15, 5).when(F.col("n") >= 6, 3).otherwise(F.greatest(F.lit(1), F.least(F.lit(3), F.col("n")))).cast("int")
    state = placed.withColumn("n_folds", n_folds).drop("n")
    state = written(state.withColumn("fold", ((F.col("__at") - 1) % F.col("n_folds")).cast("int")))
    for k in range(ROUNDS):
        bad = written(_held_whole(state, dataset, context, "__nc").select(dataset, F.col(context).cast("string").alias("__v"), "fold", F.lit(context).alias("__kind")).unionByName(_held_whole(state, dataset, perturbation, "__np").select(dataset, F.col(perturbation).cast("string").alias("__v"), "fold", F.lit(perturbation).alias("__kind"))))
        if bad.isEmpty():
            break
        pick = lambda kind: state.withColumn("__v", F.col(kind).cast("string")).join(bad.filter(F.col("__kind") == kind), [dataset, "__v", "fold"]).groupBy(dataset, "__v").agg(F.min_by("__at", F.xxhash64("__hash", F.lit(k))).alias("__at")).select(dataset, "__at")  # noqa: E731, B023
        couple = F.floor((F.col("__at") + k % 2) / 2)
        chosen = pick(context).unionByName(pick(perturbation)).select(dataset, couple.alias("__couple")).distinct().withColumn("__change", F.lit(True))
        coupled = state.withColumn("__couple", couple)
        others = coupled.select(dataset, "__couple", F.col("__at").alias("__at2"), F.col("fold").alias("__fold2"))
        partner = others.join(chosen, [dataset, "__couple"])
        joined = coupled.join(partner.withColumnRenamed("__couple", "__c2").withColumnRenamed(dataset, "__d2"), F.col(dataset).eqNullSafe(F.col("__d2")) & (F.col("__couple") == F.col("__c2")) & (F.col("__at") != F.col("__at2")), "left")
        state = written(joined.withColumn("fold", F.coalesce("__fold2", "fold")).select(*state.columns))
    for vertex, size in ((context, "__nc"), (perturbation, "__np")):
        bad = _held_whole(state, dataset, vertex, size).withColumnRenamed("fold", "__bad")
        least = state.join(bad, [dataset, vertex]).groupBy(dataset, vertex).agg(F.min("__at").alias("__out"))
        left_out = state.join(least, [dataset, vertex], "left")
        state = left_out.withColumn("fold", F.when(F.col("__at") == F.col("__out"), -1).otherwise(F.col("fold"))).select(*state.columns)
    sizes = state.select(dataset, "n_folds").distinct()
    out = rows.join(state.select(*keys, "fold"), keys, "left").join(sizes, dataset, "left")
    return written(out.select(dataset, task, context, perturbation, F.coalesce("fold", F.lit(-1)).alias("fold"), F.coalesce("n_folds", F.lit(1)).alias("n_folds")))


def held_out_splits(tasks: DataFrame, dataset: str, task: str, context: str, perturbation: str, seed: str = "folds") -> DataFrame:
    """(dataset, task, context, perturbation, fold, split, pair_seen, perturbation_seen, context_seen): every task once a fold, as train, val or test.

    Validation takes 15 % of a fold's training pool, at least one task and leaving three, in a hash order; tasks that a tested context
    or perturbation needs, one for each, stay in training. See held_out_folds.
    """
    folds = held_out_folds(tasks, dataset, task, context, perturbation, seed)
    rows = folds.withColumnRenamed("fold", "__own").withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("n_folds") - 1)))
    rows = rows.withColumns({"__test": F.col("__own") == F.col("fold"), "__hash": _digest(seed, dataset, context, perturbation, "fold")})
    pool = rows.filter("not __test")
    tested = rows.filter("__test")
    keeper = lambda vertex: pool.join(tested.select(dataset, "fold", vertex).distinct(), [dataset, "fold", vertex], "left_semi").groupBy(dataset, "fold", vertex).agg(F.min_by(F.struct(context, perturbation), "__hash").alias("__k")).select(dataset, "fold", "__k.*")
    kept = keeper(context).unionByName(keeper(perturbation)).distinct()
    keys = [dataset, "fold", context, perturbation]
    sizes = pool.groupBy(dataset, "fold").agg(F.count("*").alias("__pool"))
    most = F.least(F.greatest(F.lit(1), F.round(F.col("__pool") * VAL_SHARE)), F.col("__pool") - LEAST_TRAIN)
    free = hash_positions(written(pool.join(kept, keys, "left_anti").select(*keys, "__hash")), [dataset, "fold"], "__hash", perturbation, "__at").join(sizes, [dataset, "fold"])
    val = free.filter(F.col("__at") <= most).select(*keys, F.lit("val").alias("__val"))
    named = written(rows.join(val, keys, "left").withColumn("split", F.when(F.col("__test"), "test").otherwise(F.coalesce("__val", F.lit("train")))).select(dataset, task, context, perturbation, "fold", "split"))
    train = named.filter("split = 'train'")
    seen = lambda cols, name: train.select(dataset, "fold", *cols).distinct().withColumn(name, F.lit(True))
    out = named
    for cols, name in (([context, perturbation], "pair_seen"), ([perturbation], "perturbation_seen"), ([context], "context_seen")):
        out = out.join(seen(cols, name), [dataset, "fold", *cols], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.select(dataset, task, context, perturbation, "fold", "split", "pair_seen", "perturbation_seen", "context_seen")


def packed_contexts(tasks: DataFrame, dataset: str, task: str, context: str, folds: int) -> DataFrame:
    """(dataset, context, n_tasks, fold): contexts by falling number of distinct tasks, equal ones by name, each to the fold of least load, the first of equals.

    Tasks are counted first; a data set's contexts, one row each, are packed in one task. Null contexts are not packed.
    """
    counts = tasks.filter(F.col(context).isNotNull()).groupBy(dataset, context).agg(F.count_distinct(task).alias("n_tasks"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tasks", context], ascending=[False, True], kind="stable")
        loads, out = [0] * folds, []
        for n in rows["n_tasks"]:
            out.append(min(range(folds), key=lambda k: (loads[k], k)))
            loads[out[-1]] += int(n)
        return rows.assign(fold=out)

    kinds = dict(counts.dtypes)
    return counts.groupBy(dataset).applyInPandas(pack, f"`{dataset}` {kinds[dataset]}, `{context}` {kinds[context]}, n_tasks long, fold int")
