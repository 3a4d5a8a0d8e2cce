"""Bootstrap and permutation by hashes: draws are functions of seed, replicate and id, so they repeat exactly on any cluster."""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions.ranks import running
from veritrail.operators.metrics import hash_positions, spearman
from veritrail.sources.storage import Scratch, written


def _draw(seed: str, *parts: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _slots(clusters: DataFrame, group: list[str], cluster: str) -> DataFrame:
    """clusters (a row each) with slot, their number (from 0) in the group, and m, how many the group has; written."""
    numbered = running(clusters, group, cluster, {"one": F.lit(1)})
    return written(numbered.withColumns({"slot": F.col("before_one").cast("long"), "m": F.col("total_one").cast("long")}).drop("before_one", "total_one"))


def _picks(slots: DataFrame, group: list[str], replicates: int, seed: str) -> DataFrame:
    """(group, replicate, pick): as many draws with replacement as a group has clusters."""
    drawn = slots.select(*group, "slot", "m").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return drawn.select(*group, "replicate", (_draw(seed, *(F.col(g) for g in group), F.col("replicate"), F.col("slot")) % F.col("m")).alias("pick"))


def multiplicities(clusters: DataFrame, group: list[str], cluster: str, replicates: int, seed: str) -> DataFrame:
    """(group, replicate, cluster, times): as many draws with replacement as a group has clusters."""
    slots = _slots(clusters.select(*group, cluster).distinct(), group, cluster)
    drawn = _picks(slots, group, replicates, seed).groupBy(*group, "replicate", "pick").agg(F.count("*").alias("times"))
    return drawn.join(slots.select(*group, cluster, F.col("slot").alias("pick")), [*group, "pick"]).select(*group, "replicate", cluster, "times")


#: Clusters whose sums one task holds, draws made at a time, and replicates of a task.
PICKED, DRAWN, TOGETHER = 1 << 20, 1 << 16, 50


def _drawn_sums(slots: DataFrame, group: list[str], replicates: int, seed: str) -> DataFrame:
    """(group, replicate, s, n): sums over a replicate's draws of _picks. slots: (group, slot, m, s, n).

    A task makes all draws of some replicates and adds up those that fall on its clusters, so no draw is a row or is shuffled.
    """
    rows = slots.select(*group, "slot", "m", F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("s"), "n", F.concat_ws("|", F.lit(seed), *(F.col(g).cast("string") for g in group)).alias("__key"))
    rows = rows.withColumn("__block", F.floor(F.col("slot") / PICKED)).withColumn("__first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(TOGETHER))))

    def run(table: pa.Table) -> pa.Table:
        slot, s, n = (table[c].to_numpy() for c in ("slot", "s", "n"))
        low, m, first, key = int(slot.min()), table["m"][0].as_py(), table["__first"][0].as_py(), table["__key"][0].as_py()
        at = np.empty(len(slot), np.int64)
        at[slot - low] = np.arange(len(slot))
        count = min(TOGETHER, replicates - first)
        sums, sizes = np.zeros(count), np.zeros(count, np.int64)
        for k in range(count):
            text = f"{key}|{first + k}|".encode()
            for start in range(0, m, DRAWN):
                digests = b"".join([sha256(text + b"%d" % j).digest()[:4] for j in range(start, min(start + DRAWN, m))])
                pick = np.frombuffer(digests, ">u4").astype(np.int64) % m - low
                pick = at[pick[(pick >= 0) & (pick < len(at))]]
                sums[k] += s[pick].sum()
                sizes[k] += n[pick].sum()
        keys = {g: table[g].take(pa.array(np.zeros(count, np.int64))) for g in group}
        return pa.table({**keys, "replicate": pa.array(range(first, first + count), pa.int32()), "s": sums, "n": sizes}).combine_chunks()

    schema = "".join(f"`{g}` {slots.schema[g].dataType.simpleString()}, " for g in group) + "replicate int, s double, n long"
    parts = rows.groupBy(*group, "__block", "__first").applyInArrow(run, schema)
    return parts.groupBy(*group, "replicate").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def bootstrap_mean(df: DataFrame, group: list[str], cluster: str, value: str, replicates: int, seed: str) -> DataFrame:
    """(group, estimate, low, high): mean and 95 % percentile interval over resampled clusters, on cluster sums alone."""
    sums = df.groupBy(*group, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    slots = _slots(sums, group, cluster)
    means = _drawn_sums(slots, group, replicates, seed).select(*group, "replicate", F.try_divide("s", "n").alias("mean"))
    ends = means.groupBy(*group).agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return slots.groupBy(*group).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("estimate")).join(ends, group)


def _places(df: DataFrame, keys: list[str], draw: str, tie: str) -> DataFrame:
    """df with place, its number (from 1) by draw within keys; draws are even over 32 bits, so fixed ranges of them share the work."""
    ranged = df.withColumn("__range", F.shiftright(draw, 26))
    counts = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(*keys).orderBy("__range")  # 64 rows at most
    offsets = counts.withColumn("__offset", F.sum("__n").over(ahead) - F.col("__n")).drop("__n")
    within = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(draw, tie))
    return ranged.withColumn("__within", within).join(offsets, [*keys, "__range"]).withColumn("place", F.col("__offset") + F.col("__within")).drop("__range", "__within", "__offset")


def permutation_p(df: DataFrame, group: list[str], unit: str, flag: Column, value: str, replicates: int, seed: str) -> DataFrame:
    """(group, observed, p): difference of mean value between flagged and other units against permutations of the flags; p counts the observed one.

    flag is an aggregate over a unit's rows. Each replicate orders the units by a hash of seed, replicate and unit and flags as many of
    them as are flagged, so every replicate is a permutation. Units are summed up first; only their sums are drawn.
    """
    sums = df.groupBy(*group, unit).agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.coalesce(flag, F.lit(False)).alias("f"))
    flagged = sums.groupBy(*group).agg(F.count_if("f").alias("flagged"))
    rows = sums.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("draw", _draw(seed, F.col("r"), F.col(unit)))
    drawn = _places(rows, [*group, "r"], "draw", unit).join(flagged, group).withColumn("f", F.col("place") <= F.col("flagged"))
    both = sums.withColumn("r", F.lit(0)).select(*group, "r", "s", "n", "f").unionByName(drawn.select(*group, "r", "s", "n", "f"))
    mean = lambda on: F.try_divide(F.sum(F.when(on, F.col("s"))), F.sum(F.when(on, F.col("n"))))
    stats = both.groupBy(*group, "r").agg((mean(F.col("f")) - mean(~F.col("f"))).alias("stat"))
    base = stats.filter("r = 0").select(*group, F.col("stat").alias("observed"))
    extreme = F.count_if((F.col("r") > 0) & (F.col("stat") >= F.col("observed")))
    return stats.join(base, group).groupBy(*group, "observed").agg(((1 + extreme) / F.lit(1.0 + replicates)).alias("p"))


def halves(units: DataFrame, strata: list[str], unit: str, repeats: int, seed: str) -> DataFrame:
    """Each distinct unit of a stratum once a repeat, with half 1 or 0; the halves of a stratum differ by one unit at most, as its hash order alternates."""
    drawn = units.select(*strata, unit).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    drawn = drawn.withColumn("__digest", F.sha2(F.concat(F.lit(seed), F.col("repeat").cast("string"), F.lit("\0"), F.col(unit).cast("string")), 256))
    placed = hash_positions(drawn, [*strata, "repeat"], "__digest", unit, "__at")
    return placed.select(*strata, unit, "repeat", (F.col("__at") % 2).cast("int").alias("half"))


def half_masks(units: DataFrame, strata: list[str], unit: str, repeats: int, seed: str, orders: int = 5) -> DataFrame:
    """(strata, unit, mask) of each distinct unit: bit r of mask says whether it is in the left half of repeat r; repeats are a multiple of orders, 60 at most.

    In each of a few hash orders of a stratum, neighbours are couples, and a coin for each couple and repeat sends one of them left: any
    balanced halving is as likely as another, and a stratum's units are ordered a few times, not once a repeat.
    """
    each = repeats // orders
    drawn = units.select(*strata, unit).distinct().withColumn("__order", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))))
    text = lambda *parts: F.sha2(F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts)), 256)
    drawn = drawn.withColumn("__digest", text(F.col("__order"), F.col(unit)))
    placed = hash_positions(drawn, [*strata, "__order"], "__digest", unit, "__at")
    coin = F.conv(F.substring(text(F.lit("coin"), F.col("__order"), *map(F.col, strata), F.floor((F.col("__at") - 1) / 2)), 1, 8), 16, 10).cast("long")
    every = (1 << each) - 1
    bits = F.when(F.col("__at") % 2 == 1, coin).otherwise(F.bitwise_not(coin)).bitwiseAND(every)
    moved = bits * F.element_at(F.array(*(F.lit(1 << (each * k)).cast("long") for k in range(orders))), F.col("__order") + 1)
    return placed.groupBy(*strata, unit).agg(F.sum(moved).alias("mask"))


#: Rows of a bucket of hash neighbours, and of a task that holds several buckets, about.
HALF_BUCKET, HALF_TASK = 1 << 14, 1 << 19


def half_sums(rows: DataFrame, keys: list[str], batch: list[str], unit: str, gene: str, value: str, repeats: int, seed: str, orders: int = 5) -> tuple[DataFrame, DataFrame]:
    """(keys, n, n_left) and (keys, gene, s, s_left): a key's units and a gene's sum of value, and what of them is in the left half of each repeat.

    The halves are those of half_masks over the strata of keys and batch. The rows meet one order at a time: each goes with its value to the
    bucket of its hash, where it gets its place, and only sums leave, so disk holds one order's rows and no unit meets its mask. Rows
    without a key, batch or unit take no part, as in SQL.
    """
    each, strata, spark = repeats // orders, [*keys, *batch], rows.sparkSession
    text = lambda *parts: F.sha2(F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts)), 256)
    parts = []
    with Scratch(spark) as scratch:
        rows = scratch.written(rows.select(*strata, unit, gene, value).dropna(subset=[*strata, unit]))
        tasks = max(-(-rows.count() // HALF_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))
        groups = rows.groupBy(*strata).agg(F.ceil(F.count("*") / HALF_BUCKET).alias("__buckets"))
        groups = scratch.written(groups.withColumn("__s", F.monotonically_increasing_id()))
        for order in range(orders):
            digest = text(F.lit(order), F.col(unit))
            named = rows.join(groups, strata).withColumn("__digits", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
            bucket = F.shiftright(F.shiftright("__digits", 28) * F.col("__buckets"), 32).cast("int")  # the first 32 of 60 bits
            dealt = named.select("__s", bucket.alias("__bucket"), "__digits", F.col(unit).alias("__unit"), F.col(gene).alias("__gene"), F.col(value).alias("__x")).repartition(tasks, "__s", "__bucket")
            line = Window.partitionBy("__s", "__bucket").orderBy("__digits", text(F.lit(order), F.col("__unit")), "__unit")  # a bucket
            first = ~F.col("__unit").eqNullSafe(F.lag("__unit").over(line))
            placed = scratch.written(dealt.select("__s", "__bucket", "__gene", "__x", F.dense_rank().over(line).alias("__at"), first.alias("__first")))
            ahead = Window.partitionBy("__s").orderBy("__bucket")  # a row for each bucket of a stratum
            sizes = placed.groupBy("__s", "__bucket").agg(F.max("__at").cast("long").alias("__n"))
            sizes = scratch.written(sizes.select("__s", "__bucket", (F.sum("__n").over(ahead) - F.col("__n")).alias("__ahead")))
            whole = placed.join(sizes, ["__s", "__bucket"]).join(groups, "__s").withColumn("__at", F.col("__ahead") + F.col("__at"))
            coin = F.conv(F.substring(text(F.lit("coin"), F.lit(order), *map(F.col, strata), F.floor((F.col("__at") - 1) / 2)), 1, 8), 16, 10).cast("long")
            whole = whole.select(*keys, "__gene", "__x", "__first", F.when(F.col("__at") % 2 == 1, coin).otherwise(F.bitwise_not(coin)).bitwiseAND((1 << each) - 1).alias("__bits"))
            left = [F.col("__bits").bitwiseAND(1 << j) != 0 for j in range(each)]
            sums = whole.groupBy(*keys, "__gene").agg(
                F.count_if("__first").alias("n"),
                F.array(*(F.count_if(F.col("__first") & on) for on in left)).alias("n_left"),
                F.sum("__x").alias("s"),
                F.array(*(F.coalesce(F.sum(F.when(on, F.col("__x"))), F.lit(0.0)) for on in left)).alias("s_left"),
            )
            parts.append(written(sums.withColumn("o", F.lit(order))))
            scratch.drop(placed, sizes)
    every = F.array_sort(F.collect_list(F.struct("o", "n_left", "s_left")))  # one for each order
    found = reduce(DataFrame.unionByName, parts).groupBy(*keys, "__gene").agg(F.sum(F.when(F.col("o") == 0, F.col("n"))).alias("n"), F.max("s").alias("s"), every.alias("v"))
    joined = lambda c: F.flatten(F.transform("v", lambda x: x[c])).alias(c)
    found = written(found.select(*keys, F.col("__gene").alias(gene), "n", "s", joined("n_left"), joined("s_left")))
    sizes = found.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("n_left")[r]) for r in range(repeats))).alias("n_left"))
    return sizes, found.filter(F.col(gene).isNotNull()).select(*keys, gene, "s", "s_left")


def association_null(risk: DataFrame, errors: DataFrame, unit: str, method: str, replicates: int, seed: str) -> DataFrame:
    """(observed, n_null, p) of the median over methods of the rank correlation between a unit's risk and its error, against permutations of the risks.

    risk is (unit, risk), errors (unit, method, error). Each replicate hands the units' risks on in a hash order; p is that of the upper tail,
    the observed one counted.
    """
    known = risk.filter(F.col("risk").isNotNull() & F.col(unit).isNotNull())
    base = _places(known.withColumn("r", F.lit(0)).withColumn("draw", _draw(seed, F.lit(0), F.col(unit))), ["r"], "draw", unit).select("place", F.col("risk").alias("given"))
    rows = known.select(unit).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("draw", _draw(seed, F.col("r"), F.col(unit)))
    drawn = _places(rows, ["r"], "draw", unit).join(base, "place").select(unit, "r", "given")
    both = known.select(unit, F.lit(0).alias("r"), F.col("risk").alias("given")).unionByName(drawn)
    scored = spearman(both.join(errors.select(unit, method, "error"), unit), [method, "r"], "given", "error").filter("rho is not null")
    stats = written(scored.groupBy("r").agg(F.median("rho").alias("stat")))  # of a few methods
    observed = stats.filter("r = 0").select(F.col("stat").alias("observed"))
    nulls = stats.filter("r > 0").join(F.broadcast(observed))  # one row
    return nulls.groupBy("observed").agg(F.count("*").alias("n_null"), ((1 + F.count_if(F.col("stat") >= F.col("observed"))) / (1.0 + F.count("*"))).alias("p"))
