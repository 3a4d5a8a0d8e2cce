"""Cluster bootstraps of order statistics: correlations of ranks, selective risk, utility, medians.

A replicate draws as many clusters with replacement as there are, and a row counts as often as its cluster is drawn. No row is
copied: rows are sorted once into runs, and each run adds up weights for all replicates at once, given what the runs ahead of it hold.
Weights follow from seed, key and replicate, so all statistics of one seed share their draws. They are made once, for some clusters at a
time, and rows carry their cluster's, a byte for each replicate: no task holds the draws of all clusters.
Replicate 0 is the data as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions.ranks import quantiles, running
from veritrail.sources.storage import written

#: Replicates, and numbers of one matrix of rows or clusters times replicates held at a time.
REPLICATES, CELLS = 1000, 1_000_000
#: Clusters whose draws one task makes, rows of a run, and bytes of a batch of rows with arrays.
SLOTS, RUN, BATCH_BYTES = 1 << 15, 4096, 1 << 24


def draws(seed: str, key: str, n: int, first: int, count: int) -> np.ndarray:
    """How often each of n clusters is drawn in replicates first to first + count - 1, as a matrix of clusters times replicates."""
    out = np.ones((n, count), np.int32)
    for k in range(first == 0, count):
        digest = hashlib.sha256(f"{seed}|{key}|{first + k}".encode()).digest()
        random = np.random.Generator(np.random.Philox(key=int.from_bytes(digest[:16], "big")))
        out[:, k] = np.bincount(random.integers(0, n, n), minlength=n)
    return out


def _chunks(rows: int, replicates: int) -> Iterator[tuple[int, int]]:
    size = max(1, min(replicates, CELLS // max(rows, 1)))
    for first in range(0, replicates, size):
        yield first, min(size, replicates - first)


def keyed(columns: list[str]) -> Column:
    """Several columns as one text; null differs from all texts."""
    return F.to_json(F.array(*(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns))) if columns else F.lit("[]")


def slotted(df: DataFrame, group: list[str], draw: list[str], cluster: str) -> DataFrame:
    """df with __g and __d, the texts of group and draw, and __slot and __n, the cluster's number among those of the draw and their count."""
    rows = df.withColumns({"__g": keyed(group), "__d": keyed(draw)})
    clusters = rows.select("__d", F.col(cluster).alias("__c")).distinct()
    numbers = running(clusters, ["__d"], "__c", {"one": F.lit(1)}).select(F.col("__d").alias("__d2"), "__c", F.col("before_one").cast("long").alias("__slot"), F.col("total_one").cast("long").alias("__n"))
    return rows.join(numbers, (F.col("__d") == F.col("__d2")) & F.col(cluster).eqNullSafe(F.col("__c"))).drop("__d2", "__c")


def _floats(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(float)


def _array(table: pa.Table, name: str) -> np.ndarray:
    return np.array(table[name][0].as_py(), float)


def _arrays(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(np.ascontiguousarray(matrix, dtype=float).ravel()))


def drawn(rows: DataFrame, seed: str, replicates: int) -> DataFrame:
    """(__d, __slot, __draws): how often each cluster of a draw is drawn in every replicate, a byte each; written."""
    slots = rows.select("__d", "__slot", "__n").distinct().withColumn("__part", F.floor(F.col("__slot") / SLOTS))

    def make(table: pa.Table) -> pa.Table:
        slot, n, key = table["__slot"].to_numpy(), table["__n"][0].as_py(), table["__d"][0].as_py()
        out = np.empty((len(slot), replicates), np.uint8)
        for first, count in _chunks(n, replicates):
            found = draws(seed, key, n, first, count)[slot]
            if found.max() > 255:  # one in 255! of the replicates
                raise OverflowError("a cluster is drawn more than 255 times")
            out[:, first : first + count] = found
        ends = np.arange(len(out) + 1, dtype=np.int32) * np.int32(replicates)
        bytes_of = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(ends), pa.py_buffer(out)])
        return pa.table({"__d": table["__d"], "__slot": table["__slot"], "__draws": bytes_of})

    return written(slots.groupBy("__d", "__part").applyInArrow(make, "__d string, __slot long, __draws binary"))


def _draws_of(table: pa.Table) -> np.ndarray:
    """The rows' draws, a matrix of rows times replicates."""
    column = table["__draws"].combine_chunks()
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _weights(rows: pa.Table, first: int, count: int) -> np.ndarray:
    """Of each row, by how much it counts in each replicate: its own count times its cluster's draws."""
    return _draws_of(rows)[:, first : first + count] * _floats(rows, "__count")[:, None]


def _run_offsets(runs: DataFrame, replicates: int) -> DataFrame:
    """(__g, __run, ahead, ahead_sum, all, all_sum): weights and weighted values of the runs ahead and of all, in each replicate."""

    def totals(rows: pa.Table) -> pa.Table:
        value, parts = _floats(rows, "__value"), []
        for first, count in _chunks(rows.num_rows, replicates):
            w = _weights(rows, first, count)
            parts.append((w.sum(axis=0), value @ w))
        w, s = (np.concatenate(x)[None] for x in zip(*parts, strict=True))
        return pa.table({"__g": rows["__g"][:1], "__run": rows["__run"][:1], "w": _arrays(w), "s": _arrays(s)})

    by_run = runs.groupBy("__g", "__run").applyInArrow(totals, "__g string, __run int, w array<double>, s array<double>")
    long = by_run.select("__g", "__run", F.posexplode(F.arrays_zip("w", "s")).alias("r", "x")).select("__g", "__run", "r", "x.w", "x.s")
    ahead, whole = Window.partitionBy("__g", "r").orderBy("__run"), Window.partitionBy("__g", "r")  # a row for each run of a group
    cols = [(F.sum("w").over(ahead) - F.col("w")).alias("a"), (F.sum("s").over(ahead) - F.col("s")).alias("b"), F.sum("w").over(whole).alias("c"), F.sum("s").over(whole).alias("d")]
    rows = long.select("__g", "__run", "r", *cols).groupBy("__g", "__run").agg(F.array_sort(F.collect_list(F.struct("r", "a", "b", "c", "d"))).alias("v"))
    every = lambda k: F.transform("v", lambda x: x[k])
    return rows.select("__g", "__run", *(every(k).alias(name) for k, name in (("a", "ahead"), ("b", "ahead_sum"), ("c", "all"), ("d", "all_sum"))))


def _sorted(rows: DataFrame, order: list[str], every: DataFrame) -> DataFrame:
    """rows with __run, their range in the order within __g, and their cluster's draws, written; the more rows, the more runs."""
    rows = written(rows)
    n = rows.count()
    runs = max(-(-n // RUN), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 512)), 1)
    return written(rows.join(every, ["__d", "__slot"]).repartitionByRange(runs, "__g", *order).withColumn("__run", F.spark_partition_id()))


def _in_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches are cut to BATCH_BYTES if they may be larger, as Spark reads this when a query starts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name)
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df


#: Takes weights ahead of each row, its own, the weighted values ahead, the values, and the weights and values of all; matrices are rows
#: times replicates. Gives a number for each replicate and name, which is summed over runs.
Measure = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def along(slotted_rows: DataFrame, order: Column, tie: str, value: Column, seed: str, replicates: int, measure: Measure) -> DataFrame:
    """(__g, name, r, value): a measure's sums along the rows' order (then tie) within each group, in every replicate."""
    rows = slotted_rows.select("__g", "__d", "__slot", "__n", F.lit(1).alias("__count"), order.alias("__order"), F.col(tie).alias("__tie"), value.cast("double").alias("__value"))
    runs = _sorted(rows, ["__order", "__tie"], drawn(rows, seed, replicates))
    offsets = _run_offsets(runs, replicates)

    def measured(table: pa.Table, ahead: pa.Table) -> pa.Table:
        table = table.sort_by([("__order", "ascending"), ("__tie", "ascending")])
        values, found = _floats(table, "__value"), []
        before, before_sum, whole, whole_sum = (_array(ahead, c) for c in ("ahead", "ahead_sum", "all", "all_sum"))
        for first, count in _chunks(table.num_rows, replicates):
            part = slice(first, first + count)
            w = _weights(table, first, count)
            k = before[part] + np.cumsum(w, axis=0) - w
            s = before_sum[part] + np.cumsum(w * values[:, None], axis=0) - w * values[:, None]
            found.append(measure(k, w, s, values[:, None], whole[part], whole_sum[part]))
        names = list(found[0])
        return pa.table({"__g": [table["__g"][0].as_py()] * len(names), "name": names, "v": _arrays(np.array([np.concatenate([f[n] for f in found]) for n in names]))})

    parts = runs.groupBy("__g", "__run").cogroup(offsets.groupBy("__g", "__run")).applyInArrow(measured, "__g string, name string, v array<double>")
    return parts.select("__g", "name", F.posexplode("v").alias("r", "value")).groupBy("__g", "name", "r").agg(F.sum("value").alias("value"))


def _aurc(k, w, s, e, whole, whole_sum):
    """Mean risk over all thresholds: a row drawn several times is a threshold each time."""
    total = np.zeros(w.shape[1])
    for m in range(1, int(w.max(initial=0)) + 1):
        total += np.where(w >= m, (s + m * e) / np.maximum(k + m, 1), 0.0).sum(axis=0)
    return {"area": total / whole, "mean": (w * e).sum(axis=0) / whole}


def _selected(budgets: list[float]) -> Measure:
    def measure(k, w, s, e, whole, whole_sum):
        most = {f"{b:g}": np.ceil(whole * b - 1e-9) for b in budgets}
        return {b: (np.clip(n - k, 0, w) * e).sum(axis=0) / n for b, n in most.items()} | {"mean": (w * e).sum(axis=0) / whole}

    return measure


def _median(k, w, s, e, whole, whole_sum):
    at = lambda p: (((k < p) & (p <= k + w)) * e).sum(axis=0)
    return {"median": (at(np.floor((whole + 1) / 2)) + at(np.ceil((whole + 1) / 2))) / 2}


def _wide(values: DataFrame, names: list[str], prefix: str = "") -> DataFrame:
    wide = values.groupBy("__g", "r").pivot("name", names).agg(F.first("value"))
    return wide.select("__g", "r", *(F.col(f"`{n}`").alias(f"{prefix}{n}") for n in names))


def _long(wide: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    return wide.select("__g", "r", F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in metrics.items()))))


def intervals(values: DataFrame, keys: list[str], least_share: float = 0.95) -> DataFrame:
    """(keys, estimate, low, high, n_valid) of values (keys, r, value): that of replicate 0, and the 2.5 and 97.5 % quantiles of the others.

    Replicates without a finite value do not count; where fewer than least_share of them do, the interval is null.
    """
    finite = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    values = written(values.select(*keys, "r", finite.alias("value")))
    drawn = values.filter("r > 0")
    facts = values.groupBy(*keys).agg(F.max(F.when(F.col("r") == 0, F.col("value"))).alias("estimate"), F.count(F.when(F.col("r") > 0, F.col("value"))).alias("n_valid"), F.count_if(F.col("r") > 0).alias("__all"))
    ends = quantiles(drawn, keys, F.col("value"), {"low": 0.025, "high": 0.975})
    ends = ends.select(*(F.col(c).alias(f"__k_{c}") for c in keys), "low", "high")
    rows = facts.join(ends, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys], "left")
    enough = F.col("n_valid") >= F.floor(F.col("__all") * least_share)
    return rows.select(*keys, "estimate", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"), "n_valid")


def _named(found: DataFrame, rows: DataFrame, group: list[str]) -> DataFrame:
    """found with the group's columns in place of its text."""
    return rows.select("__g", *group).distinct().join(found, "__g").drop("__g")


def aurc_values(rows: DataFrame, risk: str, error: str, tie: str, replicates: int, seed: str) -> DataFrame:
    own = along(rows, F.col(risk).cast("double"), tie, F.col(error), seed, replicates, _aurc)
    best = along(rows, F.col(error).cast("double"), tie, F.col(error), seed, replicates, _aurc)
    wide = _wide(own, ["area", "mean"]).join(_wide(best, ["area"], "best_"), ["__g", "r"])
    return _long(wide, {"excess_aurc": F.col("area") - F.col("best_area"), "reduction_pct": 100 * F.try_divide(F.col("mean") - F.col("area"), F.col("mean"))})


def bootstrap_aurc(df: DataFrame, group: list[str], cluster: str, risk: str, error: str, tie: str, replicates: int = REPLICATES, seed: str = "bootstrap", draw: list[str] | None = None) -> DataFrame:
    """(group, metric, estimate, low, high, n_valid) of excess_aurc and reduction_pct over cluster bootstraps.

    Rows without risk or error are left out. The order is by risk, and the best possible one by error, equal ones by tie. Draws are
    made in each draw, the group if none is given. Intervals are null for fewer than 4 clusters or 8 rows.
    """
    rows = written(slotted(df.filter(F.col(risk).isNotNull() & F.col(error).isNotNull()), group, group if draw is None else draw, cluster))
    found = intervals(aurc_values(rows, risk, error, tie, replicates + 1, seed), ["__g", "metric"], 0.1)
    sizes = rows.groupBy("__g").agg(((F.count("*") < 8) | (F.count_distinct("__slot") < 4)).alias("few"))
    found = found.join(sizes, "__g").select("__g", "metric", "estimate", *(F.when(~F.col("few"), F.col(c)).alias(c) for c in ("low", "high")), "n_valid")
    return _named(found, rows, group)


def bootstrap_utility(df: DataFrame, group: list[str], cluster: str, score: str, error: str, tie: str, budgets: list[float], replicates: int = REPLICATES, seed: str = "bootstrap", draw: list[str] | None = None) -> DataFrame:
    """(group, metric, estimate, low, high, n_valid): for each budget, how far the mean error of the highest scores lies from that of all towards that of the greatest errors."""
    rows = written(slotted(df.filter(F.col(score).isNotNull() & F.col(error).isNotNull()), group, group if draw is None else draw, cluster))
    names = [f"{b:g}" for b in budgets]
    own = _wide(along(rows, -F.col(score).cast("double"), tie, F.col(error), seed, replicates + 1, _selected(budgets)), [*names, "mean"], "own_")
    best = _wide(along(rows, -F.col(error).cast("double"), tie, F.col(error), seed, replicates + 1, _selected(budgets)), names, "best_")
    gap = lambda side, b: F.col(f"`{side}_{b}`") - F.col("own_mean")
    values = _long(own.join(best, ["__g", "r"]), {b: F.when(gap("best", b) > 1e-15, gap("own", b) / gap("best", b)) for b in names})
    return _named(intervals(values, ["__g", "metric"]), rows, group)


def bootstrap_median(df: DataFrame, group: list[str], cluster: str, value: str, tie: str, replicates: int = REPLICATES, seed: str = "bootstrap", draw: list[str] | None = None) -> DataFrame:
    """(group, estimate, low, high, n_valid) of the median of value; rows without it are left out."""
    rows = written(slotted(df.filter(F.col(value).isNotNull()), group, group if draw is None else draw, cluster))
    values = along(rows, F.col(value).cast("double"), tie, F.col(value), seed, replicates + 1, _median).select("__g", "r", "value")
    return _named(intervals(values, ["__g"]), rows, group)


def _weighted_ranks(rows: DataFrame, value: str, every: DataFrame, replicates: int) -> DataFrame:
    """(__g, value, twice): twice the average rank of each distinct value in every replicate, a whole number; rows of a cluster are summed up first."""
    cells = rows.groupBy("__g", "__d", "__slot", "__n", F.col(value).cast("double").alias("__value")).agg(F.count("*").alias("__count"))
    runs = _sorted(cells, ["__value", "__slot"], every)  # a value of many clusters is in several runs

    def ranked(table: pa.Table, ahead: pa.Table) -> pa.Table:
        table = table.sort_by("__value")
        values = _floats(table, "__value")
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        before, twice, ends = _array(ahead, "ahead"), np.empty((len(starts), replicates), np.int64), sorted({0, len(starts) - 1})
        own = np.empty((len(ends), replicates), np.int64)
        for first, count in _chunks(table.num_rows, replicates):
            part = slice(first, first + count)
            w = np.add.reduceat(_weights(table, first, count), starts, axis=0)
            less = before[part] + np.cumsum(w, axis=0) - w
            twice[:, part] = 2 * less + w + 1
            twice[ends, part], own[:, part] = less[ends], w[ends]  # the runs beside this one may hold more of these values
        at = np.full(len(starts), len(ends))
        at[ends] = np.arange(len(ends))
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * replicates, pa.int32()), pa.array(m.ravel())) for m in (twice, own)]
        return pa.table({"__g": [table["__g"][0].as_py()] * len(starts), "value": values[starts], "twice": lists[0], "own": lists[1].take(pa.array(at, mask=at == len(ends)))})

    schema = "__g string, value double, twice array<long>, own array<long>"
    parts = written(runs.groupBy("__g", "__run").cogroup(_run_offsets(runs, replicates).groupBy("__g", "__run")).applyInArrow(ranked, schema))
    pieces = parts.filter("own is not null").select("__g", "value", F.posexplode(F.arrays_zip("twice", "own")).alias("r", "x"))  # two values of each run at most
    sums = pieces.groupBy("__g", "value", "r").agg((2 * F.min("x.twice") + F.sum("x.own") + 1).alias("t"))
    joined = sums.groupBy("__g", "value").agg(F.array_sort(F.collect_list(F.struct("r", "t"))).alias("v")).select("__g", "value", F.transform("v", lambda x: x["t"]).alias("twice"))
    return written(parts.filter("own is null").select("__g", "value", "twice").unionByName(joined))


def spearman_values(rows: DataFrame, scores: list[str], outcome: str, replicates: int, seed: str) -> DataFrame:
    """(__g, r, metric, value): of each score the rank correlation with outcome in every replicate, and the first one's less each other's."""
    columns = [outcome, *scores]
    cells = rows.groupBy("__g", "__d", "__slot", "__n", *(F.col(c).cast("double").alias(f"__v{k}") for k, c in enumerate(columns))).agg(F.count("*").alias("__count"))
    every = drawn(rows, seed, replicates)
    cells = cells.join(every, ["__d", "__slot"])
    for k, c in enumerate(columns):
        ranks = _weighted_ranks(rows, c, every, replicates).select(F.col("__g").alias("__h"), F.col("value").alias("__u"), F.col("twice").alias(f"__r{k}"))
        cells = cells.join(ranks, (F.col("__g") == F.col("__h")) & (F.col(f"__v{k}") == F.col("__u"))).drop("__h", "__u", f"__v{k}")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            groups = np.array(batch["__g"].to_pylist(), object)
            for g in dict.fromkeys(groups):
                rows = pa.table(batch).take(np.flatnonzero(groups == g))
                w = _weights(rows, 0, replicates)
                r = [rows[f"__r{k}"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1) / 2 for k in range(len(columns))]
                found = np.array([w.sum(axis=0), *((w * x * x).sum(axis=0) for x in r), *((w * r[0] * x).sum(axis=0) for x in r[1:])])
                sums[g] = sums[g] + found if g in sums else found
        for g, found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(found)), pa.array(range(len(found)), pa.int32()), _arrays(found)], names=["__g", "k", "v"])

    parts = _in_batches(cells.drop("__v0")).mapInArrow(products, "__g string, k int, v array<double>")
    sums = parts.select("__g", "k", F.posexplode("v").alias("r", "x")).groupBy("__g", "r").pivot("k", list(range(2 * len(columns)))).agg(F.sum("x"))
    n, of = F.col("0"), lambda k: F.col(str(k))
    middle = n * (n + 1) * (n + 1) / 4
    spread = lambda k: of(1 + k) - middle
    rho = {c: F.when((spread(0) > 1e-9) & (spread(k) > 1e-9), (of(len(columns) + k) - middle) / F.sqrt(spread(0) * spread(k))) for k, c in enumerate(columns) if k}
    first = scores[0]
    return _long(sums, rho | {f"{first} - {c}": rho[first] - rho[c] for c in scores[1:]})


def bootstrap_spearman(df: DataFrame, group: list[str], cluster: str, scores: list[str], outcome: str, replicates: int = REPLICATES, seed: str = "bootstrap", draw: list[str] | None = None) -> DataFrame:
    """(group, metric, estimate, low, high, n_valid): rank correlations of scores with outcome, and of the first score the gain over each other on the same draws.

    Rows that lack one of the values are left out. Ranks are averages over equal values, copies of drawn clusters included.
    """
    rows = written(slotted(df.dropna(subset=[*scores, outcome]), group, group if draw is None else draw, cluster))
    return _named(intervals(spearman_values(rows, scores, outcome, replicates + 1, seed), ["__g", "metric"]), rows, group)


def fold_values(df: DataFrame, dataset: str, fold: str, cluster: str, scores: list[str], outcome: str, replicates: int, seed: str) -> DataFrame:
    """(dataset, r, metric, value): correlations within folds, averaged over a data set's folds; a replicate draws clusters of the whole set."""
    rows = written(slotted(df.dropna(subset=[*scores, outcome]), [dataset, fold], [dataset], cluster))
    values = _named(spearman_values(rows, scores, outcome, replicates, seed), rows, [dataset, fold])
    return written(values.groupBy(dataset, "r", "metric").agg(F.avg("value").alias("value")))


def bootstrap_folds(df: DataFrame, dataset: str, fold: str, cluster: str, scores: list[str], outcome: str, replicates: int = REPLICATES, seed: str = "bootstrap") -> DataFrame:
    """(dataset, metric, estimate, low, high, n_valid) of correlations averaged over folds."""
    return intervals(fold_values(df, dataset, fold, cluster, scores, outcome, replicates + 1, seed), [dataset, "metric"])


def bootstrap_hierarchical(df: DataFrame, dataset: str, fold: str, cluster: str, scores: list[str], outcome: str, replicates: int = REPLICATES, seed: str = "bootstrap") -> DataFrame:
    """(metric, estimate, low, high, n_valid, above_zero): data sets are drawn with replacement, clusters anew for each time a set is drawn, and the sets' fold means averaged.

    A set has as many replicates of its own as it is drawn over all; they are used one after the other. Data sets are few.
    """
    names = sorted((r[0] for r in df.select(dataset).distinct().collect()), key=lambda x: (x is not None, x))
    times = draws(seed, "datasets", len(names), 0, replicates + 1)[:, 1:]
    values = fold_values(df, dataset, fold, cluster, scores, outcome, int(times.sum(axis=1).max()) + 1, seed)
    uses = [(0, name, 0) for name in names]
    for name, row in zip(names, times, strict=True):
        after = 1
        for r, n in enumerate(row.tolist(), 1):
            uses += [(r, name, after + k) for k in range(n)]
            after += n
    kind = df.schema[dataset].dataType.simpleString()
    used = df.sparkSession.createDataFrame(uses, f"draw int, `__set` {kind}, own int")
    joined = used.join(values, F.col("__set").eqNullSafe(F.col(dataset)) & (F.col("own") == F.col("r")))
    means = written(joined.groupBy("metric", F.col("draw").alias("r")).agg(F.avg("value").alias("value")))
    above = means.filter("r > 0").groupBy("metric").agg(F.avg((F.col("value") > 0).cast("double")).alias("above_zero"))
    return intervals(means, ["metric"]).join(above, "metric")
