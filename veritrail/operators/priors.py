"""Predictions from tasks that are alike by their labels or controls: smoothing over nearest neighbours, and ridge on labels.

Nearest neighbours are exact. Queries and sources of a pool are dealt into blocks of at most about BLOCK rows by the hash of their ids, every
block of queries meets every block of sources as matrices, and only the best of each query in a block leave the task: a vector is
copied once for each block of the other side, not for each of its rows, and no group is larger than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions import vectors as vec
from veritrail.operators import tiles
from veritrail.operators.programs import ProgramBank, Ridge, _matrix, _vectors, baseline_and_source, fit_programs, fit_ridge, hashed_label, vector_sums
from veritrail.sources.storage import written

#: Rows of a block of queries or sources at most, about; pools of less than 2 * BLOCK rows have blocks of a quarter, as few large ones leave cores idle.
BLOCK = 32768
#: Products of two blocks held at a time.
PRODUCTS = 4_000_000

#: Words that mark a label as one of a pathway. Fixed values.
PATHWAYS = {
    "cell_cycle": ["CDK", "CCN", "MKI", "E2F", "MYC", "AURK", "PLK"],
    "immune_ifn": ["IFN", "STAT", "IRF", "JAK", "ISG", "CXCL", "IL"],
    "stress_apoptosis": ["TP53", "BAX", "CASP", "BCL", "ATF", "JUN", "FOS", "DDIT"],
    "chromatin": ["HDAC", "KDM", "DNMT", "EZH", "EP300", "SMAR", "BRD"],
    "metabolism": ["MTOR", "AMPK", "PPAR", "SLC", "LDH", "G6P", "ACLY"],
    "tf_program": ["SOX", "GATA", "FOXP", "RUNX", "NFKB", "CEBP", "KLF", "POU"],
}


def unit_or_zero(v: Column) -> Column:
    """v over its norm, or over 1e-8 where the norm is less."""
    return vec.let(F.greatest(vec.norm(v), F.lit(1e-8)), lambda n: F.transform(v, lambda x: x / n))


def prior_features(perturbation: Column, context: Column, size: int = 64) -> Column:
    """A mark for each pathway that a word of the labels names, then their pair hashed to so many places; of length one."""
    a, b = (F.coalesce(c.cast("string"), F.lit("")) for c in (perturbation, context))
    text = F.upper(F.concat_ws(" ", a, b))
    marks = [F.when(text.rlike("|".join(words)), 1.0).otherwise(0.0) for words in PATHWAYS.values()]
    return unit_or_zero(F.concat(F.array(*marks), hashed_label(F.concat_ws("::", a, b), size)))


def _slices(rows: int, width: int) -> Iterator[slice]:
    size = max(1, PRODUCTS // max(width, 1))
    return (slice(first, min(first + size, rows)) for first in range(0, rows, size))


def _blocks(queries: DataFrame, sources: DataFrame, pool: list[str]) -> DataFrame:
    """(pool, q_blocks, s_blocks): how many blocks each side of a pool has; 8 up to 8 * BLOCK rows, so copies grow with the rows until there."""
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(BLOCK // 4), F.count("*") / 8))
    q, s = (r.groupBy(*pool).agg(F.ceil(F.count("*") / block).cast("int").alias(f"{side}_blocks")) for r, side in ((queries, "q"), (sources, "s")))
    return written(q.join(s, pool))


def _blocked(rows: DataFrame, pool: list[str], id: str, vector: str, side: str, other: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """rows with their own block and, repeated, every block of the other side's; other: (pool, blocks of this side, of that side)."""
    own, theirs = (f"{side}_blocks", "s_blocks" if side == "q" else "q_blocks")
    named = rows.select(*pool, F.col(id).alias("id"), F.col(vector).alias("v"), *more).filter("v is not null").join(other, pool)
    block, meets = F.pmod(F.xxhash64("id"), F.col(own)), F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))  # counts are ints
    mine = named.withColumn("mine", block.cast("int")).withColumn("meets", meets)
    q, s = ("mine", "meets") if side == "q" else ("meets", "mine")
    columns = {**{p: p for p in pool}, "q_block": q, "s_block": s, "id": "id", "v": "v", **{c: c for c in more}}
    return mine.select(*(F.col(c).alias(name) for name, c in columns.items()))  # columns of its own, as both sides may come of one table


def dealt(left: DataFrame, right: DataFrame, keys: list[str], blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt by keys to as many tasks as pairs of blocks meet: the work grows with the pairs, not with the bytes by which Spark would join tasks."""
    n = int(blocks.agg(F.sum(F.col("q_blocks").cast("long") * F.col("s_blocks"))).first()[0] or 1)
    return tuple(side.repartition(n, *keys) for side in (left, right))


def nearest(queries: DataFrame, sources: DataFrame, pool: list[str], k: int) -> DataFrame:
    """(pool, id, source, score, nth): of each query (pool, id, v) the k sources (pool, source, w) of its pool with the greatest inner product, equal ones by source.

    Vectors are of one length; rows without one or without a pool take no part. Ids tell rows apart.
    """
    blocks = _blocks(queries, sources, pool)
    keys = [*pool, "q_block", "s_block"]
    left, right = _blocked(queries, pool, "id", "v", "q", blocks), _blocked(sources, pool, "source", "w", "s", blocks)
    left, right = dealt(left, right, keys, blocks)
    fields = [*(queries.schema[p] for p in pool), queries.schema["id"]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", source {sources.schema['source'].dataType.simpleString()}, score double"

    def best(q: pa.Table, s: pa.Table) -> pa.Table:
        if not q.num_rows or not s.num_rows:
            return q.select([*pool, "id"]).slice(0, 0).append_column("source", s["id"].slice(0, 0)).append_column("score", pa.array([], pa.float64()))
        a, b = (_matrix(t["v"].combine_chunks()) for t in (q, s))
        place = np.empty(len(b), np.int64)
        place[pc.sort_indices(s["id"]).to_numpy()] = np.arange(len(b))
        na, nb = (np.linalg.norm(x, axis=1) for x in (a, b))
        alike = nb.max() <= 4 * np.median(nb) and 1e-15 < nb.max() < 1e15 and na.max() < 1e15
        kind = np.float32 if alike else np.float64
        exact = lambda i, j: np.concatenate([(a[i[c : c + tiles.PAIRS]] * b[j[c : c + tiles.PAIRS]]).sum(axis=1) for c in range(0, max(1, len(i)), tiles.PAIRS)])
        rough = tiles.products(a, b, kind, min(PRODUCTS, tiles.PRODUCTS))
        i, j, score = tiles.best(rough, k, tiles.slack(a.shape[1], kind) * na * nb.max(), place, exact)
        out = q.select([*pool, "id"]).take(pa.array(i)).append_column("source", s["id"].take(pa.array(j))).append_column("score", pa.array(score))
        return out.combine_chunks()

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, schema)
    at = F.row_number().over(Window.partitionBy(*pool, "id").orderBy(F.desc("score"), "source"))
    return found.withColumn("nth", at).filter(F.col("nth") <= k)


def clipped_weights(found: DataFrame, pool: list[str]) -> DataFrame:
    """found with weight: scores above zero as shares of their sum, even shares where there are none."""
    w = Window.partitionBy(*pool, "id")  # k rows
    above = F.greatest("score", F.lit(0.0))
    total = F.sum(above).over(w)
    return found.withColumn("weight", F.when(total > 1e-8, above / total).otherwise(1 / F.count("*").over(w)))


def lifted_weights(found: DataFrame, pool: list[str], least: float = 1e-3) -> DataFrame:
    """found with weight: scores above the neighbours' lowest, plus least, as shares of their sum."""
    w = Window.partitionBy(*pool, "id")
    rows = found.withColumn("__lift", F.col("score") - F.min("score").over(w) + least)
    return rows.withColumn("weight", F.col("__lift") / F.sum("__lift").over(w)).drop("__lift")


def averaged(found: DataFrame, effects: DataFrame, pool: list[str], out: str) -> DataFrame:
    """(pool, id, out): the neighbours' effects (source, effect) averaged by weight."""
    long = found.join(effects.select("source", "effect"), "source").select(*pool, "id", "weight", F.posexplode("effect").alias("__at", "__x"))
    sums = long.groupBy(*pool, "id", "__at").agg(F.sum(F.col("weight") * F.col("__x")).alias("__s"))
    rows = sums.groupBy(*pool, "id").agg(F.array_sort(F.collect_list(F.struct("__at", "__s"))).alias("__v"))
    return rows.select(*pool, "id", F.transform("__v", lambda s: s["__s"]).alias(out))


def _joined(tasks: DataFrame, vectors: DataFrame, pool: list[str]) -> DataFrame:
    return tasks.join(vectors, [*pool, "id"], "left")


def _sources(rows: DataFrame, pool: list[str], vector: str) -> DataFrame:
    return rows.filter("train").select(*pool, F.col("id").alias("source"), F.col(vector).alias("w"))


def _effects(tasks: DataFrame) -> DataFrame:
    return tasks.filter("train").select(F.col("id").alias("source"), "effect")


def prior_smoothed(tasks: DataFrame, pool: list[str], out: str, k: int = 7, size: int = 128) -> DataFrame:
    """tasks (pool, id, context, perturbation, effect, train, ...) with out: effects of the k training tasks with the likest labels, weighted by likeness.

    A training task is its own neighbour. out is null in pools without training tasks.
    """
    rows = written(tasks.select(*pool, "id", "train", prior_features(F.col("perturbation"), F.col("context"), size).alias("__p")))
    found = nearest(rows.select(*pool, "id", F.col("__p").alias("v")), _sources(rows, pool, "__p"), pool, k)
    return _joined(tasks, averaged(clipped_weights(found, pool), _effects(tasks), pool, out), pool)


def barycentric(tasks: DataFrame, pool: list[str], out: str, k: int = 7, size: int = 96, control_share: float = 0.55) -> DataFrame:
    """tasks (control beside the columns of prior_smoothed) with out: effects of the k training tasks that are likest by control and labels together."""
    weigh = lambda v, share: F.transform(unit_or_zero(v), lambda x: x * share**0.5)
    both = F.concat(weigh(F.col("control"), control_share), weigh(prior_features(F.col("perturbation"), F.col("context"), size), 1 - control_share))
    rows = written(tasks.select(*pool, "id", "train", both.alias("__b")))
    found = nearest(rows.select(*pool, "id", F.col("__b").alias("v")), _sources(rows, pool, "__b"), pool, k)
    return _joined(tasks, averaged(lifted_weights(found, pool), _effects(tasks), pool, out), pool)


def latent_delta(tasks: DataFrame, bank: ProgramBank, pool: list[str], out: str, k: int = 5, size: int = 96, own: float = 0.65) -> DataFrame:
    """tasks with out: in program space the mean of the perturbation's training tasks (of all, for an unknown one) blended with prior_smoothed.

    Training effects enter the smoothing as the bank gives them back.
    """
    train = written(tasks.filter("train").select("id", "perturbation", bank.scores(F.col("effect")).alias("z")))
    mean = lambda rows, keys, name: vector_sums(rows, keys, "z", "__s", "__n").select(*keys, F.transform("__s", lambda x: x / F.col("__n")).alias(name))
    known = mean(train, ["perturbation"], "__own")
    overall = mean(train.withColumn("__all", F.lit(0)), ["__all"], "__whole").drop("__all")  # one row
    restored = train.select(F.col("id").alias("source"), bank.restored(F.col("z")).alias("effect"))
    rows = written(tasks.select(*pool, "id", "train", prior_features(F.col("perturbation"), F.col("context"), size).alias("__p")))
    found = nearest(rows.select(*pool, "id", F.col("__p").alias("v")), _sources(rows, pool, "__p"), pool, k)
    smooth = averaged(clipped_weights(found, pool), restored, pool, "__smooth").withColumn("__near", bank.scores(F.col("__smooth"))).drop("__smooth")
    wide = _joined(tasks, smooth, pool).join(known, "perturbation", "left").join(F.broadcast(overall))
    blended = F.zip_with(F.coalesce("__own", "__whole"), "__near", lambda a, b: own * a + (1 - own) * b)
    some = wide.filter("__near is not null").withColumn(out, bank.restored(blended)).select(*tasks.columns, out)
    none = wide.filter("__near is null").withColumn(out, F.lit(None).cast("array<double>")).select(*tasks.columns, out)
    return some.unionByName(none)


def label_ridge(tasks: DataFrame, out: str, penalty: float = 5.0, size: int = 128, most_control: int = 256) -> DataFrame:
    """tasks with out: ridge of training effects on the hashed labels, their products place by place and the control's first positions; it leaves out the mean effect."""
    pert, ctx = (hashed_label(F.coalesce(F.col(c).cast("string"), F.lit("")), size) for c in ("perturbation", "context"))
    wide = tasks.withColumns({"__p": pert, "__c": ctx})
    wide = written(wide.withColumn("__x", F.concat("__p", "__c", F.zip_with("__p", "__c", lambda a, b: a * b), F.slice("control", 1, most_control))).drop("__p", "__c"))
    fit = fit_ridge(wide.filter("train"), "__x", "effect", penalty)
    model = Ridge(fit.mean, fit.scale, np.zeros_like(fit.target_mean), fit.coefficients)
    return wide.withColumn(out, model.predicted(F.col("__x"))).select(*tasks.columns, out)


def graph_transported(tasks: DataFrame, pool: list[str], out: str, n_programs: int = 64, mode: str = "combo", penalty: float = 5.0, size: int = 96, k: int = 5, share: float = 0.18) -> DataFrame:
    """tasks with base, the strong baseline, and out: base blended with what ridge carries over from sources, controls and alike labels in program space.

    Features are the programs' scores of the source effect, the control and the smoothed effect, the labels' features, and the products
    of the first and third scores. out is null in pools without training tasks.
    """
    bank = fit_programs(tasks.filter("train"), "effect", n_programs, mode)
    smooth = written(prior_smoothed(tasks, pool, "__smooth", k, size).select(*pool, "id", "__smooth").filter("__smooth is not null"))
    rows = written(baseline_and_source(tasks).join(smooth, [*pool, "id"]))
    rows = rows.withColumns({"__s": bank.scores(F.col("source")), "__c": bank.scores(F.col("control")), "__n": bank.scores(F.col("__smooth")), "__y": bank.scores(F.col("effect"))})
    features = F.concat("__s", "__c", "__n", prior_features(F.col("perturbation"), F.col("context"), size), F.zip_with("__s", "__n", lambda a, b: a * b))
    rows = written(rows.withColumn("__x", features).select(*pool, "id", "train", "base", "__x", "__y"))
    model = fit_ridge(rows.filter("train"), "__x", "__y", penalty)
    carried = bank.restored(model.predicted(F.col("__x")))
    found = rows.withColumn(out, F.zip_with("base", carried, lambda b, c: (1 - share) * b + share * c)).select(*pool, "id", "base", out)
    return tasks.join(found, [*pool, "id"], "left")


def with_support(tasks: DataFrame, out: str = "uncertainty") -> DataFrame:
    """tasks with out: one over one more than the training tasks of the same perturbation in other contexts; tasks without perturbation or context have no support."""
    train = tasks.filter("train")
    whole = train.groupBy("perturbation").agg(F.count("*").alias("__all"))
    own = train.groupBy("perturbation", "context").agg(F.count("*").alias("__own"))
    rows = tasks.join(whole, "perturbation", "left").join(own, ["perturbation", "context"], "left")
    support = F.when(F.col("context").isNotNull(), F.coalesce("__all", F.lit(0)) - F.coalesce("__own", F.lit(0))).otherwise(0)
    return rows.withColumn(out, 1 / (1 + support)).select(*tasks.columns, out)


def _weighted_by_control(temperature: float):
    def run(q: pa.Table, s: pa.Table) -> pa.Table:
        empty = not q.num_rows or not s.num_rows
        a, b, e = (np.zeros((0, 1)) if empty else _matrix(c.combine_chunks()) for c in (q["v"], s["v"], s["effect"]))
        out = {"id": [], "other": [], "n": [], "likest": [], "sums": []}
        if not empty:
            codes = pa.chunked_array([*q["context"].chunks, *s["context"].chunks]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
            for part in _slices(len(a), len(b)):
                likeness = (a[part] @ b.T) / (np.outer(na[part], nb) + 1e-8)
                apart = codes[: len(a)][part][:, None] != codes[None, len(a) :]
                weight = np.exp(temperature * likeness)  # between exp(-t) and exp(t), so sums need no shift
                for other, mask in ((True, apart), (False, ~apart)):
                    w = weight * mask
                    n = mask.sum(axis=1)
                    at = np.nonzero(n)[0]
                    out["id"].append(q["id"].take(pa.array(at + part.start)).combine_chunks())
                    out["other"].append(pa.array(np.full(len(at), other)))
                    out["n"].append(pa.array(n[at].astype(np.int64)))
                    out["likest"].append(pa.array(np.where(mask, likeness, -np.inf).max(axis=1)[at]))
                    out["sums"].append(_vectors(np.hstack([w.sum(axis=1, keepdims=True), w @ e])[at]))
        types = {"id": q.schema.field("id").type, "other": pa.bool_(), "n": pa.int64(), "likest": pa.float64(), "sums": pa.list_(pa.float64())}
        return pa.table({c: pa.chunked_array(out[c], t) for c, t in types.items()})

    return run


def control_transported(tasks: DataFrame, out: str, temperature: float = 5.0, least: float = 0.35) -> DataFrame:
    """tasks (id, context, perturbation, control, effect, train, ...) with out, likeness and unsafe: effects of the perturbation's training
    tasks in other contexts (in any, if it has none there), weighted by exp(temperature * cosine of controls).

    likeness is the greatest cosine among them and unsafe says that it is below least; unknown perturbations have the mean training effect
    and likeness 0. Weighted sums are made block by block, so a perturbation of any size meets itself without a row for each pair.
    """
    pool = ["perturbation"]
    rows = written(tasks.select("id", "perturbation", "context", "control", "effect", "train"))
    train = rows.filter("train")
    blocks = _blocks(rows, train, pool)
    left = _blocked(rows, pool, "id", "control", "q", blocks, ("context",))
    right = _blocked(train, pool, "id", "control", "s", blocks, ("context", "effect"))
    keys = [*pool, "q_block", "s_block"]
    schema = f"id {tasks.schema['id'].dataType.simpleString()}, other boolean, n long, likest double, sums array<double>"
    parts = written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_weighted_by_control(temperature), schema))
    facts = parts.groupBy("id", "other").agg(F.max("likest").alias("__likest"))
    long = parts.select("id", "other", F.posexplode("sums").alias("at", "x")).groupBy("id", "other", "at").agg(F.sum("x").alias("x"))
    sums = long.groupBy("id", "other").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs")).select("id", "other", F.transform("xs", lambda s: s["x"]).alias("__v"))
    mean = F.transform(F.slice("__v", 2, F.size("__v") - 1), lambda x: x / F.get("__v", F.lit(0)))
    best = facts.join(sums, ["id", "other"]).groupBy("id").agg(F.max_by(F.struct(mean.alias("__mean"), "__likest"), "other").alias("__best"))  # other contexts first
    whole = vector_sums(train.withColumn("__k", F.lit(0)), ["__k"], "effect", "__t", "__tn").select(F.transform("__t", lambda x: x / F.col("__tn")).alias("__whole"))  # one row
    wide = tasks.join(best, "id", "left").join(F.broadcast(whole))
    likeness = F.coalesce("__best.__likest", F.lit(0.0))
    return wide.withColumns({out: F.coalesce("__best.__mean", "__whole"), "likeness": likeness, "unsafe": likeness < least}).select(*tasks.columns, out, "likeness", "unsafe")
