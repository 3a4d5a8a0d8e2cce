"""Nearest neighbours, retrieval and projections among vectors of a pool.

Every query meets only its own pool. A pool's queries and sources are dealt into blocks that meet as matrices (see priors): what leaves
a task are the best of each query or counts, never pairs, and a task holds two blocks. The work grows with the square of a pool.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window

from veritrail.functions import vectors as vec
from veritrail.operators import priors, tiles
from veritrail.sources.storage import written


#: Products of one tile.
PRODUCTS = tiles.PRODUCTS
#: Cosines count where the product of norms is above LEAST; norms outside FIT are too small or great for rough products.
LEAST, FIT = 1e-12, (1e-100, 1e100)


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt(tiles.strict_sums(len(a), (x * x for x in a.T)))


def _equal_ids(q: pa.ChunkedArray, s: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of q and s with the same id, in order of q's."""
    a, b = (pd.DataFrame({"k": x.to_pandas(), name: np.arange(len(x))}) for x, name in ((q, "i"), (s, "j")))
    both = a.merge(b, "inner", "k").sort_values("i")
    return both["i"].to_numpy(), both["j"].to_numpy()


def places(ids: pa.ChunkedArray) -> np.ndarray:
    """Of each id its number in their order."""
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return out


def _clean(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has entries and lacks none, with its length."""
    known = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    return rows.filter(known).withColumn("__size", F.size(vector))


@F.arrow_udf(BinaryType())
def _packed(vector: pa.Array) -> pa.Array:
    """Vectors as their bytes: a copy for each block is then moved as a whole, not number by number."""
    sizes = pc.fill_null(pc.list_value_length(vector), 0).to_numpy()
    ends = np.append(0, np.cumsum(sizes, dtype=np.int32) * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(vector), [None, pa.py_buffer(ends), pa.py_buffer(vector.flatten().to_numpy(zero_copy_only=False).tobytes())])


def _unpacked(column: pa.Array) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.float64)[ends[0] // 8 : ends[-1] // 8].reshape(len(column), -1)


def _met(queries: DataFrame, sources: DataFrame, pool: list[str], run, columns: str, more: tuple[str, ...] = ()) -> DataFrame:
    """(pool, id, columns) as run(a, b, q, s) gives them for every block of queries (id, v, more) and of sources (source, w) of a pool.

    a and b are the blocks' vectors, q and s their tables; run gives the rows of q and the columns. Only vectors of one length meet.
    """
    q, s = (_clean(rows, c).withColumn(c, _packed(F.col(c).cast("array<double>"))) for rows, c in ((queries, "v"), (sources, "w")))
    meet = [*pool, "__size"]
    blocks = priors._blocks(q, s, meet)
    keys = [*meet, "q_block", "s_block"]
    left, right = priors._blocked(q, meet, "id", "v", "q", blocks, more), priors._blocked(s, meet, "source", "w", "s", blocks)
    kept = [*pool, "id"]
    left, right = priors.dealt(left, right, keys, blocks)
    names = ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in kept)

    def task(q: pa.Table, s: pa.Table) -> pa.Table:
        if not q.num_rows or not s.num_rows:
            return None
        a, b = (_unpacked(t["v"].combine_chunks()) for t in (q, s))
        rows, found = run(a, b, q, s)
        return pa.table({**{c: q[c].take(pa.array(rows)) for c in kept}, **found}).combine_chunks()

    def both(q: pa.Table, s: pa.Table) -> pa.Table:
        out = task(q, s)
        return schema.empty_table() if out is None else out.cast(schema)

    out = f"{names}, {columns}"
    schema = to_arrow_schema(queries.sparkSession.createDataFrame([], out).schema)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(both, out)


def _cosine(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray):
    """Cosines of rows i of a and j of b as vec.cosine has them."""

    def exact(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return tiles.paired(a, b, i, j, np.multiply) / (na[i] * nb[j])

    return exact


def _plain(na: np.ndarray, nb: np.ndarray) -> bool:
    """All pairs have a cosine that rough products give."""
    return na.min() * nb.min() > LEAST and all(FIT[0] < n.min() and n.max() < FIT[1] for n in (na, nb))


def _cosines(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, kind: type = np.float32) -> Iterator[tiles.Tile]:
    """Rough cosines by tiles; -inf where there is none, NaN where it is NaN."""
    plain = _plain(na, nb)
    with np.errstate(all="ignore"):
        fit_a, fit_b = ((FIT[0] < n) & (n < FIT[1]) for n in (na, nb))
        for rows, columns, rough in tiles.products(a / na[:, None], b / nb[:, None], kind, PRODUCTS):
            if not plain:
                size = na[rows, None] * nb[columns]
                i, j = np.nonzero(~(fit_a[rows, None] & fit_b[columns]) & (size > LEAST))
                rough[i, j] = _cosine(a, b, na, nb)(i + rows.start, j + columns.start)
                rough[np.isnan(size)] = np.nan
                rough[size <= LEAST] = -np.inf
            yield rows, columns, rough


def neighbours(queries: DataFrame, sources: DataFrame, pool: list[str], k: int, others: bool = False) -> DataFrame:
    """(pool, id, source, cosine, nth): the k sources of the greatest cosine in each query's pool, equal ones by source; others: not the query's own id.

    Blocks of queries and sources meet as matrices; rough products choose who may be among the best, and these are scored as
    vec.cosine does. Only the best k of each query in a block leave its task.
    """

    def run(a, b, q, s):
        na, nb = _norms(a), _norms(b)
        own, theirs = _equal_ids(q["id"], s["id"]) if others else (np.zeros(0, np.int64),) * 2

        def met():
            for rows, columns, rough in _cosines(a, b, na, nb):
                if not _plain(na, nb):
                    rough[np.isnan(rough)] = np.inf  # Spark's order has NaN above all
                mine = slice(*np.searchsorted(own, (rows.start, rows.stop)))
                here = (theirs[mine] >= columns.start) & (theirs[mine] < columns.stop)
                rough[own[mine][here] - rows.start, theirs[mine][here] - columns.start] = -np.inf
                yield rows, columns, rough

        i, j, score = tiles.best(met(), k, np.full(len(a), tiles.slack(a.shape[1])), places(s["id"]), _cosine(a, b, na, nb))
        return i, {"source": s["id"].take(pa.array(j)), "cosine": pa.array(score)}

    found = _met(queries, sources, pool, run, f"source {sources.schema['source'].dataType.simpleString()}, cosine double")
    at = F.row_number().over(Window.partitionBy(*pool, "id").orderBy(F.desc("cosine"), "source"))  # k rows of each block
    return found.withColumn("nth", at).filter(F.col("nth") <= k)


def likeness(queries: DataFrame, sources: DataFrame, pool: list[str]) -> DataFrame:
    """(pool, id, n, greatest, mean) of each query's cosines with the sources of its pool.

    The mean needs no pairs where all norms are above zero: it is a product with the sum of the sources' unit vectors.
    """

    def run(a, b, q, s):
        na, nb = _norms(a), _norms(b)
        some, known = np.flatnonzero(na != 0), nb != 0
        a, b, na, nb = a[some], b[known], na[some], nb[known]
        n, top, total = np.zeros(len(a), np.int64), np.full(len(a), -np.inf), np.zeros(len(a))
        if len(a) and len(b):
            plain, off, exact = _plain(na, nb), 2 * tiles.slack(a.shape[1]), _cosine(a, b, na, nb)
            rough_top = np.full(len(a), -np.inf, np.float32)
            for rows, columns, rough in _cosines(a, b, na, nb):
                n[rows] += rough.shape[1] - (0 if plain else np.isneginf(rough).sum(axis=1))
                if not plain:
                    rough[np.isnan(rough)] = np.inf  # Spark's order has NaN above all
                here = rough.max(axis=1)
                more = np.flatnonzero((here >= rough_top[rows] - off) & (here > -np.inf))
                rough_top[rows] = np.maximum(rough_top[rows], here)
                i, j = tiles.places(rough[more] >= (rough_top[rows][more] - off)[:, None])
                i = more[i] + rows.start
                np.maximum.at(top, i, exact(i, j + columns.start))
            if plain:
                total = (a / na[:, None]) @ (b / nb[:, None]).sum(axis=0)
            else:
                for rows, _, fine in _cosines(a, b, na, nb, np.float64):
                    total[rows] += np.where(np.isneginf(fine), 0.0, fine).sum(axis=1)
        rows = np.flatnonzero(n)
        return some[rows], {"n": pa.array(n[rows]), "top": pa.array(top[rows]), "total": pa.array(total[rows])}

    parts = _met(queries, sources, pool, run, "n long, top double, total double")
    return parts.groupBy(*pool, "id").agg(F.sum("n").alias("n"), F.max("top").alias("greatest"), (F.sum("total") / F.sum("n")).alias("mean"))


def softmax_weights(found: DataFrame, pool: list[str], temperature: float) -> DataFrame:
    """found with weight: softmax of cosine over temperature within each query."""
    w = Window.partitionBy(*pool, "id")
    power = F.exp((F.col("cosine") - F.max("cosine").over(w)) / temperature)
    return found.withColumn("__p", power).withColumn("weight", F.col("__p") / F.sum("__p").over(w)).drop("__p")


def weighted_prediction(found: DataFrame, values: DataFrame, pool: list[str]) -> DataFrame:
    """(pool, id, position, prediction): values (source, position, x) averaged by weight."""
    joined = found.join(values, "source")
    return joined.groupBy(*pool, "id", "position").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("prediction"))


def _with_own(predictions: DataFrame, truths: DataFrame, pool: list[str], value: Column) -> DataFrame:
    """predictions with own, the value of a prediction and its own truth; those without one are left out."""
    pairs = predictions.join(truths.withColumnRenamed("source", "id"), [*pool, "id"])
    own = written(pairs.select(*pool, "id", value.alias("own")).groupBy(*pool, "id").agg(F.max("own").alias("own")).filter("own is not null"))
    return predictions.join(own, [*pool, "id"])


def _beyond(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """x > own as Spark compares: NaN is above all."""
    return (x > own) | (np.isnan(x) & ~np.isnan(own))


def retrieval(predictions: DataFrame, truths: DataFrame, pool: list[str], least: int) -> DataFrame:
    """(pool, id, n, rank, score): average rank of a prediction's own truth by cosine in its pool; score is 1 for the best and 0 for the worst place.

    Rough products count what is clearly better or worse; what is close to the own cosine is scored as vec.cosine does.
    """

    def run(a, b, q, s):
        na, nb, own = _norms(a), _norms(b), q["own"].to_numpy()
        n, better, equal = (np.zeros(len(a), np.int64) for _ in range(3))
        plain, off, exact = _plain(na, nb), tiles.slack(a.shape[1]), _cosine(a, b, na, nb)
        low, high = ((own + x).astype(np.float32)[:, None] for x in (-off, off))
        for rows, columns, rough in _cosines(a, b, na, nb):
            above, below = rough > high[rows], rough < low[rows]
            i, j = tiles.places(above == below)  # neither
            i += rows.start
            n[rows] += rough.shape[1] - (0 if plain else np.isneginf(rough).sum(axis=1))
            c, o = exact(i, j + columns.start), own[i]
            better[rows] += tiles.counted(above)
            better += np.bincount(i[_beyond(c, o)], minlength=len(a))
            equal += np.bincount(i[(c == o) | (np.isnan(c) & np.isnan(o))], minlength=len(a))
        return np.arange(len(a)), {"n": pa.array(n), "better": pa.array(better), "equal": pa.array(equal)}

    parts = _met(_with_own(predictions, truths, pool, vec.cosine(F.col("v"), F.col("w"))), truths, pool, run, "n long, better long, equal long", ("own",))
    out = parts.groupBy(*pool, "id").agg(F.sum("n").alias("n"), (F.sum("better") + (F.sum("equal") + 1) / 2).alias("rank")).filter(F.col("n") >= least)
    return out.withColumn("score", 1 - (F.col("rank") - 1) / (F.col("n") - 1))


def centroid_accuracy(predictions: DataFrame, truths: DataFrame, pool: list[str]) -> DataFrame:
    """(pool, id, accuracy): share of the pool's other truths that are farther from a prediction than its own.

    Squared distances come from products; those that lie close to the own one are taken as vec.rmse does.
    """

    def run(a, b, q, s):
        own, size = q["own"].to_numpy(), a.shape[1]
        codes = pd.factorize(pd.concat([q["id"].to_pandas(), s["id"].to_pandas()], ignore_index=True))[0]
        mine, theirs = codes[: len(a)], codes[len(a) :]
        n = len(b) - np.bincount(theirs, minlength=codes.max() + 1)[mine]
        farther = np.zeros(len(a), np.int64)
        with np.errstate(all="ignore"):
            qa, qb = (a * a).sum(axis=1), (b * b).sum(axis=1)
            finite = qb[np.isfinite(qb)]
            usual, most = (np.median(finite), finite.max()) if finite.any() else (1.0, 0.0)
            usual = usual or most
            half = (qa - own * own * size) / 2 / usual  # what is farther has a product less half its own square below this
            scaled = [x / np.sqrt(usual) for x in (a, b)]
            reach = np.sqrt(qa / usual) * np.sqrt(most / usual) + most / usual + np.abs(half)
            kind = np.float32 if reach[np.isfinite(reach)].max(initial=0.0) < 30 else np.float64  # vectors of very unlike lengths
            off = tiles.slack(size + 1, kind) * reach
            low, high = ((half + x).astype(kind)[:, None] for x in (-off, off))
            both = np.hstack([scaled[0], np.ones((len(a), 1))]), np.hstack([scaled[1], -qb[:, None] / 2 / usual])
        for rows, columns, rough in tiles.products(*both, kind, PRODUCTS):
            with np.errstate(all="ignore"):
                above = rough < low[rows]
                x, y = tiles.places(above == (rough > high[rows]))
            x, y = x + rows.start, y + columns.start
            apart = mine[x] != theirs[y]
            x, y = x[apart], y[apart]
            d = np.sqrt(tiles.paired(a, b, x, y, lambda p, t: (p - t) * (p - t)) / size)
            farther[rows] += tiles.counted(above)
            farther += np.bincount(x[_beyond(d, own[x])], minlength=len(a))
        rows = np.flatnonzero(n)
        return rows, {"n": pa.array(n[rows]), "farther": pa.array(farther[rows])}

    parts = _met(_with_own(predictions, truths, pool, vec.rmse(F.col("v"), F.col("w"))), truths, pool, run, "n long, farther long", ("own",))
    return parts.groupBy(*pool, "id").agg((F.sum("farther") / F.sum("n")).alias("accuracy"))


def projected(long: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, component, x): long (keys, position, x) times weights (component, position, w)."""
    return long.join(weights, "position").groupBy(*keys, "component").agg(F.sum(F.col("x") * F.col("w")).alias("x"))


#: Positions of one block of products.
BLOCK = 512


def position_products(rows: DataFrame, vector: str, size: int) -> DataFrame:
    """(a, b, s): sums over rows of products of entries a and b, for all positions.

    Rows are dealt to tasks once for every block of b; a task adds up the products of all a with its block, and Spark adds up tasks.
    """
    blocks = -(-size // BLOCK)
    spread = rows.select(F.col(vector).alias("v")).filter(F.col("v").isNotNull()).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = spread.repartition("block", F.pmod(F.xxhash64("v"), F.lit(32))) if blocks > 1 else spread

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            block = batch["block"].to_numpy()
            x = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1)
            for k in np.unique(block).tolist():
                mine = x[block == k]
                found = mine.T @ mine[:, k * BLOCK : (k + 1) * BLOCK]
                sums[k] = sums[k] + found if k in sums else found
        for k, found in sums.items():
            a, b = np.indices(found.shape)
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel().astype(np.int32)), pa.array((b + k * BLOCK).ravel().astype(np.int32)), pa.array(found.ravel())], names=["a", "b", "s"])

    return dealt.mapInArrow(run, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s"))


def correlated_positions(rows: DataFrame, vector: str, most: int = 10, least: float = 0.4) -> DataFrame:
    """(a, b, r): for each position b the positions a of the most + 1 greatest |r|, b itself among them, that reach least, and always b.

    Correlations are joins of sums, one row for each pair of positions; no matrix is gathered. Vectors are of one length; a constant
    position has r 0.
    """
    known = rows.filter(F.col(vector).isNotNull())
    facts = known.agg(F.max(F.size(vector)).alias("size"), F.count("*").alias("n")).first()
    if not facts.size:
        return rows.sparkSession.createDataFrame([], "a int, b int, r double")
    n = float(facts.n)
    means = known.select(F.posexplode(vector).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"))
    means = means.groupBy().agg(F.array_sort(F.collect_list(F.struct("p", "m"))).alias("v")).select(F.transform("v", lambda s: s["m"]).alias("__m"))  # one row, a number for each position
    centred = known.join(F.broadcast(means)).select(F.zip_with(vector, "__m", lambda x, m: x - m).alias("v"))
    sums = written(position_products(centred, "v", facts.size))
    own = sums.filter("a = b").select(F.col("a").alias("p"), F.col("s").alias("q"))
    of = lambda c, name: own.select(F.col("p").alias(c), F.col("q").alias(name))
    pairs = sums.join(of("a", "qa"), "a").join(of("b", "qb"), "b")
    size = F.sqrt(F.col("qa") * F.col("qb"))
    r = F.when((F.col("qa") > 1e-24 * n) & (F.col("qb") > 1e-24 * n), F.col("s") / size).otherwise(0.0)
    pairs = pairs.select("a", "b", r.alias("r"))
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.abs("r").desc(), F.col("a").desc()))  # of one target's positions
    return pairs.withColumn("nth", nth).filter((F.col("a") == F.col("b")) | (F.col("nth") <= most + 1) & (F.abs("r") >= least)).select("a", "b", "r")
