"""Programs: low-rank bases of many vectors (principal components, non-negative factors, variable positions), and transport in their space.

Rows stay where they are. Each pass sums products of rows with small matrices within tasks; only sums as large as those matrices meet,
added up by Spark, and reach the driver. Nothing of the size of positions times positions is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.functions import vectors as vec
from veritrail.sources.storage import written


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(df: DataFrame, columns: list[str], partial: Callable[[list[np.ndarray]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums over all rows of the arrays that partial makes of a batch's columns (vectors of one length each); empty for no rows.

    A task adds up its batches; Spark adds up the tasks, entry by entry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for name, value in partial([_matrix(batch[c]) for c in columns]).items():
                    total[name] = total[name] + value if name in total else value
        for name, value in total.items():
            shape = ",".join(map(str, value.shape))
            flat = value.ravel().astype(float)
            for k in range(0, len(flat), 50_000):
                part = flat[k : k + 50_000]
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([shape] * n), pa.array(np.arange(k, k + n)), pa.array(part)], names=["name", "shape", "at", "value"])

    parts = df.select(*columns).mapInArrow(run, "name string, shape string, at long, value double")
    found = parts.groupBy("name", "shape", "at").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for (name, shape), rows in found.groupby(["name", "shape"]):
        flat = np.zeros(len(rows))
        flat[rows["at"].to_numpy()] = rows["value"].to_numpy()
        out[name] = flat.reshape([int(x) for x in shape.split(",") if x])
    return out


def _signed(rows: np.ndarray) -> np.ndarray:
    """rows with the sign that makes the entry of greatest size positive."""
    if not rows.size:
        return rows
    at = np.abs(rows).argmax(axis=1)
    return rows * np.where(rows[np.arange(len(rows)), at] < 0, -1.0, 1.0)[:, None]


def principal_components(rows: DataFrame, vector: str, k: int, mean: np.ndarray, tolerance: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """The k leading directions of rows less mean, as rows of a matrix with fixed signs, and the sums of squares along them.

    Block Krylov iteration: each pass multiplies the Gram matrix by a block of k + 8 directions; it ends when the residuals of the k
    leading ones are below tolerance times the greatest, or when the directions span all positions.
    """
    size = len(mean)
    k = min(k, size)
    start = np.random.default_rng(0).normal(size=(size, min(size, k + 8)))
    block = np.linalg.qr(start)[0]
    basis, images = np.zeros((size, 0)), np.zeros((size, 0))
    while True:
        directions = block

        def product(arrays: list[np.ndarray], directions=directions) -> dict[str, np.ndarray]:
            x = arrays[0] - mean
            return {"image": x.T @ (x @ directions)}

        image = summed(rows, [vector], product).get("image", np.zeros_like(directions))
        basis, images = np.hstack([basis, directions]), np.hstack([images, image])
        small = basis.T @ images
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1][:k], turns[:, ::-1][:, :k]
        found = basis @ turns
        left = np.linalg.norm(images @ turns - found * values, axis=0)
        if basis.shape[1] >= size or left.max(initial=0.0) <= tolerance * max(abs(values[0]), 1e-300):
            break
        fresh = image - basis @ (basis.T @ image)
        fresh -= basis @ (basis.T @ fresh)
        left_vectors, sizes, _ = np.linalg.svd(fresh, full_matrices=False)
        block = left_vectors[:, sizes > 1e-12 * max(np.linalg.norm(image), 1e-300)][:, : size - basis.shape[1]]
        if not block.shape[1]:
            break
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    return _signed(found.T), np.maximum(values, 0.0)


def _weights(x: np.ndarray, factors: np.ndarray, sweeps: int) -> np.ndarray:
    """Non-negative weights of the factors for each row of x, by coordinate descent from even weights."""
    cross, gram = x @ factors.T, factors @ factors.T
    w = np.full_like(cross, 1.0 / max(1, len(factors)))
    for _ in range(sweeps):
        for j in range(len(factors)):
            if gram[j, j] > 0:
                w[:, j] = np.maximum(0.0, w[:, j] + (cross[:, j] - w @ gram[:, j]) / gram[j, j])
    return w


def _first_factors(rows: DataFrame, vector: str, prepare, k: int, size: int) -> np.ndarray:
    """Factors from the leading directions: of each the side, positive or negative, that holds more; gaps are filled with the mean."""
    magnitudes = rows.select(F.col(vector))
    zero = np.zeros(size)

    def product(directions):
        return lambda arrays: {"image": prepare(arrays[0]).T @ (prepare(arrays[0]) @ directions)}

    block = np.linalg.qr(np.random.default_rng(0).normal(size=(size, min(size, k + 8))))[0]
    values = zero
    for _ in range(4):  # a start does not need exact directions
        image = summed(magnitudes, [vector], product(block))["image"]
        block, values, _ = np.linalg.svd(image, full_matrices=False)
    directions = _signed(block[:, :k].T)
    sigma = np.sqrt(values[:k])

    def sides(arrays):
        u = prepare(arrays[0]) @ directions.T
        return {"up": (np.maximum(u, 0) ** 2).sum(axis=0), "down": (np.minimum(u, 0) ** 2).sum(axis=0), "total": prepare(arrays[0]).sum(), "n": np.array(float(arrays[0].size))}

    found = summed(magnitudes, [vector], sides)
    up, down = (np.sqrt(found[c]) / np.maximum(sigma, 1e-300) for c in ("up", "down"))
    out = np.zeros((len(directions), size))
    for j, v in enumerate(directions):
        above, below = np.maximum(v, 0), np.maximum(-v, 0)
        more = up[j] * np.linalg.norm(above) >= down[j] * np.linalg.norm(below)
        side, length = (above, up[j]) if more else (below, down[j])
        norm = np.linalg.norm(side)
        out[j] = np.sqrt(sigma[j] * length * norm) * side / max(norm, 1e-300) if j else np.sqrt(sigma[0]) * np.abs(v)
    return np.where(out > 0, out, float(found["total"] / found["n"]))


def nonnegative_factors(rows: DataFrame, vector: str, k: int, mean: np.ndarray, passes: int = 40, tolerance: float = 1e-4, sweeps: int = 30) -> tuple[np.ndarray, list[float]]:
    """k factors of the magnitudes |row - mean|, none negative, and the squared error after each pass.

    Every pass finds the rows' weights for the factors at hand, which stay in the tasks, and sums their products; the factors follow from
    these. It ends when a pass improves the error by less than tolerance of it.
    """
    prepare = lambda x: np.abs(x - mean) + 1e-6
    factors = _first_factors(rows, vector, prepare, min(k, len(mean)), len(mean))
    losses: list[float] = []
    for _ in range(passes):

        def products(arrays: list[np.ndarray], factors=factors) -> dict[str, np.ndarray]:
            x = prepare(arrays[0])
            w = _weights(x, factors, sweeps)
            return {"ww": w.T @ w, "wx": w.T @ x, "loss": ((x - w @ factors) ** 2).sum()}

        found = summed(rows, [vector], products)
        losses.append(float(found["loss"]))
        if len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * losses[-2]:
            break
        factors = factors.copy()
        for _ in range(sweeps):
            for j in range(len(factors)):
                if found["ww"][j, j] > 0:
                    factors[j] = np.maximum(0.0, factors[j] + (found["wx"][j] - found["ww"][j] @ factors) / found["ww"][j, j])
    return factors, losses


@dataclass
class ProgramBank:
    """Rows of components are programs, of length one; blocks says how many each kind gave, in order."""

    mean: np.ndarray
    components: np.ndarray
    blocks: dict[str, int]

    @property
    def kinds(self) -> list[str]:
        return [kind for kind, n in self.blocks.items() for _ in range(n)][: len(self.components)]

    def scores(self, vector: Column) -> Column:
        """A vector less the mean on the programs, as a vector."""
        mean, components = self.mean, self.components

        @F.arrow_udf("array<double>")
        def run(v: pa.Array) -> pa.Array:
            return _vectors((_matrix(v) - mean) @ components.T) if len(v) else pa.array([], pa.list_(pa.float64()))

        return run(vector)

    def restored(self, scores: Column) -> Column:
        """The vector that scores stand for."""
        mean, components = self.mean, self.components

        @F.arrow_udf("array<double>")
        def run(z: pa.Array) -> pa.Array:
            return _vectors(_matrix(z) @ components + mean) if len(z) else pa.array([], pa.list_(pa.float64()))

        return run(scores)


def _vectors(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(len(matrix) + 1) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(matrix.ravel()))


def fit_programs(rows: DataFrame, vector: str, n_programs: int = 64, mode: str = "pca") -> ProgramBank:
    """The bank of rows' vectors, all of one length and without nulls: "pca", "nmf", "hvg", or "combo" of a third of each.

    "pca": leading principal components. "nmf": factors of magnitudes. "hvg": the positions of greatest variance, equal ones in order.
    An empty table raises.
    """
    rows = written(rows.select(vector))  # read by every pass
    first = summed(rows, [vector], lambda a: {"n": np.array(float(len(a[0]))), "sum": a[0].sum(axis=0)})
    if not first:
        raise ValueError("no rows to fit programs on")
    n, mean = float(first["n"]), first["sum"] / first["n"]
    third = max(2, n_programs // 3)
    parts: dict[str, np.ndarray] = {}
    if mode in ("pca", "combo"):
        parts["pca"] = principal_components(rows, vector, min(max(2, n_programs if mode == "pca" else third), int(n)), mean)[0]
    if mode in ("nmf", "combo"):
        parts["nmf"] = nonnegative_factors(rows, vector, min(third, int(n)), mean)[0]
    if mode in ("hvg", "combo"):
        spread = summed(rows, [vector], lambda a: {"sq": ((a[0] - mean) ** 2).sum(axis=0)})["sq"]
        order = np.argsort(-spread, kind="stable")[:third]
        parts["hvg"] = np.eye(len(mean))[order]
    if not parts:
        raise ValueError(f"no such mode: {mode}")
    stacked = np.vstack(list(parts.values()))
    norms = np.linalg.norm(stacked, axis=1, keepdims=True)
    return ProgramBank(mean, (stacked / np.where(norms < 1e-8, 1.0, norms))[:n_programs], {k: len(v) for k, v in parts.items()})


def vector_sums(df: DataFrame, keys: list[str], vector: str, out: str, count: str) -> DataFrame:
    """(keys, out, count): the sum of each key's vectors, position by position, and their number."""
    long = df.select(*keys, F.posexplode(vector).alias("__at", "__x"))
    sums = long.groupBy(*keys, "__at").agg(F.sum("__x").alias("__s"), F.count("*").alias("__n"))
    rows = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__at", "__s"))).alias("__v"), F.max("__n").alias(count))
    return rows.select(*keys, F.transform("__v", lambda s: s["__s"]).alias(out), count)


def hashed_label(label: Column, size: int = 64) -> Column:
    """A label as a vector of that size: the label and its parts between _ + , - are hashed, and pairs of bytes name a place and a sign; its length is one, or zero for an empty label."""
    text = label.cast("string")
    parts = F.filter(F.concat(F.array(text), F.split(text, "[_+,-]")), lambda t: t != "")
    byte = lambda digest, j: F.conv(F.substring(digest, 2 * j + 1, F.lit(2)), 16, 10).cast("int")
    steps = F.sequence(F.lit(0), F.lit(min(32, size) - 1), F.lit(2))
    marks = F.flatten(F.transform(parts, lambda t: vec.let(F.sha2(t, 256), lambda d: F.transform(steps, lambda j: F.struct((byte(d, j) % size).alias("at"), F.when(byte(d, j + 1) % 2 == 1, 1.0).otherwise(-1.0).alias("sign"))))))
    places = F.sequence(F.lit(0), F.lit(size - 1))
    total = vec.let(marks, lambda ms: F.transform(places, lambda i: F.aggregate(ms, F.lit(0.0), lambda s, m: s + F.when(m["at"] == i, m["sign"]).otherwise(0.0))))
    return vec.let(total, lambda v: vec.let(vec.norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))))


@dataclass
class Ridge:
    """Many outputs from many features, both standardised by what they were fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    target_mean: np.ndarray
    coefficients: np.ndarray

    def predicted(self, features: Column) -> Column:
        mean, scale, shift, coefficients = self.mean, self.scale, self.target_mean, self.coefficients

        @F.arrow_udf("array<double>")
        def run(x: pa.Array) -> pa.Array:
            return _vectors((_matrix(x) - mean) / scale @ coefficients + shift) if len(x) else pa.array([], pa.list_(pa.float64()))

        return run(features)


def fit_ridge(rows: DataFrame, features: str, targets: str, penalty: float) -> Ridge:
    """From one pass over rows (two vectors each): means, then products of centred features with themselves and with the targets."""
    first = summed(rows, [features, targets], lambda a: {"n": np.array(float(len(a[0]))), "x": a[0].sum(axis=0), "y": a[1].sum(axis=0)})
    n = first["n"]
    mean, shift = first["x"] / n, first["y"] / n
    second = summed(rows, [features, targets], lambda a: {"xx": (a[0] - mean).T @ (a[0] - mean), "xy": (a[0] - mean).T @ (a[1] - shift)})
    scale = np.sqrt(np.diag(second["xx"]) / n)
    scale = np.where(scale < 1e-6, 1.0, scale)
    gram = second["xx"] / np.outer(scale, scale) + penalty * np.eye(len(scale))
    return Ridge(mean, scale, shift, np.linalg.solve(gram, second["xy"] / scale[:, None]))


def _mean_of(total: Column, n: Column) -> Column:
    return F.transform(total, lambda x: x / n)


def baseline_and_source(tasks: DataFrame) -> DataFrame:
    """tasks (context, perturbation, effect, train, ...) with base, the strong baseline, and source, the mean effect in other contexts.

    Both are means over training tasks. base: 0.85 of the perturbation's mean and 0.15 of the context's, or the first alone where the
    context has none; source: of the same perturbation in other contexts, else in any. Unknown perturbations have the mean of all.
    """
    train = tasks.filter("train")
    by_pert = vector_sums(train, ["perturbation"], "effect", "__p", "__np")
    by_both = vector_sums(train, ["perturbation", "context"], "effect", "__b", "__nb")
    by_context = vector_sums(train, ["context"], "effect", "__c", "__nc")
    whole = vector_sums(train.withColumn("__all", F.lit(0)), ["__all"], "effect", "__g", "__ng").drop("__all")  # one row
    rows = tasks.join(by_pert, "perturbation", "left").join(by_both, ["perturbation", "context"], "left").join(by_context, "context", "left").join(F.broadcast(whole))
    overall, own = _mean_of(F.col("__g"), F.col("__ng")), _mean_of(F.col("__p"), F.col("__np"))
    mean = F.coalesce(own, overall)
    mixed = F.zip_with(mean, _mean_of(F.col("__c"), F.col("__nc")), lambda a, b: 0.85 * a + 0.15 * b)
    others = F.col("__np") - F.coalesce("__nb", F.lit(0))
    rest = F.when(F.col("__b").isNull(), F.col("__p")).otherwise(F.zip_with("__p", "__b", lambda a, b: a - b))
    source = F.coalesce(F.when(others > 0, _mean_of(rest, others)), own, overall)
    return rows.withColumns({"base": F.coalesce(mixed, mean), "source": source}).select(*tasks.columns, "base", "source")


def transported(tasks: DataFrame, n_programs: int = 64, mode: str = "combo", penalty: float = 3.0, hash_size: int = 64, share: float = 0.1) -> DataFrame:
    """tasks (id, context, perturbation, effect, control, train) with base, and prediction: base blended with what ridge carries over in program space.

    Features are the programs' scores of the source effect and of the control, and the hashed labels of perturbation and context;
    targets are the scores of the effect. All is fitted on training tasks.
    """
    rows = written(baseline_and_source(tasks))
    bank = fit_programs(tasks.filter("train"), "effect", n_programs, mode)
    features = F.concat(bank.scores(F.col("source")), bank.scores(F.col("control")), "__hp", "__hc")
    labels = lambda c, out: tasks.select(c).distinct().withColumn(out, hashed_label(F.col(c), hash_size))
    rows = rows.join(labels("perturbation", "__hp"), "perturbation").join(labels("context", "__hc"), "context")
    rows = rows.withColumns({"__x": features, "__y": bank.scores(F.col("effect"))})
    model = fit_ridge(rows.filter("train"), "__x", "__y", penalty)
    carried = bank.restored(model.predicted(F.col("__x")))
    return rows.withColumn("prediction", F.zip_with("base", carried, lambda b, c: (1 - share) * b + share * c)).select(*tasks.columns, "base", "prediction")
