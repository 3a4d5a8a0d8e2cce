"""Modules of positions that move together, as a bank of programs.

Correlations are a table of pairs of the most variable positions (at most most_positions squared rows, whatever the number of vectors),
and so are the edges of all later steps. The driver holds seeds and members, at most a few for each position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrail.operators.programs import ProgramBank, _matrix, _vectors, summed
from veritrail.operators.similarity import position_products
from veritrail.sources.storage import written

#: A seed's correlation with earlier seeds is below this; the least weight of a member, the rest of which grows with its connections.
APART, LEAST_WEIGHT = 0.72, 0.35


def first_independent(edges: DataFrame, nodes: DataFrame) -> list[int]:
    """The nodes (p) that a pass in ascending order takes, where a node with an edge (a < b) from a taken one is passed over.

    Rounds in place of a pass: nodes without an undecided earlier neighbour are taken together, and their later neighbours go.
    """
    taken: list[int] = []
    while True:
        ready = written(nodes.join(edges.select(F.col("b").alias("p")).distinct(), "p", "left_anti"))
        found = [r.p for r in ready.collect()]  # positions, bounded by the caller
        if not found:
            return sorted(taken)
        taken += found
        gone = edges.join(ready, F.col("a") == F.col("p")).select(F.col("b").alias("p")).union(ready)
        nodes = written(nodes.join(gone, "p", "left_anti"))
        for side in ("a", "b"):
            edges = edges.join(nodes, F.col(side) == F.col("p"), "left_semi")
        edges = written(edges)


def _correlations(rows: DataFrame, vector: str, chosen: np.ndarray, mean: np.ndarray, spread: np.ndarray, n: float) -> DataFrame:
    """(a, b, s, r): sums of products of the chosen positions, standardised, and r, their correlation with n - 1 in the denominator, kept within one."""

    def standard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([_vectors((_matrix(batch["v"])[:, chosen] - mean) / spread)], names=["v"])

    z = rows.select(F.col(vector).alias("v")).mapInArrow(standard, "v array<double>")
    products = position_products(z, "v", len(chosen))
    return written(products.withColumn("r", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s") / (n - 1)))))


def _members(claims: list[tuple[int, int]], seeds: int, least: int) -> list[list[int]]:
    """Of each seed the positions it claims that no earlier module has; too few make no module and leave theirs to later ones."""
    used: set[int] = set()
    found: list[list[int]] = [[] for _ in range(seeds)]
    for seed, p in sorted(claims):
        found[seed].append(p)
    for k, claimed in enumerate(found):
        fresh = [p for p in claimed if p not in used]
        found[k] = fresh if len(fresh) >= max(3, least // 2) else []
        used.update(found[k])
    return found


def network_modules(rows: DataFrame, vector: str, n_modules: int = 96, power: int = 6, most_positions: int = 1600, least_members: int = 8, variable_share: float = 0.25) -> tuple[ProgramBank, DataFrame]:
    """A bank of at most n_modules programs of rows' vectors (all of one length, without nulls), and its table
    (program, kind, position, weight, hub).

    Positions are taken in the order of their variance. Seeds are those that correlate little with earlier seeds (if that gives less than
    half, further ones follow); every position joins the seed of its strongest connection, |r| to a power, and small modules take their
    seed and its strongest neighbours too. A member weighs more, the more it is connected within (hub, 1 for the most), with the sign of
    its correlation with the module's mean. What is left of n_modules are single positions of greatest variance, as are all programs
    of less than 4 rows or 16 positions. Equal values stand in the order of positions. An empty table raises.
    """
    spark = rows.sparkSession
    rows = written(rows.select(vector))  # read by every pass
    first = summed(rows, [vector], lambda a: {"n": np.array(float(len(a[0]))), "sum": a[0].sum(axis=0)})
    if not first:
        raise ValueError("no rows to fit modules on")
    n, mean = float(first["n"]), first["sum"] / first["n"]
    variance = summed(rows, [vector], lambda a: {"sq": ((a[0] - mean) ** 2).sum(axis=0)})["sq"] / n
    order = np.argsort(-variance, kind="stable")
    size = len(mean)
    members: list[tuple[int, int, float, float]] = []
    if n >= 4 and size >= 16:
        chosen = order[: min(size, max(32, most_positions))]
        spread = np.sqrt(variance[chosen])
        pairs = _correlations(rows, vector, chosen, mean[chosen], np.where(spread < 1e-8, 1.0, spread), n)
        budget = max(2, round(n_modules * (1 - variable_share)))
        members = _network(pairs, len(chosen), budget, power, least_members, n)
    programs = max((m[0] for m in members), default=-1) + 1
    components = np.zeros((programs + max(0, min(n_modules - programs, size)), size))
    table = []
    for program, at, weight, hub in members:
        components[program, chosen[at]] = weight
        table.append((program, "network_module", int(chosen[at]), weight, hub))
    for program in range(programs, len(components)):
        position = int(order[program - programs])
        components[program, position] = 1.0
        table.append((program, "variable_position", position, 1.0, None))
    components /= np.maximum(np.linalg.norm(components, axis=1, keepdims=True), 1e-8)
    blocks = {"network_module": programs, "variable_position": len(components) - programs}
    return ProgramBank(mean, components, blocks), spark.createDataFrame(table, "program int, kind string, position int, weight double, hub double")


def _network(pairs: DataFrame, size: int, budget: int, power: int, least: int, n: float) -> list[tuple[int, int, float, float]]:
    """(module, place among the chosen positions, weight, hub) of all modules with members."""
    spark = pairs.sparkSession
    near = written(pairs.filter((F.col("a") < F.col("b")) & (F.abs("r") >= APART)).select("a", "b"))
    seeds = first_independent(near, spark.range(size).select(F.col("id").cast("int").alias("p")))[:budget]
    if len(seeds) < max(2, budget // 2):
        seeds = [*seeds, *sorted(set(range(size)) - set(seeds))][:budget]
    numbered = spark.createDataFrame(list(enumerate(seeds)), "seed int, b int")
    link = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.pow(F.abs("r"), power))
    to_seed = written(pairs.join(F.broadcast(numbered), "b").select("a", "b", "seed", link.alias("link")))  # positions times seeds
    best = to_seed.groupBy("a").agg(F.max(F.struct("link", (-F.col("seed")).alias("down"))).alias("x")).filter("x.link > 0")
    joined = best.select((-F.col("x.down")).alias("seed"), F.col("a").alias("p"))
    small = numbered.join(joined.groupBy("seed").agg(F.count("*").alias("n")), "seed", "left").filter(F.coalesce("n", F.lit(0)) < least)
    ranked = to_seed.join(small.select("seed"), "seed").groupBy("seed").agg(F.array_sort(F.collect_list(F.struct((-F.col("link")).alias("down"), "a"))).alias("xs"))
    helpers = ranked.select("seed", F.explode(F.slice("xs", 1, least)).alias("x")).select("seed", F.col("x.a").alias("p"))
    claims = joined.union(helpers).union(small.select("seed", F.col("b").alias("p"))).distinct()
    taken = _members([(r.seed, r.p) for r in claims.collect()], len(seeds), least)  # at most size + seeds * (least + 1)
    kept = [ps for ps in taken if ps][:budget]
    if not kept:
        return []
    placed = spark.createDataFrame([(k, p, p == ps[0]) for k, ps in enumerate(kept) for p in ps], "module int, p int, first boolean")
    a, b = placed.select("module", F.col("p").alias("a")), placed.select(F.col("module").alias("__m"), F.col("p").alias("b"), "first")
    within = pairs.join(F.broadcast(a), "a").join(F.broadcast(b), "b").filter("module = __m").withColumn("link", link)
    facts = within.groupBy("module", "a").agg(F.sum("link").alias("link"), F.sum("s").alias("s"), F.sum(F.when(F.col("first"), F.col("s"))).alias("with_first"))
    out = []
    by_module: dict[int, list] = {}
    for r in facts.collect():  # a row for each member
        by_module.setdefault(r.module, []).append(r)
    for k, found in sorted(by_module.items()):
        found.sort(key=lambda r: r.a)
        most = max(r.link for r in found)
        moves = sum(r.s for r in found) / len(found) ** 2 / n >= 1e-16  # the variance of the members' mean
        for r in found:
            hub = r.link / most if most > 0 else 0.0
            out.append((k, r.a, float(np.sign(r.s if moves else r.with_first)) * (LEAST_WEIGHT + (1 - LEAST_WEIGHT) * hub), hub))
    return out
