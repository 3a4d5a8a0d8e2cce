"""Modules of positions against a plain pass over the whole correlation matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.operators import modules


def frame(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, v array<double>").repartition(3)


def plain(x, n_modules, power, most, least, share):
    n, d = x.shape
    order = sorted(range(d), key=lambda p: (-x[:, p].var(), p))[: max(32, most)]
    z = np.column_stack([(x[:, p] - x[:, p].mean()) / (x[:, p].std() if x[:, p].std() >= 1e-8 else 1) for p in order])
    s = z.T @ z
    r = np.clip(s / (n - 1), -1, 1)
    link = np.abs(r) ** power * (1 - np.eye(len(order)))
    budget = max(2, round(n_modules * (1 - share)))
    seeds = []
    for p in range(len(order)):
        if len(seeds) < budget and all(abs(r[p, q]) < 0.72 for q in seeds):
            seeds.append(p)
    if len(seeds) < max(2, budget // 2):
        seeds = (seeds + [p for p in range(len(order)) if p not in seeds])[:budget]
    home = [max(range(len(seeds)), key=lambda k: (link[p, seeds[k]], -k)) for p in range(len(order))]
    out, used = [], set()
    for k, seed in enumerate(seeds):
        mine = {p for p in range(len(order)) if home[p] == k and link[p, seed] > 0}
        if len(mine) < least:
            mine |= {seed, *sorted(range(len(order)), key=lambda p: (-link[p, seed], p))[:least]}
        mine = sorted(mine - used)
        if len(mine) < max(3, least // 2):
            continue
        used |= set(mine)
        hub = {p: sum(link[p, q] for q in mine) for p in mine}
        most_linked = max(hub.values()) or 1
        out.append({order[p]: np.sign(sum(s[p, q] for q in mine)) * (0.35 + 0.65 * hub[p] / most_linked) for p in mine})
    return out[:budget], order


@pytest.mark.parametrize("d,groups,n_modules,least", [(40, 5, 12, 6), (24, 12, 8, 8), (50, 3, 30, 4)])
def test_modules_equal_a_plain_pass(spark, d, groups, n_modules, least):
    draw = np.random.default_rng(d)
    factors = draw.normal(size=(90, groups))
    x = factors[:, np.arange(d) % groups] * draw.choice([-1.0, 1.0], d) * (1 + np.arange(d) / d) + 0.5 * draw.normal(size=(90, d)) + 3
    x[:, 7] = 2.0  # a position that never moves
    bank, table = modules.network_modules(frame(spark, x), "v", n_modules, least_members=least)
    want, order = plain(x, n_modules, 6, 1600, least, 0.25)
    assert bank.blocks == {"network_module": len(want), "variable_position": n_modules - len(want)}
    got = {}
    for r in table.collect():
        got.setdefault((r.kind, r.program), {})[r.position] = r.weight
    for k, module in enumerate(want):
        found = got["network_module", k]
        assert set(found) == set(module) and all(found[p] == pytest.approx(w, abs=1e-9) for p, w in module.items())
        assert np.allclose(bank.components[k, list(module)] * np.linalg.norm(list(module.values())), list(module.values()))
    assert [list(got["variable_position", k])[0] for k in range(len(want), n_modules)] == order[: n_modules - len(want)]
    assert np.allclose(np.linalg.norm(bank.components, axis=1), 1)
    z = frame(spark, x).select("id", bank.scores(F.col("v")).alias("z")).orderBy("id").collect()
    assert np.allclose([r.z for r in z], (x - x.mean(axis=0)) @ bank.components.T)


def test_few_rows_or_positions_are_single_positions(spark):
    x = np.arange(30.0).reshape(3, 10) ** 2
    bank, table = modules.network_modules(frame(spark, x), "v", 4)
    assert bank.blocks == {"network_module": 0, "variable_position": 4} and [r.position for r in table.orderBy("program").collect()] == [9, 8, 7, 6]
    with pytest.raises(ValueError):
        modules.network_modules(frame(spark, x).filter("false"), "v")


def test_rounds_take_what_a_pass_takes(spark):
    draw = np.random.default_rng(5)
    edges = sorted({(int(a), int(b)) for a, b in draw.integers(0, 60, (150, 2)) if a < b} | {(k, k + 1) for k in range(20)})
    taken = []
    for p in range(60):
        if not any((q, p) in edges for q in taken):
            taken.append(p)
    nodes = spark.range(60).select(F.col("id").cast("int").alias("p"))
    assert modules.first_independent(spark.createDataFrame(edges, "a int, b int"), nodes) == taken
