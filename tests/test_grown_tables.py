"""Tables as they come when they grow: incomplete last tasks, equal means of rows in another order, draws in parts."""

import hashlib

import numpy as np
import pytest

from veritrail.operators import resampling
from veritrail.plans.registry import ORACLES, QUERIES


def same_as_sql(spark, name, path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for table in path.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    frame = QUERIES[name](spark, str(path))
    rows = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(rows, key=str)
    return rows


def test_families_of_an_incomplete_task(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, draw.normal(size=64).tolist(), k % 10) for k in range(7)], "vec_id long, embedding array<float>, label int")
    rows.toPandas().to_parquet(tmp_path / "embeddings.parquet")
    assert len(same_as_sql(spark, "family_enumeration", tmp_path)) == 6


@pytest.fixture(scope="module")
def reordered(tmp_path_factory, spark):
    """Two users of equal mean errors, whose sums differ in the last digit by the order of their rows."""
    path = tmp_path_factory.mktemp("reordered")
    errors = {1: [0.1, 0.2, 0.3], 2: [0.3, 0.2, 0.1], 3: [0.05], 4: [0.7], 5: [0.9]}
    assert 0.1 + 0.2 + 0.3 != 0.3 + 0.2 + 0.1
    risks = {1: 4, 2: 2, 3: 3, 4: 1, 5: 5}
    rows = [(user, x) for user, values in errors.items() for x in values]
    frame = spark.createDataFrame([(k, user, "view", x, f'{{"k": {risks[user]}}}') for k, (user, x) in enumerate(rows)], "event_id long, user_id long, event_type string, value double, props string")
    frame.coalesce(1).toPandas().to_parquet(path / "events.parquet")
    return str(path), np.corrcoef([4, 2, 3, 1, 5], [2.5, 2.5, 1, 4, 5])[0, 1]


def test_equal_means_tie_in_correlations(spark, reordered):
    path, rho = reordered
    assert abs(QUERIES["gene_macro_spearman"](spark, path).first().rho - rho) < 1e-6


def test_equal_means_tie_in_permutations(spark, reordered):
    path, rho = reordered
    assert abs(QUERIES["permutation_null"](spark, path).first().observed - rho) < 1e-6


@pytest.mark.parametrize("picked, drawn, together", [(1 << 20, 1 << 16, 50), (3, 4, 7)])
def test_draws_are_summed_where_they_are_made(spark, monkeypatch, picked, drawn, together):
    for name, value in (("PICKED", picked), ("DRAWN", drawn), ("TOGETHER", together)):
        monkeypatch.setattr(resampling, name, value)
    values = {g: np.random.default_rng(k).normal(size=11) for k, g in enumerate("ab")}
    df = spark.createDataFrame([(g, c, float(x)) for g, v in values.items() for c, x in enumerate(v)] + [("a", 11, None)], "g string, c long, v double").repartition(3)
    found = resampling.bootstrap_mean(df, ["g"], "c", "v", 40, "s")
    assert "Generate explode(sequence(0, 39" not in found._jdf.queryExecution().optimizedPlan().toString()
    for r in found.collect():
        x = np.append(values[r.g], np.nan) if r.g == "a" else values[r.g]
        pick = lambda k, n=len(x), g=r.g: [int(hashlib.sha256(f"s|{g}|{k}|{j}".encode()).hexdigest()[:8], 16) % n for j in range(n)]
        means = [np.nanmean(x[pick(k)]) for k in range(40)]
        assert np.allclose((r.estimate, r.low, r.high), (np.nanmean(x), *np.quantile(means, [0.025, 0.975])))
