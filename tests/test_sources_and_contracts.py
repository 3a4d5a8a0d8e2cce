"""Readers, writers, manifests, contracts, and the queries SQL cannot state, by values."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from veritrail.functions import scalars
from veritrail.operators import contracts, linear, similarity
from veritrail.sources import files, views

SF = "/root/testdata/sf0.001"


def test_typed_text_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("name\tn\tx\nNA\t1\t0.5\n\t2\t1e3\n")
    schema = T.StructType().add("name", T.StringType()).add("n", T.IntegerType()).add("x", T.DoubleType())
    rows = files.read_csv(spark, f"{tmp_path}/t.tsv", schema, "\t").collect()
    assert [tuple(r) for r in rows] == [("NA", 1, 0.5), ("", 2, 1000.0)]
    with pytest.raises(Exception, match="(?i)header|column"):
        files.read_csv(spark, f"{tmp_path}/t.tsv", T.StructType().add("other", T.StringType()).add("n", T.IntegerType()).add("x", T.DoubleType()), "\t").collect()


def test_vectors_are_checked(spark, tmp_path):
    good = [("a", [1.0, 2.0]), ("b", [0.0, -1.0])]
    spark.createDataFrame(good, "key string, v array<double>").write.parquet(f"{tmp_path}/good")
    assert files.read_vectors(spark, f"{tmp_path}/good", 2).count() == 2
    for k, bad in enumerate(([1.0], None, [1.0, None], [1.0, math.nan], [math.inf, 1.0])):
        spark.createDataFrame([*good, ("z", bad)], "key string, v array<double>").write.parquet(f"{tmp_path}/bad{k}")
        with pytest.raises(SparkRuntimeException, match="bad vector z"):
            files.read_vectors(spark, f"{tmp_path}/bad{k}", 2).collect()


def test_releases_and_manifests(spark, tmp_path):
    at = f"{tmp_path}/release"
    files.write_release(spark.createDataFrame([(1, "x"), (2, "y")], "n int, p string"), at, ["p"])
    assert spark.read.parquet(at).count() == 2
    with pytest.raises(AnalysisException):
        files.write_release(spark.createDataFrame([(3, "x")], "n int, p string"), at)
    (tmp_path / "m").mkdir()
    for name in ("a", "b", "c"):
        (tmp_path / "m" / name).write_text(name * 3)
    then = files.manifest(spark, f"{tmp_path}/m")
    rows = {r.path.rsplit("/", 1)[1]: r for r in then.collect()}
    assert {k: (r.bytes, r.sha256) for k, r in rows.items()} == {k: (3, hashlib.sha256((k * 3).encode()).hexdigest()) for k in "abc"}
    then = spark.createDataFrame(then.collect(), then.schema)
    (tmp_path / "m" / "a").write_text("new")
    (tmp_path / "m" / "b").unlink()
    (tmp_path / "m" / "d").write_text("d")
    changes = {r.path.rsplit("/", 1)[1]: r.change for r in files.changed_files(files.manifest(spark, f"{tmp_path}/m"), then).collect()}
    assert changes == {"a": "changed", "b": "removed", "d": "added"}


def test_written_tables_are_deleted_on_request(spark, tmp_path, monkeypatch):
    from veritrail.sources import storage

    monkeypatch.setattr(storage, "_LEFT", [])
    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    with storage.Scratch(spark) as scratch:
        inner = scratch.written(spark.range(5))
        outer = storage.written(inner)
        assert inner.count() == outer.count() == 5 and len(list(tmp_path.iterdir())) == 2
    assert outer.count() == 5 and len(list(tmp_path.iterdir())) == 1
    storage.delete_left(spark)
    assert not list(tmp_path.iterdir())


def test_joins_are_validated(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), ("c", 30)], "k string, y int")
    assert sorted(tuple(r) for r in contracts.validated_join(left, right, ["k"], unique="right").collect()) == [("a", 1, 10), ("a", 2, 10)]
    for a, b, unique in ((left, right, "both"), (left, right, "left"), (right, left, "right")):
        with pytest.raises(SparkRuntimeException, match="a key repeats"):
            contracts.validated_join(a, b, ["k"], unique=unique).collect()


def test_guards(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "f int, true_error_rmse double, normalized_rmse double")
    assert contracts.without_truth(df).columns == ["f"] and contracts.without_truth(df, ("normalized_rmse",)).columns == ["f", "normalized_rmse"]
    contracts.assert_no_labels(["f"])
    with pytest.raises(ValueError, match="true_error_rmse"):
        contracts.assert_no_labels(["f", "true_error_rmse"])
    row = contracts.with_defaults(df, {"f": 9, "g": "x"}).first()
    assert row.f == 1 and row.g == "x"
    numbers = spark.createDataFrame([("1.5",), ("x",), ("inf",), (None,), ("nan",)], "t string").select(scalars.numeric(F.col("t")).alias("n")).collect()
    assert [r.n for r in numbers] == [1.5, None, None, None, None]
    truth = spark.createDataFrame([("yes",), ("FALSE",), ("0",)], "t string").select(contracts.strict_boolean(F.col("t")).alias("b")).collect()
    assert [r.b for r in truth] == [True, False, False]
    with pytest.raises(SparkRuntimeException, match="no boolean"):
        spark.createDataFrame([("maybe",)], "t string").select(contracts.strict_boolean(F.col("t"))).collect()


def test_products_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    x = np.random.default_rng(0).normal(size=(40, 8)) @ np.random.default_rng(1).normal(size=(8, 8))
    x[:, 5] = 2.0
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "v array<double>").repartition(3)
    got = {(r.a, r.b): r.r for r in similarity.correlated_positions(df, "v", 8, 0.0).collect()}
    with np.errstate(all="ignore"):
        want = np.nan_to_num(np.corrcoef(x.T))
    assert len(got) == 64 and all(abs(r - want[a, b]) < 1e-9 for (a, b), r in got.items())
    assert similarity.correlated_positions(df.filter("v is null"), "v").count() == 0


def of(spark, name):
    return __spark_entry__.registry.QUERIES[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def ev(spark):
    return views.splits(views.scored_events(spark, SF), "event_id").toPandas()


def test_simplex_weights_minimise_the_error(spark, ev):
    rows = ev.dropna(subset=["risk", "error"])
    a, b, y = rows.risk / 100, rows.cluster / 150, rows.error / 500
    loss = [((w * a + (1 - w) * b - y) ** 2).sum() for w in np.linspace(0, 1, 10_001)]
    got = of(spark, "simplex_stacking").set_index("score").weight
    assert got["risk"] == pytest.approx(np.argmin(loss) / 10_000, abs=1.1e-4) and got.sum() == pytest.approx(1)
    z = np.random.default_rng(0).random((60, 3))
    df = spark.createDataFrame([tuple(map(float, (*r, 0.7 * r[0] + 0.3 * r[2]))) for r in z], "a double, b double, c double, y double")
    assert np.allclose(linear.simplex_weights(df, ["a", "b", "c"], "y"), [0.7, 0.0, 0.3], atol=1e-6)


def test_isotonic_calibration_equals_pooling(spark, ev):
    got = of(spark, "isotonic_crossfit").set_index("event_id")
    rows = ev.dropna(subset=["risk", "error"]).set_index("event_id")
    fold = got.fold.reindex(rows.index)
    for k in range(3):
        train = rows[fold != k].groupby("risk").error.agg(["mean", "count"]).sort_index()
        blocks = []
        for x, (m, n) in zip(train.index, train.to_numpy()):
            blocks.append([m, n, [x]])
            while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
                m2, n2, x2 = blocks.pop()
                blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m2 * n2) / (blocks[-1][1] + n2), blocks[-1][1] + n2, blocks[-1][2] + x2]
        xs, ys = [x for _, _, xs in blocks for x in xs], [m for m, _, xs in blocks for _ in xs]
        mine = rows[fold == k]
        assert np.allclose(got.expected_error.reindex(mine.index), np.interp(mine.risk, xs, ys), atol=1e-6)


def test_error_ranker_scores_test_rows_better_than_it_must(spark, ev):
    got = of(spark, "error_ranker_ml").set_index("event_id").expected_error
    rows = ev.dropna(subset=["risk", "error"]).set_index("event_id")
    test, train = rows[rows.split == "test"], rows[rows.split != "test"]
    assert set(got.index) == set(test.index)
    assert train.error.min() <= got.min() and got.max() <= train.error.max() and got.nunique() > 1
    assert ((got - test.error) ** 2).mean() <= 1.3 * ((train.error.mean() - test.error) ** 2).mean()


def test_intervals_of_coverage(spark, ev):
    means = ev.groupby(["dataset", "cluster"]).error.mean()
    ok = (means <= 50).groupby("dataset").agg(["sum", "count"])
    got = of(spark, "coverage_intervals").set_index("dataset")
    assert (got.k == ok["sum"].reindex(got.index)).all() and (got.n == ok["count"].reindex(got.index)).all()

    def tail(k, n, p):  # chance of k or more
        return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))

    for r in got.itertuples():
        if r.k > 0:
            assert tail(r.k, r.n, r.low) == pytest.approx(0.025, abs=1e-6)
        if r.k < r.n:
            assert 1 - tail(r.k + 1, r.n, r.high) == pytest.approx(0.025, abs=1e-6)
        a, b = r.k, r.n - r.k
        c, e = int(got.k.sum()) - a, int(got.n.sum()) - int(got.k.sum()) - b
        of_table = lambda x: math.comb(a + b, x) * math.comb(c + e, a + c - x)  # noqa: E731, B023
        every = [of_table(x) for x in range(max(0, a + c - (c + e)), min(a + b, a + c) + 1)]
        assert r.p_fisher == pytest.approx(sum(x for x in every if x <= of_table(a) * (1 + 1e-7)) / sum(every), abs=1e-9)


def test_meta_analysis_of_every_data_set(spark, ev):
    got = of(spark, "random_effects_meta").set_index("dataset")
    ev = ev.assign(study=ev.cluster % 8)
    for d, rows in ev.groupby("dataset"):
        s = rows.groupby("study").error.agg(["mean", "std", "count"]).dropna()
        y, v = s["mean"].to_numpy(), (s["std"] ** 2 / s["count"]).to_numpy()
        w = 1 / v
        q = (w * (y - (w * y).sum() / w.sum()) ** 2).sum()
        assert got.loc[d].n == len(s) and got.loc[d].q == pytest.approx(q) and got.loc[d].i2 == pytest.approx(max(0, (q - len(s) + 1) / q))
        t = got.loc[d].tau2
        loss = lambda t: np.log(v + t).sum() + np.log((1 / (v + t)).sum()) + ((y - (y / (v + t)).sum() / (1 / (v + t)).sum()) ** 2 / (v + t)).sum()  # noqa: E731, B023
        assert loss(t) <= min(loss(x) for x in np.linspace(0, 4 * v.max() + 4 * y.var(), 2001)) + 1e-6
        assert got.loc[d].estimate == pytest.approx((y / (v + t)).sum() / (1 / (v + t)).sum())
    assert isinstance(got, pd.DataFrame)
