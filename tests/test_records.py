"""Ontologies, record joins, samples and similar names against plain Python."""

import hashlib
import random

import pytest
from pyspark.errors import SparkRuntimeException

from veritrail.operators import records


def line(name, flag="true"):
    return f"{name},fam,rna,gene,{flag},false,no,ok,done,why\n"


def test_ontology_is_checked(spark, tmp_path):
    head = ",".join(records.ONTOLOGY) + "\n"
    (tmp_path / "good.csv").write_text(head + line(" A ") + line("B", "0"))
    rows = {r.dataset_name: r for r in records.read_ontology(spark, f"{tmp_path}/good.csv").collect()}
    assert rows["A"][records.FLAGS[0]] is True and rows["B"][records.FLAGS[0]] is False and rows["B"].source_modality == "rna"
    for k, bad in enumerate((line("A") + line("A "), line(" "), line("A", "maybe"))):
        (tmp_path / f"bad{k}.csv").write_text(head + bad)
        with pytest.raises(SparkRuntimeException):
            records.read_ontology(spark, f"{tmp_path}/bad{k}.csv")


def test_records_meet_their_features_once(spark):
    rec = spark.createDataFrame([("d1", 1, 0.5), ("d1", 1, 0.7), ("d2", 2, 0.1)], "d string, k int, e double")
    feat = spark.createDataFrame([("d1", 1, 9.0)], "d string, k int, f double")
    fam = spark.createDataFrame([("d1", "x")], "d string, family string")
    got = sorted((r.d, r.e, r.f, r.dataset_family) for r in records.merged_records(rec, feat, fam, ["d", "k"], "d").collect())
    assert got == [("d1", 0.5, 9.0, "x"), ("d1", 0.7, 9.0, "x"), ("d2", 0.1, None, "other")]
    with pytest.raises(SparkRuntimeException, match="a key repeats"):
        records.merged_records(rec, feat.unionByName(feat), fam, ["d", "k"], "d").collect()
    with pytest.raises(ValueError, match="e"):
        records.merged_records(rec, rec, None, ["d", "k"], "d")


def test_samples_do_not_depend_on_storage(spark):
    rows = [("hot" if k % 3 else "small" if k < 9 else None, k) for k in range(900)]
    df = spark.createDataFrame(rows, "c string, k int")
    want = {}
    for c in {c for c, _ in rows}:
        mine = [k for d, k in rows if d == c]
        want[c] = sorted(sorted(mine, key=lambda k: hashlib.sha256(f"s|{k}".encode()).hexdigest())[:20])
    for parts in (1, 6):
        got = records.sampled_tasks(df.repartition(parts), ["c"], "k", 20, "s").collect()
        assert {c: sorted(r.k for r in got if r.c == c) for c in want} == want
    assert "WindowGroupLimit" in records.sampled_tasks(df, ["c"], "k", 20, "s")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("least", [0.2, 0.5, 0.9])
def test_similar_texts_equal_all_pairs(spark, least):
    draw = random.Random(1)
    texts = ["".join(draw.choice("abc") for _ in range(draw.randint(0, 9))) for _ in range(120)] + ["CCO", "CCO", "CC", None, ""]
    grams = {t: {t[i : i + 3] for i in range(max(1, len(t) - 2))} for t in texts if t}
    want = {}
    for a in grams:
        for b in grams:
            j = len(grams[a] & grams[b]) / len(grams[a] | grams[b])
            if a < b and j >= least:
                want[a, b] = j
    got = {(r.a, r.b): r.jaccard for r in records.similar_texts(spark.createDataFrame([(t,) for t in texts], "t string"), "t", least).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items()) and (want or least > 0.8)
