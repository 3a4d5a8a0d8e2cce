import zlib

import numpy as np

from veritrail.llm import quality
from veritrail.llm.queries import op6_quality_classifier

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scored = op6_quality_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(scored.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in scored.doc_id])
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.5)).all()
    kept = scored[scored.held_out].merge(labels, on="doc_id")
    assert (kept.predicted == kept.quality).mean() > 0.95


def test_pair_tables_learn_what_single_tables_cannot():
    draw = np.random.default_rng(0)
    x = draw.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_model(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "same", "b"), (3, "same", "b"), (None, "é " * 100_000, None)], "doc_id long, text string, quality_score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.quality_score for r in quality.score_quality(docs, quality.fit_quality(docs, none)).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1), (2, None), (2, 1), (2, 0), (3, 7)], "doc_id long, quality int")
    model = quality.fit_quality(docs, nulls)
    assert all(0 <= r.quality_score <= 1 for r in quality.score_quality(docs, model).collect())
    assert quality.score_quality(docs.limit(0), model).count() == 0
    assert quality.features(None) == quality.features(" \n") == [0.0] * len(quality.FEATURES)


def test_scores_are_sums_of_table_entries(spark):
    """The query's scores against a lookup entry by entry in the fitted tables."""
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    model = quality.fit_quality(docs, spark.read.parquet(f"{small}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    bin_of = lambda edges, x: sum(e <= x for e in edges)
    assert model.pairs and len(model.tables) == len(quality.FEATURES)
    for r in op6_quality_classifier(spark, small).collect():
        x = quality.features(texts[r.doc_id])
        margin = model.intercept + sum(t[bin_of(model.edges[f], x[f])] for f, t in enumerate(model.tables))
        margin += sum(t[bin_of(model.pair_edges[a], x[a])][bin_of(model.pair_edges[b], x[b])] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert abs(r.score - 1 / (1 + np.exp(-margin))) < 1e-9
