"""Small-table statistics against known values, neighbours and graph distances against plain Python."""

import math

import numpy as np
from pyspark.sql import functions as F

from veritrail.operators import graphs, similarity, small


def test_exact_intervals_and_tails():
    low, high = small.clopper_pearson(666, 737)
    assert abs(low - 0.8800) < 1e-4 and abs(high - 0.9240) < 1e-4
    assert small.clopper_pearson(0, 10)[0] == 0 and small.clopper_pearson(10, 10)[1] == 1
    assert abs(small.beta_binomial_cdf(16, 20, 18, 2) - 0.186813) < 1e-6
    assert abs(small.fisher_exact(8, 2, 1, 5) - 0.0349650) < 1e-6
    assert abs(small.t_quantile(0.975, 4) - 2.776445) < 1e-5 and abs(small.normal_quantile(0.975) - 1.959964) < 1e-4
    assert small.least_n(0.3) == 85


def test_random_effects(spark):
    equal = small.random_effects(np.array([0.5, 0.5, 0.5]), np.array([0.1, 0.2, 0.1]))
    assert equal["estimate"] == 0.5 and equal["tau2"] == 0 and equal["i2"] == 0
    spread = small.random_effects(np.array([0.1, 0.9, 0.5, 0.2]), np.full(4, 0.05))
    assert spread["tau2"] > 0.05 and spread["low"] < spread["estimate"] < spread["high"] < spread["predict_high"]
    studies = spark.createDataFrame([("a", 0.1, 0.1), ("a", 0.3, 0.1), ("b", 0.2, 0.1), ("a", None, 0.1)], "g string, y double, se double")
    rows = small.meta_analysis(studies, "g", "y", "se").collect()
    assert [(r.g, r.n, round(r.estimate, 9)) for r in rows] == [("a", 2, 0.2)]


def test_distances(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("d", "d"), ("a", "c")], "a string, b string")
    got = {r.node: r.hops for r in graphs.distances(edges, spark.createDataFrame([("a",), ("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_neighbours_and_weights(spark):
    q = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 0.0])], "p int, id int, v array<double>")
    s = spark.createDataFrame([(1, 7, [1.0, 0.0]), (1, 8, [1.0, 1.0]), (1, 9, [-1.0, 0.0]), (2, 5, [1.0, 0.0])], "p int, source int, w array<double>")
    found = similarity.softmax_weights(similarity.neighbours(q, s, ["p"], 2), ["p"], 0.5).orderBy("nth").collect()
    assert [(r.id, r.source, r.nth) for r in found] == [(1, 7, 1), (1, 8, 2)]
    assert abs(found[0].weight - 1 / (1 + math.exp((math.sqrt(0.5) - 1) / 0.5))) < 1e-12
    truths = s.filter("p = 1").withColumn("source", F.col("source") - 6)
    ranked = similarity.retrieval(q.filter("id = 1"), truths, ["p"], 2).first()
    assert (ranked.n, ranked.rank, ranked.score) == (3, 1.0, 1.0)
    assert similarity.centroid_accuracy(q.filter("id = 1"), truths, ["p"]).first().accuracy == 1.0
