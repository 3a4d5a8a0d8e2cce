"""A value that all clusters have is dealt to many runs, and its ranks are those of the whole."""

import numpy as np
from pyspark.sql import functions as F

from veritrail.operators import weighted as wt


def test_equal_values_of_many_clusters_in_several_runs(spark, monkeypatch):
    monkeypatch.setattr(wt, "RUN", 16)
    held, sort = [], wt._sorted

    def watched(*args):
        held.append(sort(*args))
        return held[-1]

    monkeypatch.setattr(wt, "_sorted", watched)
    values = [1.0] * 200 + [0.5, 2.0, 2.0]
    df = spark.createDataFrame([("a", c, x) for c, x in enumerate(values)], "g string, c long, v double")
    rows = wt.slotted(df, ["g"], ["g"], "c")
    got = {r.value: np.array(r.twice) / 2 for r in wt._weighted_ranks(rows, "v", wt.drawn(rows, "x", 6), 6).collect()}
    assert held[0].groupBy("__run").count().agg(F.max("count")).first()[0] <= 4 * wt.RUN
    drawn = wt.draws("x", '["=a"]', len(values), 0, 6)
    for r in range(6):
        w = {v: drawn[[x == v for x in values], r].sum() for v in (0.5, 1.0, 2.0)}
        want = {0.5: (w[0.5] + 1) / 2, 1.0: w[0.5] + (w[1.0] + 1) / 2, 2.0: w[0.5] + w[1.0] + (w[2.0] + 1) / 2}
        assert {v: got[v][r] for v in want} == want
