import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import hard_negatives as hn
from veritrail.llm import queries
from veritrail.llm.shared import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """Of each anchor row its positives, and their negatives, by scoring all pairs in Python's integers."""
    kept = []
    for vec_id, v, label in rows:
        if vec_id is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, mine, q in kept:
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(q, r)), b, label) for b, label, r in kept if b != a]
        for minus, b, _ in sorted(x for x in scored if x[2] == mine)[:5]:
            fits = sorted(x for x in scored if x[2] != mine and -50 * minus <= -100 * x[0] <= -95 * minus)
            out += [(a, b, k + 1, c, -minus, -s) for k, (s, c, _) in enumerate(fits[:3])]
    return sorted(out)


def of_query(spark, tmp_path, docs):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in queries.op13_hard_negatives(spark, str(tmp_path)).collect())


def clustered(seed, n=600, size=16):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 1) for _ in range(size)] for _ in range(8)]
    return [(k, [x + draw.gauss(0, 0.2) for x in draw.choice(centres)], draw.randrange(10) if k % 3 else 0) for k in range(n)]


@pytest.mark.parametrize("rows_at_once,anchors", [(1024, 2048), (64, 5)])
def test_query_equals_all_pairs(spark, tmp_path, monkeypatch, rows_at_once, anchors):
    monkeypatch.setattr(hn, "ROWS", rows_at_once)
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    rows = clustered(1)
    got = of_query(spark, tmp_path, spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got == plain(rows) and len(got) > 20


def test_nulls_ties_repeats_lengths_negative_scores_and_clashing_columns(spark, tmp_path):
    base = clustered(2, n=200, size=6)
    rows = [*base, (None, [1.0] * 6, 1), (1000, None, 1), (1001, [0.5] * 6, None), (1002, [float("nan")] * 6, 0), (1003, [float("inf")] * 6, 0), (1004, [None, 1.0], 0), (1050, [], 3), (1100, [0.5, 0.5], 0)]
    rows += [(2000 + k, base[50][1], k % 10) for k in range(40)] + [base[50], base[51], base[100]]
    rows += [(3000 + k, [-x for x in base[0][1]], base[0][2]) for k in range(3)] + [(5000, [0.0] * 6, 4), (5001, [0.0] * 6, 4), (5002, [0.0] * 6, 5)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "q", "dist", "cell", "near", "slot", "score", "nth", "at", "all")})
    assert of_query(spark, tmp_path, docs) == plain([(a, None if v is None else [*v, *[0.0] * (6 - len(v))], b) for a, v, b in rows])
    assert of_query(spark, tmp_path, docs.filter("false")) == [] and of_query(spark, tmp_path, docs.filter("vec_id = 3")) == []


def test_large_numbers_are_scored_exactly(spark):
    draw = random.Random(4)
    rows = [(k, [draw.uniform(-1, 1) for _ in range(3)], k % 2) for k in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    q = hn.quantised(frame, "vec_id", "embedding", F.col("label"), scale=2.0**30)
    got = {(r.anchor_id, r.positive_id): r.positive_score for r in hn.mine(q, F.col("id") % 50 == 0).collect()}
    exact = {k: [math.floor(x * 2.0**30) for x in v] for k, v, _ in rows}
    assert got and all(s == sum(x * y for x, y in zip(exact[a], exact[b])) for (a, b), s in got.items())
    assert hn.quantised(spark.createDataFrame([(1, [1e30], 1), (2, [1.0], 1)], "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", F.col("label")).count() == 1


def test_brackets_hold_and_leave_rows_out(spark, monkeypatch):
    """Every score lies within its bracket, and where vectors lie in clusters most rows need no score."""
    rows = clustered(3, n=3000)
    q = hn.quantised(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", F.col("label"))
    with Scratch(spark) as scratch:
        table, pivots, most = hn.pivot_table(q, scratch)
        held = table.toArrow().combine_chunks().to_batches()[0]
        anchors = [r for r in table.collect() if r.id % 100 == 0]
        search = hn.Search(anchors, pivots, most, {"anchor": np.arange(len(anchors)), "low": np.full(len(anchors), -(2**62)), "high": np.full(len(anchors), 2**62)}, 5, True)
        dist, vectors = hn._matrix(held["dist"], float), hn._matrix(held["q"], np.int64)
        every, scores = np.arange(len(anchors))[:, None], search.q @ vectors.T
        least = np.abs(search.dist[:, None, :] - dist[None]).max(axis=2)
        reach = (search.dist[:, None, :] + dist[None]).min(axis=2)
        assert (search._upper(every, least) >= scores).all() and (search._lower(every, reach) <= scores).all()
        fifth = np.sort(scores, axis=1)[:, -5]
        assert (search._upper(every, least) >= fifth[:, None]).mean() < 0.5
        found = defaultdict(list)
        for batch in search.found(iter([held])):
            for slot, score in zip(batch["slot"].to_pylist(), batch["score"].to_pylist()):
                found[slot].append(score)
        labels = held["label"].to_numpy()
        for k, a in enumerate(anchors):
            mine = scores[k][(labels == a.label) & (held["id"].to_numpy() != a.id)]
            assert sorted(found[k]) == sorted(mine)[-5:]
