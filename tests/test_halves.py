from collections import Counter, defaultdict

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from veritrail.operators import resampling
from veritrail.operators.resampling import halves
from veritrail.plans.study_queries import split_half_reproducibility
from veritrail.sources import views


def test_halves_are_balanced_and_repeat(spark):
    rows = [("a", k % 37) for k in range(100)] + [("b", k) for k in range(8)] + [("c", 1)]
    df = spark.createDataFrame(rows, "stratum string, unit int")
    got = [tuple(r) for r in halves(df, ["stratum"], "unit", 3, "s").collect()]
    count, sides = Counter((s, r, h) for s, _, r, h in got), defaultdict(set)
    assert len(got) == 3 * (37 + 8 + 1) and len({x[:3] for x in got}) == len(got)
    for r in range(3):
        assert {count["a", r, 0], count["a", r, 1]} == {18, 19} and count["b", r, 0] == count["b", r, 1] == 4
    for s, u, r, h in got:
        sides[r].add((s, u, h))
    assert sides[0] != sides[1] != sides[2]
    assert sorted(got) == sorted(tuple(r) for r in halves(df.repartition(5), ["stratum"], "unit", 3, "s").collect())
    assert halves(df.limit(0), ["stratum"], "unit", 3, "s").count() == 0


@pytest.mark.parametrize("bucket, task", [(1 << 14, 1 << 19), (3, 4)])
def test_half_sums_are_those_of_the_masks(spark, monkeypatch, bucket, task):
    monkeypatch.setattr(resampling, "HALF_BUCKET", bucket)
    monkeypatch.setattr(resampling, "HALF_TASK", task)
    rows = [(c, b, f"u{k}", "AB"[g], float(k + g)) for c, b, n in (("x", "1", 37), ("x", "2", 8), ("y", "1", 1)) for k in range(n) for g in range(1 + k % 2)]
    rows += [("x", None, "u1", "A", 9.0), ("y", "1", "u7", None, 5.0)]
    df = spark.createDataFrame(rows, "c string, b string, u string, g string, x double").repartition(3)
    masks = {(r.c, r.b, r.u): r.mask for r in resampling.half_masks(df, ["c", "b"], "u", 20, "s").collect()}
    units, n_left, s_left = Counter(), Counter(), Counter()
    for c, b, u in {r[:3] for r in rows if r[1]}:
        units[c] += 1
        n_left.update((c, r) for r in range(20) if masks[c, b, u] >> r & 1)
    for c, b, u, g, x in rows:
        if b:
            s_left.update({(c, g, r): x for r in range(20) if masks[c, b, u] >> r & 1})
    sizes, sums = resampling.half_sums(df, ["c"], ["b"], "u", "g", "x", 20, "s")
    assert {r.c: (r.n, r.n_left) for r in sizes.collect()} == {c: (n, [n_left[c, r] for r in range(20)]) for c, n in units.items()}
    assert {(r.c, r.g): (r.s, r.s_left) for r in sums.collect()} == {(c, g): (sum(r[4] for r in rows if r[1] and r[0] == c and r[3] == g), [s_left[c, g, r] for r in range(20)]) for c, g in ("xA", "xB", "yA")}


def test_halves_never_write_several_rows_for_a_cell(spark, monkeypatch):
    sf, most, write = "/root/testdata/sf0.001", [], DataFrameWriter.parquet

    def counted(self, path, *args, **kwargs):
        write(self, path, *args, **kwargs)
        most.append(spark.read.parquet(path).count())

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    split_half_reproducibility(spark, sf).count()
    assert max(most) <= views.cells(spark, sf).select(F.lit(1)).count()
