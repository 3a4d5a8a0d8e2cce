"""Every registered query with an oracle against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.registry.QUERIES
ORACLES = __spark_entry__.registry.ORACLES


def rows(columns, values):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        return round(float(x), 5) if isinstance(x, float) else int(x) if isinstance(x, bool) else x

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(v[k]) for k in order) for v in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    wanted = duck.execute(ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, wanted.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-5 for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.filter("family_violation or worst_violation or identity_residual > 1e-10").count() == 0 < out.count()
