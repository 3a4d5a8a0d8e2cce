"""Reported tables with planted faults."""

from pyspark.sql import functions as F

from veritrail.operators import audits


def test_every_fault_is_found_once(spark):
    schema = "k string, g int, n long, x double, s string"
    right = [("a", 1, 5, 0.5, "u"), ("b", 1, 5, 0.5, None), ("c", None, 5, float("nan"), "u"), ("d", 1, 1, 1.0, "u"), ("e", 1, 1, 1.0, "u"), ("f", 1, 1, None, "u")]
    told = [("a", 1, 5, 0.5004, "u"), ("b", 1, 6, 0.51, None), ("c", None, 5, float("nan"), "v"), ("d", 1, 1, 1.0, "u"), ("d", 1, 1, 1.0, "u"), ("f", 1, 1, 0.0, "u"), ("g", 2, 0, 0.0, "")]
    frame = lambda rows: spark.createDataFrame(rows, schema).repartition(3)
    got = {tuple(r) for r in audits.discrepancies(frame(right), frame(told), ["k", "g"], ["n", "x", "s"]).collect()}
    assert got == {
        ("b", 1, "differs", "n", "5", "6"),
        ("b", 1, "differs", "x", "0.5", "0.51"),
        ("c", None, "differs", "s", "u", "v"),
        ("d", 1, "repeated", None, "1", "2"),
        ("e", 1, "missing", None, None, None),
        ("f", 1, "differs", "x", None, "0.0"),
        ("g", 2, "extra", None, None, None),
    }
    assert audits.discrepancies(frame(right), frame(right), ["k", "g"], ["n", "x", "s"]).count() == 0
    assert audits.discrepancies(frame([]), frame([]), ["k", "g"], ["n", "x", "s"]).count() == 0


def test_checks_of_certificates(spark):
    schema = "n_members long, diversity_lower double, family_rms_error double, diameter_lower double, worst_member_error double, identity_residual double, family_violation boolean, worst_violation boolean"
    rows = [(4, 1.0, 2.0, 1.0, 3.0, 1e-14, False, False), (4, 2.5, 2.0, 1.0, 3.0, -1e-3, False, False), (3, 1.0, 2.0, 3.5, 3.0, 0.0, False, True), (4, 1.0, 2.0, 1.0, 3.0, 0.0, None, False)]
    got = {r["name"]: r for r in audits.certificate_checks(spark.createDataFrame(rows, schema), 4).collect()}
    assert {k: r.observed for k, r in got.items()} == {"least_members": 3, "most_members": 4, "family_violations": 1, "family_flags_wrong": 2, "worst_violations": 1, "worst_flags_wrong": 0, "identity_residual": 1e-3}
    assert {k for k, r in got.items() if r.passed} == {"most_members", "worst_flags_wrong"}
    none = audits.checks(spark.createDataFrame([], schema), {"rows": (F.count("*"), 0, 0), "least": (F.min("n_members"), 4, 4)}).collect()
    assert [(r.observed, r.passed) for r in none] == [(0, True), (None, False)]
