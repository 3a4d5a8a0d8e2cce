import random
import re

import pytest

from veritrail.llm.secrets import BASE_RULES, RULES, Automaton, Rule, joined, redact_secrets, scan_secrets

#: kind: (regex, characters needed, in which group)
PLAIN = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    "access": ("AKIA[A-Z0-9]+", 20, 0),
    "hex": ("[0-9a-f]+", 24, 0),
}
PARTS = ["token", "TOKEN", "password", "passwd", "secret", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "A", "B9", "abc", "0123456789abcdef", "é", "-", "Z", "\n", "f" * 9, "AKIA" + "X" * 15, "a1b2c3d4e5f6", "token=", "pass", "😀"]


def plain(text):
    found = []
    for j, (regex, least, group) in enumerate(PLAIN.values()):
        found += [(m.start(), j, m.end()) for m in re.finditer(regex, text, re.ASCII) if len(m.group(group)) >= least]
    return [(list(PLAIN)[j], s, e) for s, j, e in sorted(found)]


def test_base_spans_equal_plain_regexes():
    base, full = Automaton(BASE_RULES), Automaton(RULES)
    pick = random.Random(3)
    for _ in range(4000):
        text = "".join(pick.choice(PARTS) for _ in range(pick.randint(0, 14)))
        assert base.scan(text) == plain(text)
        assert [x for x in full.scan(text) if x[0] in PLAIN] == plain(text)


def test_consumed_text_starts_no_match():
    assert Automaton(BASE_RULES).scan("token=token: abcdef") == []
    assert Automaton(BASE_RULES).scan("token=password: abcdef token=abcdef") == [("assign", 0, 14), ("assign", 23, 35)]


def test_more_kinds_and_long_text():
    full = Automaton(RULES)
    assert full.scan("-----BEGIN RSA PRIVATE KEY-----")[0] == ("pem", 0, 31)
    assert full.scan("x ghp_" + "Zq9" * 12)[0] == ("vcs", 2, 42)
    text = "word " * 200_000 + "token=" + "z" * 50_000
    assert full.scan(text) == [("assign", 1_000_000, 1_050_006)]


def test_rules_outside_the_subset_are_refused():
    with pytest.raises(ValueError):
        Automaton((Rule("x", r"a(?=b)"),))
    with pytest.raises(ValueError):
        Automaton((Rule("x", r"a*"),))


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "é token=abcdef1", "z"), (2, "é token=abcdef1", "z"), (None, "no", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, secret_spans string")
    out = scan_secrets(docs)
    assert out.columns == docs.columns and out.count() == 5
    got = sorted(r[0] for r in out.select(joined(out.secret_spans)).collect())
    assert got == ["", "", "", "assign:2:15", "assign:2:15"]
    assert sorted(str(r.text) for r in redact_secrets(docs).collect()) == ["", "None", "no", "é [secret]", "é [secret]"]
    assert scan_secrets(docs.limit(0)).count() == 0


def test_query_equals_plain_regexes_of_all_kinds(spark, tmp_path):
    """Counts, base_sha256 and the spans of every kind, over whole texts with secrets of each kind put in."""
    import hashlib

    from veritrail.llm.queries import op1_secret_scan
    from veritrail.llm.shared import table

    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    pick = random.Random(7)
    parts = [*PARTS, "-----BEGIN EC PRIVATE KEY-----", "eyJ" + "a9" * 12 + ".eyJ" + "b_" * 9 + ".sig-", "ghp_" + "Zq9" * 13, "AIza" + "x-Y" * 13, "AIza"]
    made = [(10_000 + k, "".join(pick.choice(parts) for _ in range(pick.randint(1, 30)))) for k in range(300)] + [(20_000, None), (20_001, "ı" * 9 + "TOKEN=ſecretK")]
    rows = [tuple(r) for r in docs.collect()] + made
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op1_secret_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    kinds = [r.kind for r in RULES]
    seen = set()
    for doc_id, text in rows:
        found = []
        for j, rule in enumerate(RULES):
            regex, least, group = PLAIN.get(rule.kind, (rule.regex, rule.least, 0))
            found += [(m.start(), j, m.end()) for m in re.finditer(regex, text or "", re.ASCII) if len(m.group(group)) >= least]
        as_text = lambda of: ",".join(f"{kinds[j]}:{s}:{e}" for s, j, e in sorted(of))
        r = got[doc_id]
        assert r.spans == as_text(found)
        assert r.base_sha256 == hashlib.sha256(as_text([x for x in found if x[1] < 3]).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(j == k for _, j, _ in found) for k in range(3))
        seen |= {j for _, j, _ in found}
    assert seen == set(range(len(RULES)))
