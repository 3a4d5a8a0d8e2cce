import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from veritrail.llm import merkle, queries
from veritrail.llm.shared import Scratch, table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def siblings(levels, at):
    for nodes in levels[:-1]:
        first = at - at % 3
        yield nodes[first:at], nodes[at + 1 : first + 3]
        at //= 3


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(((r[0] is not None, r[0] or 0, leaf(r)), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([leaf(r) for _, r in sorted(groups[s], key=lambda x: x[0])]) for s in names}
    crown = levels_of([trees[s][-1][0] for s in names])
    out = []
    for g, s in enumerate(names):
        for at, (_, r) in enumerate(sorted(groups[s], key=lambda x: x[0])):
            path = [*siblings(trees[s], at), *siblings(crown, g)]
            text = r[4].replace("\n", "") if r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            acc = leaf((*r[:4], text))
            for ahead, behind in path:
                acc = digest(*ahead, acc, *behind)
            out.append((r[0], leaf(r), trees[s][-1][0], crown[-1][0], digest(*(d for a, b in path for d in a + b)), acc, acc == crown[-1][0]))
    return sorted(out, key=str)


def of_query(spark, tmp_path, docs):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got), key=str)


def test_query_equals_plain_trees_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "documents").select(*FIELDS).collect()]
    got = queries.op11_merkle_manifest(spark, sf).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got), key=str) == plain(rows)
    assert 0 < sum(r.verified for r in got) < len(got)


@pytest.mark.parametrize("step", [1, 2])
def test_trees_over_many_blocks_and_groups(spark, tmp_path, monkeypatch, step):
    monkeypatch.setattr(merkle, "STEP", step)
    monkeypatch.setattr(merkle, "BLOCK", 3**step)
    sizes = {None: 1, "": 2, "a": 3, "b": 4, "hot": 83, "é": 9, "z": 28, "Z": 10, "solo": 1}
    rows = [(k * 7 % 1000 + 1000 * g, s, None if k % 5 == 0 else "xx", k, f"line {k}\n" * (k % 3)) for g, (s, n) in enumerate(sizes.items()) for k in range(n)]
    assert of_query(spark, tmp_path, spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_nulls_repeats_long_texts_clashing_columns_and_empty_tables(spark, tmp_path):
    rows = [(5, "a", "x", 3, "same"), (5, "a", "x", 3, "same"), (5, "a", "x", 3, "other\n"), (None, "a", None, None, None), (7, "a", "x", 1, None), (1, None, "x", 0, ""), (2, None, None, None, "a\n" * 2_000_000), (8, "ñ", "x", 2, "\n")]
    docs = spark.createDataFrame(rows, SCHEMA)
    wider = docs.withColumns({c: F.lit("x") for c in ("at", "gid", "digest", "top", "path", "subroot", "n", "id", "group", "block", "__run")})
    assert of_query(spark, tmp_path, wider) == [x for x in plain(rows)]
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert of_query(spark, tmp_path, one) == plain(rows[:1])
    assert of_query(spark, tmp_path, docs.filter("false")) == []


def test_node_store_holds_every_level(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STEP", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = [(k, "s", "x", k, f"t{k}") for k in range(100)]
    with Scratch(spark) as scratch:
        manifest = merkle.build_manifest(spark.createDataFrame(rows, SCHEMA), FIELDS, scratch)
        stored = {(r.level, r.at): r.digest for nodes in manifest.tree.rounds for r in nodes.collect()}
        want = levels_of([leaf(r) for r in rows])
        assert stored == {(k, i): d for k, nodes in enumerate(want) if k for i, d in enumerate(nodes)}
        assert manifest.root == want[-1][0]
        proof = manifest.proofs(scratch).filter("id = 57").select("digest", "path", merkle.folded(F.col("digest"), F.col("path")).alias("root")).first()
        assert proof.root == manifest.root and proof.path.count(";") == len(want) - 1
