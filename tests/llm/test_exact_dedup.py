import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from veritrail.llm import exact_dedup, queries
from veritrail.llm.shared import Scratch, table

SCHEMA = "doc_id long, text string"


def plain(rows):
    groups, out = defaultdict(list), []
    norm = [re.sub("[\x20\x09-\x0d]", "", text or "") for _, text in rows]
    for k, (doc_id, text) in enumerate(rows):
        groups[norm[k]].append((-len(text or ""), doc_id is None, doc_id or 0, k))
    for k, (doc_id, _) in enumerate(rows):
        best = min(groups[norm[k]])
        out.append((doc_id, rows[best[3]][0], len(groups[norm[k]]), hashlib.sha256(norm[k].encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_equal_plain_ones_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = queries.op12_exact_dedup(spark, sf).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_copies_blanks_nulls_ties_repeats_and_clashing_columns(spark):
    long = "palabra " * 300_000
    rows = [(1, "a b"), (2, "a  b\n"), (3, "ab"), (9, "a\x0bb\r\f"), (4, None), (5, ""), (6, " \t"), (7, "ä b"), (7, "ä b"), (8, long), (10, long[:-1]), (None, "solo"), (None, "ab   "), (11, " x"), (12, "x"), (13, "solo")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "key", "digest", "bucket", "keep_id", "norm", "id")})
    got = exact_dedup.exact_copies(docs, capacity=2).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len({r.text_sha256 for r in got})  # one stays, of repeated rows too
    assert exact_dedup.exact_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_of_one_key_and_digest_are_told_apart_by_their_bytes(spark):
    rows = [(k, f"{random.Random(k).choice('abcdef')} {k % 5} ") for k in range(400)]
    weak = lambda text: F.substring(text, 1, 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    for digest in (weak, None):
        got = exact_dedup.exact_copies(docs, capacity=3, key=lambda t: F.length(t).cast("long") - 1, digest=digest).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == [x[:3] for x in plain(rows)]


def test_the_directory_doubles_until_buckets_fit(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key")).unionByName(spark.range(300).select(F.lit(-1).cast("long").alias("key")))
    slots, bits = exact_dedup.directory(keys, capacity=100)
    rows = slots.collect()
    loads = defaultdict(int)
    for r in keys.select(F.shiftrightunsigned("key", 64 - bits).alias("slot")).collect():
        loads[next(x.bucket for x in rows if x.slot == r.slot)] += 1
    depth = {r.bucket: r.depth for r in rows}
    assert sum(loads.values()) == 5300 and len({r.slot for r in rows}) == len(rows)
    assert all(n <= 100 or depth[b] == bits for b, n in loads.items()) and min(depth.values()) < bits
    for r in rows:  # a bucket is what shares its leading bits, and its parent was overfull
        assert r.bucket == r.slot >> (bits - r.depth) << (bits - r.depth)
        assert sum(n for b, n in loads.items() if b >> (bits - r.depth + 1) == r.slot >> (bits - r.depth + 1)) > 100


def test_chains_and_probes_of_new_texts(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], SCHEMA)
    with Scratch(spark) as scratch:
        rows = exact_dedup.keyed(docs, key=lambda t: F.length(t).cast("long"))
        index = exact_dedup.build_index(rows.drop("norm"), scratch, capacity=4)
        chains = defaultdict(list)
        for r in index.buckets.collect():
            chains[r.key].append((r.digest, r.chain))
        assert all([n for _, n in sorted(c)] == list(range(1, len(c) + 1)) for c in chains.values()) and max(map(len, chains.values())) == 40
        new = spark.createDataFrame([(100, "te xt7"), (101, "other"), (102, "text 70 000 000")], SCHEMA)
        found = {r.id: r.keep_id for r in index.probe(exact_dedup.keyed(new, key=lambda t: F.length(t).cast("long")).drop("norm")).collect()}
        assert found == {100: 7, 101: None, 102: None}
