import hashlib
import random
from collections import Counter

import regex
import xxhash
from pyspark.sql import functions as F

from veritrail.llm import order_minhash as om
from veritrail.llm.queries import op9_order_minhash


def prints(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    return [r.fingerprint for r in om.add_fingerprint(rows).orderBy("k").collect()]


def alike(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / om.SKETCHES


def test_likeness_falls_with_edits_and_with_order(spark):
    pick = random.Random(1)
    words = [f"w{pick.randrange(5000)}" for _ in range(600)]
    edited = [w if pick.random() > 0.02 else "new" for w in words]
    blocks = [words[k : k + 60] for k in range(0, 600, 60)]
    moved = [w for b in reversed(blocks) for w in b]
    other = [f"v{pick.randrange(5000)}" for _ in range(600)]
    base, near, turned, far = prints(spark, [" ".join(x) for x in (words, edited, moved, other)])
    assert alike(base, near) > 0.6 and alike(base, far) == 0
    assert alike(base, turned) < alike(base, near)  # nearly the same k-mers in another order


def test_repeats_are_numbered(spark):
    few, many, more = prints(spark, ["a b c " * 2, "a b c " * 40, "a b c " * 41])
    assert alike(few, many) < 0.5 < alike(many, more)


SCRIPTS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"


def chained(*values):
    """Spark's xxhash64 of strings, ints (4 bytes) and longs, as an unsigned number."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed)
    return seed


def plain(text):
    """The fingerprint in plain Python, as signed numbers."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    as_long, as_int = (lambda x: x.to_bytes(8, "little")), (lambda x: x.to_bytes(4, "little"))
    tokens = regex.findall(rf"[{SCRIPTS}]|[^\x20\x09-\x0D{SCRIPTS}]+", text or "")
    if not tokens:
        return [0] * om.SKETCHES
    mers = [chained(*tokens[k : k + 3]) for k in range(max(1, len(tokens) - 2))]
    seen, ids = Counter(), []
    for h in mers:
        ids.append(chained(as_long(h), as_int(seen[h])))
        seen[h] += 1
    out = []
    for order in range(om.ORDERS):
        circle = sorted((signed(chained(as_long(x), as_int(order))), at) for at, x in enumerate(ids))
        for k in range(om.STARTS):
            start = -(1 << 63) + k * ((1 << 64) // om.STARTS)
            first = sum(h < start for h, _ in circle)
            chosen = [circle[(first + m) % len(circle)] for m in range(min(om.LENGTH, len(circle)))]
            out.append(signed(chained(*(as_long(ids[at]) for at in sorted(at for _, at in chosen)))))
    return out


def test_fingerprints_equal_plain_python(spark):
    pick = random.Random(3)
    texts = [None, "", " \n", "x", "x y", "a b a b a b c a b c", "一二三四五六七", "mixed 東京 text ไทย end", "é ü " * 30, "word " * 500]
    texts += [" ".join(f"w{pick.randrange(40)}" for _ in range(pick.randint(1, 200))) for _ in range(40)]
    assert prints(spark, texts) == [plain(t) for t in texts]


def test_unspaced_and_short_texts_have_likeness(spark):
    pick = random.Random(9)
    text = [chr(0x4E00 + pick.randrange(3000)) for _ in range(300)]
    changed = [*text[:150], chr(0x4E00 + 2999), *text[151:]]
    short = "one two three four five six seven eight nine ten"
    base, near, few, fewer = prints(spark, ["".join(text), "".join(changed), short, short + " eleven"])
    assert 0.8 < alike(base, near) < 1 and len(set(few)) > 16 and 0.5 < alike(few, fewer) < 1


def test_likeness_follows_edit_similarity(spark):
    """Against the share of words left alone: means fall with the edits, and the error of an estimate stays within that of 64 draws."""
    pick = random.Random(12)
    words = [f"w{pick.randrange(9000)}" for _ in range(400)]
    rates = [0.0, 0.01, 0.03, 0.1, 0.3]
    texts = [" ".join(w if pick.random() >= r else f"new{pick.random()}" for w in words) for r in rates for _ in range(12)]
    base, *others = prints(spark, [" ".join(words), *texts])
    means = [sum(alike(base, others[k * 12 + i]) for i in range(12)) / 12 for k in range(len(rates))]
    assert means[0] == 1 and all(x > y for x, y in zip(means, means[1:], strict=False))
    jaccard = [((1 - r) ** 3) / (2 - (1 - r) ** 3) for r in rates]
    assert all(abs(m - j**2) < 0.12 for m, j in zip(means, jaccard, strict=True))  # both k-mers of a tuple have to be shared


def test_clashing_columns_and_a_very_long_text(spark):
    rows = spark.createDataFrame([(1, "a b c", "old", 5), (2, "w " * 200_000, None, 6)], "k long, text string, fingerprint string, __k int")
    got = om.add_fingerprint(rows).orderBy("k").collect()
    assert [len(r.fingerprint) for r in got] == [om.SKETCHES] * 2 and [r["__k"] for r in got] == [5, 6]
    following = om.with_next(rows, "k", ["text"])
    assert following.columns == [*rows.columns, "next_text"] and [r["__k"] for r in following.orderBy("k").collect()] == [5, 6]


def test_query(spark, tmp_path):
    pick = random.Random(2)
    texts = [None, "", "é", "one two", "same text here", "same text here", *(" ".join(f"w{pick.randrange(50)}" for _ in range(pick.randint(1, 80))) for _ in range(300))]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)] + [(5000, "repeated a"), (5000, "repeated b"), (10**15, "far away")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in op9_order_minhash(spark, str(tmp_path)).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(ordered):
        half = len(text) // 2
        edited = text[: len(text) - half] + ordered[(k + 1) % len(ordered)][1][:half]
        row = got[i, len(text), hashlib.sha256(edited.encode()).hexdigest()]
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert len({r.fingerprint for (i, _, _), r in got.items() if i in (28, 35)}) == 1  # the same text
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert om.with_next(empty, "doc_id", ["text"]).count() == 0


def test_scripts_are_looked_up_for_no_character_below_them(spark):
    u = om.UNSPACED
    plain = rf"[{u}]|[^\x20\x09-\x0D{u}]+"
    assert om.TOKEN.count(r"\x{E00}-\x{10FFFF}&&[") == om.TOKEN.count(u) == 2
    points = [k for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    texts = spark.createDataFrame([("".join(map(chr, points[k : k + 997])),) for k in range(0, len(points), 997)] + [("ab",), ("",)], "t string")
    split = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), F.lit(0))
    assert texts.filter(split(om.TOKEN) != split(plain)).count() == 0
    assert texts.select(F.sum(F.size(split(plain)))).first()[0] > 90_000
