from collections import defaultdict
from math import floor, log

import xxhash

from veritrail.llm import mixing


def corpus(spark, sizes):
    rows = [(k, "w " * (k % 7 + 1), s) for s, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def taken(frame):
    rows = frame.collect()
    out = {}
    for r in rows:
        t, w, c = out.setdefault(r.source, [0, r.mix_weight, 0])
        out[r.source] = [t + r.mix_tokens, w, c + r.mix_tokens * r.mix_copies]
    return out, rows


def test_weights_meet_their_condition_and_are_realised(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 200)
    docs = corpus(spark, {"hot": 3000, "a": 600, "b": 300, None: 200})
    by_entropy, rows = taken(mixing.mix_sources(docs, entropy_share=0.8, most_passes=50))
    weights = [w for _, w, _ in by_entropy.values()]
    assert abs(sum(weights) - 1) < 1e-9 and abs(-sum(w * log(w) for w in weights) / log(4) - 0.8) < 1e-6
    total = sum(c for _, _, c in by_entropy.values())
    assert all(abs(c / total - w) < 0.002 for _, w, c in by_entropy.values())
    assert min(r.mix_copies for r in rows) == 1
    by_limit, _ = taken(mixing.mix_sources(docs, entropy_share=1.0, most_passes=2.0))
    assert abs(max(c / t for t, _, c in by_limit.values()) - 2.0) < 0.02


def test_budget_is_kept(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 100)
    got, _ = taken(mixing.mix_sources(corpus(spark, {"hot": 3000, "a": 600}), entropy_share=0.0, budget=4000.0))
    assert abs(sum(c for _, _, c in got.values()) - 4000) <= 2 * 7


def test_edge_cases(spark):
    rows = [(1, None, "x", "k"), (1, "", "x", "k"), (2, "same", None, "k"), (2, "same", None, "k"), (None, "long " * 100_000, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_weight string")
    out = mixing.mix_sources(docs)
    assert out.count() == 5 and all(r.mix_copies >= 1 for r in out.collect())
    assert len({(r.mix_copies, r.mix_order) for r in out.filter("source is null").collect()}) == 1
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    one = mixing.mix_sources(docs.filter("source = 'x'")).collect()
    assert [r.mix_copies for r in one] == [1, 1] and one[0].mix_weight == 1


def hashed(*values):
    """Spark's xxhash64 of longs and strings, as a signed number."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute(rows, entropy_share, most_passes, block_tokens):
    """(doc_id, tokens, copies, block) of each row and the weights, in plain Python."""
    tokens = [max(1, len((t or "").split())) for _, t, _ in rows]
    orders = [hashed(i, t, s) >> 1 for i, t, s in rows]
    sums = defaultdict(int)
    for (_, _, s), n in zip(rows, tokens, strict=True):
        sums[s] += n
    total = sum(sums.values())

    def weights(a):
        powers = {s: (n / total) ** a for s, n in sums.items()}
        return {s: p / sum(powers.values()) for s, p in powers.items()}

    def budget(a):
        big = max(sums, key=sums.get)
        return sums[big] / weights(a)[big]

    def too_low(a):
        w = weights(a)
        few = min(sums, key=sums.get)
        return -sum(x * log(x) for x in w.values()) >= entropy_share * log(len(w)) - 1e-12 or w[few] * budget(a) / sums[few] > most_passes + 1e-12

    low, high = 0.0, 1.0
    if too_low(1.0):
        low = high
    for _ in range(30):
        middle = (low + high) / 2
        low, high = (middle, high) if too_low(middle) else (low, middle)
    w, spent = weights(high), budget(high)
    out = {}
    for source, size in sums.items():
        due = w[source] * spent
        passes = floor(due / size + 1e-9)
        rest, blocks = max(0, round(due - passes * size)), -(-size // block_tokens)
        own = sorted((hashed(o) % blocks, o, k) for k, o in enumerate(orders) if rows[k][2] == source)
        filled = defaultdict(int)
        for b, _, k in own:
            filled[b] += tokens[k]
        before = 0
        for b in range(blocks):
            at, left = 0, rest - before
            for block, o, k in own:
                if block == b:
                    start = sum(tokens[j] for c, p, j in own if c == b and p < o)
                    out[k] = (rows[k][0], tokens[k], passes + (left > 0 and start < left), b)
            before += filled[b]
    return [out[k] for k in range(len(rows))], w


def test_mix_equals_plain_python(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 60)
    rows = [(k, " ".join(["w"] * (k % 9)), s) for s, n in {"hot": 240, "a": 70, "b": 20, None: 12}.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share, passes in ((0.9, 50.0), (1.0, 2.0), (0.3, 2.0)):
        got = mixing.mix_sources(docs, entropy_share=share, most_passes=passes).collect()
        wanted, weights = brute(rows, share, passes, 60)
        assert sorted((r.doc_id, r.mix_tokens, r.mix_copies, r.mix_block, r.source or "") for r in got) == sorted((*x, r[2] or "") for x, r in zip(wanted, rows, strict=True))
        assert all(abs(r.mix_weight - weights[r.source]) < 1e-6 for r in got)


def test_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7, 8, 9)], "doc_id long, text string, source string, __s int, __passes int, __plan int")
    r = mixing.mix_sources(docs).first()
    assert (r["__s"], r["__passes"], r["__plan"], r.mix_copies) == (7, 8, 9, 1)


def test_every_pass_has_an_order_of_its_own(spark):
    rows = mixing.mix_sources(corpus(spark, {"hot": 300, "a": 40}), entropy_share=1.0, most_passes=4.0).filter("source = 'a'")
    rows = rows.collect()
    assert all(len(r.mix_orders) == r.mix_copies for r in rows) and min(r.mix_copies for r in rows) >= 2
    first, second = ([r.doc_id for r in sorted(rows, key=lambda r: r.mix_orders[k])] for k in (0, 1))
    assert first != second and sorted(first) == sorted(second)
