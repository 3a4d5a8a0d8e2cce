import random
from pathlib import Path

import numpy as np
import pytest

from veritrail.llm import ngram_join


def word_set(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id: (size, smallest reachable id), from all pairs."""
    sets = {}
    for i, text in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or "")):
        sets.setdefault(i, word_set(text))
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if b < a and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def crowd(seed, n):
    pick = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    bases = [[pick.choice(words) for _ in range(pick.randint(3, 90))] for _ in range(8)]
    passage = [pick.choice(words) for _ in range(40)]
    rows = []
    for k in range(n):
        text = list(pick.choice(bases)) if pick.random() < 0.8 else [pick.choice(words) for _ in range(50)]
        for _ in range(pick.randint(0, 5)):
            text[pick.randrange(len(text))] = pick.choice(words)
        if pick.random() < 0.3:
            text = text[: len(text) // 2] + passage + text[len(text) // 2 :]
        rows.append((k * 3 + 1, pick.choice(["  ", "\n", " "]).join(text).upper() if pick.random() < 0.1 else " ".join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "SAMPLE", 2)
    monkeypatch.setattr(ngram_join, "LEAF", 8)
    monkeypatch.setattr(ngram_join, "NODE", 2)
    rows = crowd(seed, 220)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_exact_border_of_the_threshold():
    a = ngram_join.shingles(" ".join(map(str, range(24))))
    b = ngram_join.shingles(" ".join(map(str, range(19))))
    assert (len(a), len(b)) == (20, 15) and ngram_join.linked(a, b)
    assert not ngram_join.linked(a, ngram_join.shingles(" ".join(map(str, range(18)))))


def test_edge_cases(spark):
    same = "one two three four five six"
    rows = [(4, None), (5, ""), (6, " \n"), (7, "short text"), (8, "Short  TEXT"), (9, same), (9, same), (10, same), (11, "b"), (11, "a"), (12, "a"), (13, "é" * 50_000 + " x"), (None, same)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_shingles int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()}
    assert got == {**brute([r for r in rows if r[0]]), None: (2, None)}
    assert got[4] == (0, 4) and got[5] == (0, 5) and got[8] == (1, 7) and got[10] == (2, 9) and got[12] == (1, 11)
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["4", "5", "6", "7", "9", "11", "13", "None"])
    assert ngram_join.ngram_components(docs.limit(0)).count() == 0


def test_text_ids_and_full_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAF", 4)
    monkeypatch.setattr(ngram_join, "FULL", 2)  # groups overflow into the excess
    rows = [(f"d{k:03}", text) for k, text in crowd(5, 90)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_bounds_hold_for_overlaps():
    pick = random.Random(4)
    for _ in range(200):
        a, b = ({f"s{pick.randrange(400)}" for _ in range(pick.randint(1, 300))} for _ in range(2))
        x, y = ([ngram_join.shingles(w)[0] for w in sorted(s)] for s in (a, b))
        x, y = (np.array(sorted(s), np.uint64) for s in (x, y))
        bound = ngram_join.overlap_bounds([ngram_join.count_vector(x)], np.array([len(x)]), [ngram_join.count_vector(y)], np.array([len(y)]), np.array([0]), np.array([0]))
        assert bound[0] >= len(a & b)


def test_intermediate_tables_go(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    out = ngram_join.ngram_components(spark.createDataFrame(crowd(6, 40), "doc_id long, text string"))
    assert len(set(folder.iterdir()) - before) == 1 and out.count() == 40


def test_keep_first_keeps_a_column_named_like_its_own(spark):
    words = "one two three four five six seven"
    rows = spark.createDataFrame([(1, words, "a"), (1, words, "b"), (2, words + " ", "c"), (3, "other", "d")], "doc_id long, text string, __first string")
    got = ngram_join.keep_first(rows)
    assert got.columns == ["doc_id", "text", "__first"] and sorted((r.doc_id, r["__first"]) for r in got.collect()) == [(1, "a"), (3, "d")]
