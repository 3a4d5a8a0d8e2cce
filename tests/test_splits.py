"""Held-out pairs keep their siblings at every size; contexts are packed as a plain loop packs them."""

import random
from collections import Counter, defaultdict

import pytest

from veritrail.operators import splits


def tasks(spark, seed=0):
    draw = random.Random(seed)
    rows = []
    for d, contexts, perts, share in (("big", 6, 40, 0.5), ("thin", 12, 12, 0.2), ("chain", 1, 1, 1.0), ("two", 2, 2, 1.0), (None, 3, 5, 0.9)):
        rows += [(d, f"c{c}", f"p{p}") for c in range(contexts) for p in range(perts) if draw.random() < share]
    rows += [("chain", f"c{k // 2}", f"p{(k + 1) // 2}") for k in range(1, 40)]  # every context and perturbation has two tasks
    return [(d, f"{d}|{c}|{p}", c, p) for d, c, p in rows]


SCHEMA = "d string, t string, c string, p string"


@pytest.mark.parametrize("seed", [0, 1])
def test_no_fold_holds_out_all_of_a_context_or_perturbation(spark, seed):
    rows = tasks(spark, seed)
    got = [r.asDict() for r in splits.held_out_splits(spark.createDataFrame(rows, SCHEMA).repartition(3), "d", "t", "c", "p", f"s{seed}").collect()]
    rows = [x for x in rows if x[0] is not None]
    by_set = defaultdict(list)
    for r in got:
        by_set[r["d"]].append(r)
    assert {(r["d"], r["t"]) for r in got} == {(d, t) for d, t, _, _ in rows}
    for d, mine in by_set.items():
        folds = {r["fold"] for r in mine}
        own = [x for x in rows if x[0] == d]
        nc, np_ = Counter(x[2] for x in own), Counter(x[3] for x in own)
        candidates = [x for x in own if nc[x[2]] >= 2 and np_[x[3]] >= 2]
        assert len(folds) == (5 if len(candidates) >= 15 else 3 if len(candidates) >= 6 else max(1, min(3, len(candidates))))
        assert len(mine) == len(own) * len(folds)
        sizes = Counter()
        tested = Counter(r["t"] for r in mine if r["split"] == "test")
        assert set(tested.values()) <= {1} and set(tested) <= {x[1] for x in candidates}
        for f in folds:
            of = {s: [r for r in mine if r["fold"] == f and r["split"] == s] for s in ("train", "val", "test")}
            sizes[f] = len(of["test"])
            train_c, train_p = {r["c"] for r in of["train"]}, {r["p"] for r in of["train"]}
            assert all(r["c"] in train_c and r["p"] in train_p and r["context_seen"] and r["perturbation_seen"] and not r["pair_seen"] for r in of["test"])
            pool = len(of["train"]) + len(of["val"])
            assert len(of["val"]) <= max(1, round(0.15 * pool)) and (len(of["train"]) >= 3 or not of["val"])
        if sum(tested.values()) == len(candidates):
            assert max(sizes.values()) - min(sizes.values()) <= 1
        assert len(candidates) - len(tested) <= (2 if d in ("two", "chain") else 0), (d, len(candidates), len(tested))


def test_repeated_pairs_raise_and_empty_tables_stay_empty(spark):
    df = spark.createDataFrame([("a", "t1", "c", "p"), ("a", "t2", "c", "p")], SCHEMA)
    with pytest.raises(ValueError):
        splits.held_out_folds(df, "d", "t", "c", "p")
    assert splits.held_out_splits(df.filter("false"), "d", "t", "c", "p").count() == 0


def test_contexts_are_packed_by_falling_load(spark):
    draw = random.Random(2)
    rows = [(d, f"t{k}", f"c{draw.randrange(12)}", "p") for d in ("a", "b") for k in range(100)] + [("a", "t0", None, "p")]
    rows += rows[:20]
    got = {(r.d, r.c): (r.n_tasks, r.fold) for r in splits.packed_contexts(spark.createDataFrame(rows, SCHEMA), "d", "t", "c", 4).collect()}
    for d in ("a", "b"):
        counts = defaultdict(set)
        for x in rows:
            if x[0] == d and x[2] is not None:
                counts[x[2]].add(x[1])
        loads = [0] * 4
        for c in sorted(counts, key=lambda c: (-len(counts[c]), c)):
            f = loads.index(min(loads))
            assert got[d, c] == (len(counts[c]), f)
            loads[f] += len(counts[c])
