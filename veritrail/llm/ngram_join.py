"""Exact n-gram Jaccard join of documents, through R-trees over count vectors.

A document's set is its distinct shingles of five words (fewer words: the whole sequence as one), held as 64-bit hashes.
Two documents link when 100 * intersection >= percent * union.

A single tree over all documents prunes by size alone and would compare all pairs of a size, so a forest is searched, one tree for each
list of documents that share a prefix shingle. The lists only say which documents may meet; the trees find the pairs.

1. One pass over the texts gives each document its set size, a fingerprint of the set, a count vector (shingles hashed
   into groups, counted) and its prefix: under one fixed order of all shingles, the first n - ceil(percent/100 * n) + 1. Any
   two linked documents share a shingle of their prefixes, whatever the order is; the order puts shingles that a sample shows to
   be frequent last, so lists stay short. The sample shapes the lists and never the result. Documents of equal sets count as
   one from here on.
2. Prefix shingles of a single document are dropped, by counts that are summed before the shuffle; so are the rows that can't hold
   the first shingle that a linked pair shares, as too few of the document's shingles come behind it.
3. Every document of a list is tried against two of the list's documents; links found so form first components, which join the
   members of large groups of near copies without trying them with each other.
4. Lists that still hold several components become trees: points packed by component and set size into leaves of at most LEAF,
   leaves into nodes of about NODE, each with the rectangle that bounds its points. Nodes, leaves and then points are
   joined with each other as long as the sum over groups of the smaller counts (for rectangles, of their upper corners) can
   reach the overlap that a link needs; what lies within one component is passed over. Of the surviving pairs between two
   components each pair of leaves names the best one, and tells whether it has more.
5. The best pair of any two components is verified on the whole sets. Where it fails, all others are, leaf by leaf, so no link
   between different texts is lost.

Results: rows that repeat a doc_id are one document, with the least of its texts. Null or wordless texts have an empty set
and link with nothing, equal ones neither. A null doc_id links with nothing and has a null component. Ids may be of any type that
has an order. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veritrail.llm.shared import Scratch, free_name, in_small_batches, written

WORDS, PERCENT = 5, 75
#: A count vector has a group for every two to four shingles: a power of two, at least LEAST_GROUPS.
LEAST_GROUPS, MOST_GROUPS = 16, 1 << 20
#: Points of a leaf; leaves of a node, about.
LEAF, NODE = 64, 64
#: Largest count that a vector holds; what exceeds it counts as one more group.
FULL = 255
#: Counts compared at a time when pairs of vectors are bounded.
BLOCK = 1 << 21
#: Parts of the prefix shingles, by their hash, that lists are made of one after the other, so that a part's shuffle files stand at a time.
SLICES = 4
#: Parts of the pairs, by the hash of one side, that are verified one after the other, for the same reason.
TURNS = 2
#: One in SAMPLE documents shows which shingles are frequent: those in FREQUENT of them or more, the first MOST_FREQUENT (8 bytes each).
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 3, 1_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[3]
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes (uint64) of a text's set."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, and only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    total = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
    for k in range(min(WORDS, len(words))):
        total += h[k : k + n] * _ODD[k]
    return np.unique(_mixed(total))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def count_vector(s: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles by the leading bits of their hashes, FULL at most."""
    groups = min(max(LEAST_GROUPS, 1 << max(0, (len(s) - 1) // 4).bit_length()), MOST_GROUPS)
    place = (s >> np.uint64(64 - (groups.bit_length() - 1))).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=groups), FULL).astype(np.uint8)


def _excess(vectors: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Shingles that vectors of sets of n don't hold, as their groups are full."""
    return np.asarray(n, np.int64) - np.array([int(v.sum(dtype=np.int64)) for v in vectors], np.int64)


def _folded(vectors: list[np.ndarray], picked: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The picked vectors, all of one length, as rows with neighbouring groups added up until groups are left; and the row of each pick."""
    used, at = np.unique(picked, return_inverse=True)
    rows = np.stack([vectors[k] for k in used])
    return rows if rows.shape[1] == groups else rows.reshape(len(rows), groups, -1).sum(2, dtype=np.int32), at


def overlap_bounds(left: list[np.ndarray], n: np.ndarray, right: list[np.ndarray], m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Most shingles that the sets (of n and m) of each pair of count vectors, left[i] and right[j], may share: the sum of smaller counts."""
    out = np.minimum(_excess(left, n)[i], _excess(right, m)[j])
    groups_left, groups_right = np.array([len(v) for v in left], np.int64)[i], np.array([len(v) for v in right], np.int64)[j]
    for a_len, b_len in sorted(set(zip(groups_left.tolist(), groups_right.tolist(), strict=True))):
        pairs = np.nonzero((groups_left == a_len) & (groups_right == b_len))[0]
        groups = min(a_len, b_len)
        (a, at), (b, bt) = _folded(left, i[pairs], groups), _folded(right, j[pairs], groups)
        step = max(1, BLOCK // groups)
        for k in range(0, len(pairs), step):
            out[pairs[k : k + step]] += np.minimum(a[at[k : k + step]], b[bt[k : k + step]]).sum(1, dtype=np.int64)
    return out


def needed(n, m, percent: int):
    """Least intersection of linked sets of n and m shingles: ceil(percent * (n + m) / (100 + percent)), of numbers or arrays."""
    return -(-percent * (n + m) // (100 + percent))


def _needed(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent) - F.lit(1e-9))


def _prefix(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    n = len(s)
    keep = n - -(-percent * n // 100) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        often = frequent[at] == s
        s = np.concatenate([s[~often], s[often]])
    return s[:keep]


def _frequent(tables: Scratch, docs: DataFrame, text: str) -> np.ndarray:
    """Sorted frequent shingles of the sample, at most MOST_FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.record_batch([pa.array(shingles(t.as_py()).view(np.int64))], ["key"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select(text)
    counts = sample.mapInArrow(run, "key long").groupBy("key").count().filter(F.col("count") >= FREQUENT)
    top = tables.written(counts.orderBy(F.desc("count"), "key").limit(MOST_FREQUENT).select("key")).toArrow()
    return np.sort(top["key"].to_numpy().view(np.uint64))


def _signatures(tables: Scratch, docs: DataFrame, text: str, percent: int) -> DataFrame:
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(tables, docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t.as_py()) for t in part.column(1)]
                prints = [xxhash.xxh128(s.tobytes()).digest() for s in sets]
                vectors = [count_vector(s).tobytes() for s in sets]
                keys = [_prefix(s, frequent.value, percent).view(np.int64) for s in sets]
                yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(vectors, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "print", "vector", "keys"])

    long, raw = T.LongType(), T.BinaryType()
    fields = [("n", long), ("print", raw), ("vector", raw), ("keys", T.ArrayType(long))]
    return in_small_batches(docs).select("doc_id", text).mapInArrow(run, T.StructType([docs.schema["doc_id"], *(T.StructField(k, kind) for k, kind in fields)]))


def _components(tables: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component), a table: the smallest node each node of the edges (a, b) is connected with, by large and small stars."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = tables.written(edges.select(high.alias("a"), low.alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = tables.written(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        before, edges = edges, tables.written(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).filter("a <> b").distinct())
        tables.drop(before, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        mark = now


def _verified(tables: Scratch, pairs: DataFrame, docs: DataFrame, text: str, percent: int) -> DataFrame:
    """The pairs (a, b) of a written table whose whole sets link, as tables. Only texts of these pairs are shuffled; they are smaller than their sets."""

    @F.arrow_udf(T.BooleanType())
    def check(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, kept = None, None
        for left, right in batches:
            out = []
            for a, b in zip(left, right, strict=True):
                a, b = a.as_py(), b.as_py()
                if b != last or kept is None:
                    last, kept = b, shingles(b)
                out.append(linked(shingles(a), kept, percent))
            yield pa.array(out, pa.bool_())

    ids = tables.written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())  # a table, so that Spark knows its bytes and broadcasts a small one
    texts = tables.written(docs.select("doc_id", F.col(text).alias("text")).join(ids, "doc_id", "left_semi"))
    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
    turns = [pairs.filter(F.pmod(F.xxhash64("b"), F.lit(TURNS)) == k) for k in range(TURNS)]
    links = [tables.written(turn.join(side("a"), "a").join(side("b"), "b").filter(check("text_a", "text_b")).select("a", "b")) for turn in turns]
    tables.drop(ids, texts)
    return reduce(DataFrame.unionByName, links)


def _named(rows: DataFrame, parts: DataFrame, column: str, out: str) -> DataFrame:
    """rows with the component of a column's documents as out, themselves if they have none."""
    names = parts.select(F.col("node").alias(column), F.col("component").alias("__c"))
    return rows.join(names, column, "left").withColumn(out, F.coalesce("__c", column)).drop("__c")


def _lists(tables: Scratch, firsts: DataFrame, percent: int) -> DataFrame:
    """(key, doc_id, n) of prefix shingles that several documents hold, and of these the rows that can be a linked pair's first shared shingle.

    left: the document's shingles from the key on, in the order. The pair needs as many as its overlap, which grows with both sizes.
    """
    held = firsts.select("doc_id", "n", F.posexplode("keys").alias("at", "key")).select("key", "doc_id", F.col("n").cast("int").alias("n"), (F.col("n") - F.col("at")).cast("int").alias("left"))
    smallest = F.greatest(F.col("low"), F.ceil(F.lit(percent / 100.0) * F.col("n") - F.lit(1e-9)))
    alone = (F.col("size") == 2) & ((100 * F.col("low") < percent * F.col("high")) | (F.col("least") < _needed(F.col("low"), F.col("high"), percent)))
    parts = []
    for k in range(SLICES):
        part = held.filter(F.pmod("key", F.lit(SLICES)) == k)
        ends = part.groupBy("key").agg(F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("left").alias("least"))
        ends = tables.written(ends.filter((F.col("size") > 1) & ~alone).select("key", "low"))
        parts.append(tables.written(part.join(ends.hint("shuffle_hash"), "key").filter(F.col("left") >= _needed(F.col("n"), smallest, percent)).select("key", "doc_id", "n")))
        tables.drop(ends)
    return reduce(DataFrame.unionByName, parts)


def _first_trials(lists: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """(a, b): documents of a list with its least and its greatest one, if their count vectors let them link."""
    ends = lists.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi")
    pairs = lists.join(ends, "key").select("doc_id", F.explode(F.array("lo", "hi")).alias("end")).filter("doc_id <> end")
    pairs = pairs.select(F.greatest("doc_id", "end").alias("a"), F.least("doc_id", "end").alias("b")).distinct()

    @F.arrow_udf(T.LongType())
    def bound(left: pa.Array, n: pa.Array, right: pa.Array, m: pa.Array) -> pa.Array:
        read = lambda v: [np.frombuffer(x, np.uint8) for x in v.to_pylist()]
        return pa.array(overlap_bounds(read(left), n.to_numpy(), read(right), m.to_numpy(), *[np.arange(len(left))] * 2))

    side = lambda k: vectors.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("vector").alias(f"vector_{k}"))
    need = _needed(F.col("n_a"), F.col("n_b"), percent)
    met = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") >= need)
    return met.filter(bound("vector_a", "n_a", "vector_b", "n_b") >= need).select("a", "b")


def _open_lists(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, doc_id, component, size, crowd) of lists that hold several components, one of those with the same documents; crowd: the component's documents."""
    crowds = parts.groupBy("component").agg(F.count("*").alias("crowd"))
    names = parts.join(crowds, "component").select(F.col("node").alias("doc_id"), "component", "crowd")
    member = lists.join(names, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"), F.coalesce("crowd", F.lit(1)).alias("crowd"))
    alike = member.groupBy("key").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"))
    once = alike.filter("lo <> hi").groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    return member.join(once, "key")


def _trees(tables: Scratch, members: DataFrame, vectors: DataFrame) -> DataFrame:
    """The leaves of all lists' trees, a table: key, node, leaf, rows, their sizes' and components' ends, and the upper corner of their rectangle."""
    many = F.ceil(F.col("size") / F.lit(LEAF * NODE))
    deal = F.when(F.col("crowd") > LEAF * NODE, F.xxhash64("component", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("crowd") / F.lit(LEAF * NODE))))).otherwise(F.xxhash64("component"))
    rows = members.join(vectors, "doc_id").withColumn("node", F.pmod(deal, many))
    order = Window.partitionBy("key", "node").orderBy("component", "n", "doc_id")  # one node's points
    rows = rows.withColumn("leaf", F.floor((F.row_number().over(order) - 1) / LEAF).cast("int"))
    ends = [f(c).alias(name) for c, lo, hi in (("n", "low", "high"), ("component", "from", "to")) for f, name in ((F.min, lo), (F.max, hi))]
    leaves = rows.groupBy("key", "size", "node", "leaf").agg(F.collect_list(F.struct("doc_id", "n", "component", "vector")).alias("rows"), *ends)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def corner(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for leaves in batches:
            yield pa.array([_corner(_leaf(x)) for x in leaves], pa.list_(pa.int64()))

    return tables.written(leaves.withColumn("corner", corner("rows")))


def _leaf(rows: pa.ListScalar) -> dict:
    """The columns of a leaf; doc_id and component as Arrow arrays."""
    fields = dict(zip([f.name for f in rows.type.value_type], rows.values.flatten(), strict=True))
    return fields | {"n": fields["n"].to_numpy(), "vector": [np.frombuffer(x, np.uint8) for x in fields["vector"].to_pylist()]}


def _corner(leaf: dict) -> np.ndarray:
    """Upper corner of a leaf's rectangle, in LEAST_GROUPS groups and the excess."""
    folded = [v.reshape(LEAST_GROUPS, -1).sum(1, dtype=np.int64) for v in leaf["vector"]]
    return np.append(np.max(folded, axis=0), _excess(leaf["vector"], leaf["n"]).max())


def _meeting(left: str, right: str, percent: int) -> Column:
    """Whether points in the rectangles of two nodes or leaves may link, and not all of them are of one component."""
    at = lambda side, c: F.col(f"{side}.{c}")
    low, high = F.least(at(left, "low"), at(right, "low")), F.greatest(at(left, "low"), at(right, "low"))
    sizes = (100 * at(left, "high") >= percent * at(right, "low")) & (100 * at(right, "high") >= percent * at(left, "low"))
    shared = F.aggregate(F.zip_with(at(left, "corner"), at(right, "corner"), lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda s, v: s + v)
    apart = (at(left, "from") != at(left, "to")) | (at(right, "from") != at(right, "to")) | (at(left, "from") != at(right, "from"))
    return apart & sizes & (shared >= _needed(low, high, percent))


def _leaf_pairs(tables: Scratch, leaves: DataFrame, percent: int) -> DataFrame:
    """(key, node, leaf, node2, leaf2): different leaves of a tree that may hold linked points, top down."""
    trees = leaves.filter(F.col("size") > LEAF).select("key", "node", "leaf", "low", "high", "from", "to", "corner")
    top = F.array(*(F.max(F.get("corner", F.lit(k))) for k in range(LEAST_GROUPS + 1)))
    nodes = trees.groupBy("key", "node").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("from").alias("from"), F.max("to").alias("to"), top.alias("corner"))
    met = nodes.alias("l").join(nodes.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.node") <= F.col("r.node"))).filter(_meeting("l", "r", percent))
    met = met.select(F.col("l.key").alias("key"), F.col("l.node").alias("node"), F.col("r.node").alias("node2"))
    left = met.join(trees, ["key", "node"]).alias("l")
    second = (F.col("l.key") == F.col("r.key")) & (F.col("l.node2") == F.col("r.node")) & ((F.col("l.node") != F.col("r.node")) | (F.col("l.leaf") < F.col("r.leaf")))
    met = left.join(trees.alias("r"), second).filter(_meeting("l", "r", percent))
    return tables.written(met.select("l.key", "l.node", "l.leaf", F.col("r.node").alias("node2"), F.col("r.leaf").alias("leaf2")))


def _survivors(left: dict, right: dict, same: bool, percent: int, couples: list | None = None) -> tuple[np.ndarray, ...]:
    """Positions in left and right of pairs between components whose overlap bound reaches what they need, the factor, and a number for each couple.

    couples: those of components that alone count.
    """
    codes = pa.chunked_array([left["component"], right["component"]]).combine_chunks().dictionary_encode()
    code, names = codes.indices.to_numpy(), codes.dictionary
    c, d = code[: len(left["n"])], code[len(left["n"]) :]
    need = needed(left["n"][:, None], right["n"][None], percent)
    may = (c[:, None] != d[None]) & (np.minimum(left["n"][:, None], right["n"][None]) >= need)
    if couples is not None:
        asked, place = np.zeros((len(names), len(names)), bool), {x: k for k, x in enumerate(names.to_pylist())}
        for x, y in couples:
            asked[place[x], place[y]] = asked[place[y], place[x]] = True
        may &= asked[c[:, None], d[None]]
    if same:
        may = np.triu(may, 1)
    i, j = np.nonzero(may)
    slack = overlap_bounds(left["vector"], left["n"], right["vector"], right["n"], i, j) / need[i, j]
    reach = slack >= 1
    i, j, slack = i[reach], j[reach], slack[reach]
    return i, j, slack, np.minimum(c[i], d[j]).astype(np.int64) * len(names) + np.maximum(c[i], d[j])


def _best(i: np.ndarray, j: np.ndarray, slack: np.ndarray, couple: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each couple the pair of most slack, and how many others it has."""
    order = np.lexsort((-slack, couple))
    _, at, count = np.unique(couple[order], return_index=True, return_counts=True)
    return i[order[at]], j[order[at]], slack[order[at]], count - 1


def _probed(leaves: DataFrame, met: DataFrame, percent: int) -> DataFrame:
    """(key, node, leaf, node2, leaf2, a, b, c, d, slack, more): of the leaves, each with itself, and of the pairs of leaves in met.

    a, b is the best surviving pair of points of components c, d; more: how many others survive.
    """
    names, spots = ("a", "b", "c", "d"), ["key", "node", "leaf", "node2", "leaf2"]
    id_type = leaves.schema["from"].dataType
    pair = T.ArrayType(T.StructType([*(T.StructField(k, id_type) for k in names), T.StructField("slack", T.DoubleType()), T.StructField("more", T.LongType())]))

    @F.arrow_udf(pair)
    def probe(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lefts, rights, same in batches:
            out, ends = [], [0]
            for k in range(len(lefts)):
                x, y = _leaf(lefts[k]), _leaf(rights[k])
                i, j, slack, more = _best(*_survivors(x, y, same[k].as_py(), percent))
                ends.append(ends[-1] + len(i))
                i, j = pa.array(i), pa.array(j)
                out.append([x["doc_id"].take(i), y["doc_id"].take(j), x["component"].take(i), y["component"].take(j), pa.array(slack, pa.float64()), pa.array(more, pa.int64())])
            id_arrow = lefts.type.value_type.field("doc_id").type
            columns = [pa.concat_arrays([o[k] for o in out]) if out else pa.array([], t) for k, t in enumerate([id_arrow] * 4 + [pa.float64(), pa.int64()])]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, [*names, "slack", "more"]))

    one, rows = ["key", "node", "leaf"], leaves.select("key", "node", "leaf", "rows")
    own = leaves.filter(F.col("from") != F.col("to")).select(*one, F.explode(probe("rows", "rows", F.lit(True))).alias("p")).select(*one, F.col("node").alias("node2"), F.col("leaf").alias("leaf2"), "p.*")
    others = rows.join(met, one).join(rows.select("key", F.col("node").alias("node2"), F.col("leaf").alias("leaf2"), F.col("rows").alias("rows2")), ["key", "node2", "leaf2"])
    return own.unionByName(others.select(*spots, F.explode(probe("rows", "rows2", F.lit(False))).alias("p")).select(*spots, "p.*"))


def _links_of_leaves(tables: Scratch, leaves: DataFrame, met: DataFrame, docs: DataFrame, text: str, percent: int) -> DataFrame:
    """(a, b): links between points of the pairs of leaves in met, a written table with wanted, the couples of components that count.

    A leaf's texts come to it once, their sets are made once, and every surviving pair is verified there, but for those that links found
    in the two leaves connect already. So large groups of near copies that don't link make rows for each leaf, not for each pair.
    """
    id_type = leaves.schema["from"].dataType

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])))
    def links(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for lefts, rights, same, wanted in batches:
            out = []
            for k in range(len(lefts)):
                x, y = _with_sets(lefts[k]), _with_sets(rights[k])
                i, j, *_ = _survivors(x, y, same[k].as_py(), percent, [(w["c"], w["d"]) for w in wanted[k].as_py()])
                ids, top, found = (x["doc_id"].to_pylist(), y["doc_id"].to_pylist()), {}, []
                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    a, b = ids[0][p], ids[1][q]
                    if (u := _top(top, a)) != (v := _top(top, b)) and linked(x["set"][p], y["set"][q], percent):
                        top[u] = v
                        found.append({"a": a, "b": b})
                out.append(found)
            yield pa.array(out, pa.list_(pa.struct([(c, lefts.type.value_type.field("doc_id").type) for c in ("a", "b")])))

    one, two = ["key", "node", "leaf"], ["key", "node2", "leaf2"]
    asked = met.select(*one, F.explode("wanted").alias("w")).unionByName(met.select("key", F.col("node2").alias("node"), F.col("leaf2").alias("leaf"), F.explode("wanted").alias("w")))
    asked = asked.select(*one, F.explode(F.array("w.c", "w.d")).alias("component")).distinct()
    points = leaves.select(*one, F.explode("rows").alias("r")).select(*one, "r.doc_id", "r.component").join(asked, [*one, "component"])
    points = tables.written(points)
    ids = tables.written(points.select("doc_id").distinct())
    texts = docs.select("doc_id", F.col(text).alias("text")).join(ids, "doc_id", "left_semi")
    filled = tables.written(points.join(texts, "doc_id").groupBy(*one).agg(F.collect_list(F.struct("doc_id", "component", "text")).alias("rows")))
    right = filled.select("key", F.col("node").alias("node2"), F.col("leaf").alias("leaf2"), F.col("rows").alias("rows2"))
    same = (F.col("node") == F.col("node2")) & (F.col("leaf") == F.col("leaf2"))
    return met.join(filled, one).join(right, two).select(F.explode(links("rows", "rows2", same, "wanted")).alias("l")).select("l.*")


def _with_sets(rows: pa.ListScalar) -> dict:
    """The columns of a leaf with texts, with sets and what bounds them."""
    fields = dict(zip([f.name for f in rows.type.value_type], rows.values.flatten(), strict=True))
    sets = [shingles(t.as_py()) for t in fields["text"]]
    return {"doc_id": fields["doc_id"], "component": fields["component"], "set": sets, "n": np.array([len(s) for s in sets], np.int64), "vector": [count_vector(s) for s in sets]}


def _top(top: dict, x):
    while x in top:
        x = top[x]
    return x


def _ordered(a: str, b: str) -> tuple[Column, Column]:
    """A pair as the greater and the smaller one."""
    return F.greatest(a, b).alias("a"), F.least(a, b).alias("b")


def _joined(tables: Scratch, parts: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component), a table, of parts after further links (a, b) between nodes."""
    links = _named(_named(links, parts, "a", "x"), parts, "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = _components(tables, links)
    merged = _named(parts, roots, "component", "root").select("node", F.col("root").alias("component"))
    return tables.written(merged.unionByName(roots.join(parts, "node", "left_anti").select("node", "component")).distinct())


def _links(tables: Scratch, vectors: DataFrame, lists: DataFrame, docs: DataFrame, text: str, percent: int) -> DataFrame:
    """(node, component) of documents of different sets that links connect."""
    tried = tables.written(_first_trials(lists, vectors, percent))
    parts = _components(tables, _verified(tables, tried, docs, text, percent))

    leaves = _trees(tables, _open_lists(lists, parts), vectors)
    found = tables.written(_probed(leaves, _leaf_pairs(tables, leaves, percent), percent))
    couple = [F.greatest("c", "d").alias("c"), F.least("c", "d").alias("d")]
    best = found.groupBy(*couple).agg(F.max_by(F.struct(*_ordered("a", "b")), F.struct("slack", "a", "b")).alias("best")).select("best.*").distinct()
    best = tables.written(best.join(tried, ["a", "b"], "left_anti"))
    parts = _joined(tables, parts, _verified(tables, best, docs, text, percent))

    still = tables.written(_named(_named(found, parts, "c", "x"), parts, "d", "y").filter("x <> y"))
    lone = still.filter("more = 0").select(*_ordered("a", "b")).distinct().join(tried, ["a", "b"], "left_anti").join(best, ["a", "b"], "left_anti")
    crowded = tables.written(still.filter("more > 0").groupBy("key", "node", "leaf", "node2", "leaf2").agg(F.collect_set(F.struct(*couple)).alias("wanted")))
    links = _verified(tables, tables.written(lone), docs, text, percent).unionByName(_links_of_leaves(tables, leaves, crowded, docs, text, percent))
    return _joined(tables, parts, links)


def ngram_components(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    docs = docs.select("doc_id", text)
    ids = docs.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if ids[0] != ids[1]:
        docs = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias(text)).unionByName(docs.filter("doc_id is null"))
    with Scratch(docs.sparkSession) as tables:
        signed = tables.written(_signatures(tables, docs, text, percent))
        real = signed.filter("doc_id is not null and n > 0")
        least = real.groupBy("print", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
        least = tables.written(least.select("print", "n", "first"))  # a table, so that a hot group's rows may be split in the join
        copies = tables.written(real.select("doc_id", "print", "n").join(least, ["print", "n"]).filter("doc_id <> first").select("doc_id", "first"))
        keyed = tables.written(real.select("doc_id", "n", "keys").join(copies.select("doc_id"), "doc_id", "left_anti"))
        sized = tables.written(signed.select("doc_id", "n", "vector"))
        tables.drop(signed, least)
        lists = _lists(tables, keyed, percent)
        tables.drop(keyed)
        vectors = sized.filter("doc_id is not null and n > 0").join(copies.select("doc_id"), "doc_id", "left_anti")
        parts = _links(tables, vectors, lists, docs, text, percent)
        rows = sized.select("doc_id", F.col("n").alias("n_shingles")).join(copies, "doc_id", "left").withColumn("first", F.coalesce("first", "doc_id"))
        return written(_named(rows, parts, "first", "component_id").select("doc_id", "n_shingles", "component_id"))


def keep_first(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs without those that links connect with a document of a smaller doc_id; all columns stay.

    Rows of one doc_id count as one document: of them the row of the least text stays, or of the least other values.
    Wordless texts and rows without doc_id link with nothing and stay.
    """
    named = ngram_components(docs, text, percent)
    gone = written(named.filter("doc_id <> component_id").select("doc_id"))
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if docs.filter("doc_id is not null").count() == named.filter("doc_id is not null").count():
        return kept
    others = [c for c in docs.columns if c not in ("doc_id", text)]
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col(text).asc_nulls_last(), *others))
    own = free_name(kept, "__first")
    return kept.withColumn(own, first).filter((F.col(own) == 1) | F.col("doc_id").isNull()).drop(own)
