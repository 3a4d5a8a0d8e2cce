"""A Merkle manifest of a dataset, with its nodes in Parquet on shared storage.

Leaves are sorted into runs and numbered by them; every level above is made from the one below it, a block of consecutive nodes at a
time, and stands in its own partition of the node store. A second, smaller tree joins the roots of the groups. Proofs are read off
downwards: a block of nodes and the path of the node above it, found by their coordinates, give the paths of all nodes of the block.
Coordinates of a node are its group's number, its level and its place in the level.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.shared import Scratch, numbered, written

#: Children of a node, and levels that one block spans: 729 nodes at its foot.
ARITY, STEP = 3, 6
BLOCK = ARITY**STEP
_POWERS = [ARITY**k for k in range(40)]
_NODE = "gid long, level int, at long, digest string, top int"


def field(value: Column) -> Column:
    """What a value adds to its leaf: the count of its UTF-8 bytes, a colon and the value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def _levels(n: Column) -> Column:
    """Levels above n nodes until one remains."""
    return F.size(F.filter(F.array(*map(F.lit, _POWERS)), lambda p: p < n))


def _parents(digests: list[str]) -> list[str]:
    return [sha256("".join(digests[k : k + ARITY]).encode()).hexdigest() for k in range(0, len(digests), ARITY)]


def _rise(low: int):
    """The nodes that a block of level low has on the levels above it, up to STEP of them or to the group's top."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        gid, block, top = (rows[c][0].as_py() for c in ("gid", "block", "top"))
        digests, out = rows["digest"].to_pylist(), []
        for level in range(low + 1, min(low + STEP, top) + 1):
            digests = _parents(digests)
            first = block * ARITY ** (low + STEP - level)
            out += [(gid, level, first + k, d, top) for k, d in enumerate(digests)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["gid", "level", "at", "digest", "top"])

    return run


def _fall(low: int):
    """The block's rows with the path of each, its own siblings on the levels of the block and then the path of the node above, and the group's root."""

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        levels = [rows["digest"].to_pylist()]
        for _ in range(min(STEP, rows["top"][0].as_py() - low)):
            levels.append(_parents(levels[-1]))
        paths = [above["path"][0].as_py()]
        for nodes in levels[-2::-1]:
            here = []
            for k in range(len(nodes)):
                first = k - k % ARITY
                here.append(f"{''.join(nodes[first:k])},{''.join(nodes[k + 1 : first + ARITY])};{paths[k // ARITY]}")
            paths = here
        roots = [above["subroot"][0].as_py()] * len(paths)
        return rows.drop(["block"]).append_column("path", pa.array(paths, pa.string())).append_column("subroot", pa.array(roots, pa.string()))

    return run


@dataclass
class Tree:
    """Trees of several groups: level 0 (gid, at, digest, top, ...) and, for each STEP levels, the nodes above (gid, level, at, digest, top)."""

    base: DataFrame
    rounds: list[DataFrame]

    def tops(self) -> DataFrame:
        """(gid, top, digest) of each group's last node."""
        out = self.base.filter("top = 0").select("gid", "top", "digest")
        for nodes in self.rounds:
            out = out.unionByName(nodes.filter("level = top").select("gid", "top", "digest"))
        return out

    def paths(self, above: DataFrame, scratch: Scratch) -> DataFrame:
        """The rows of level 0 with path and subroot; above: (gid, top, path, subroot) of each group's last node."""
        upper = None
        for low in range(STEP * max(0, len(self.rounds) - 1), -1, -STEP):
            ends = above.filter((F.col("top") <= low + STEP) & ((F.col("top") > low) if low else F.lit(True))).select("gid", F.lit(0).cast("long").alias("block"), "path", "subroot")
            upper = ends if upper is None else ends.unionByName(upper.select("gid", F.col("at").alias("block"), "path", "subroot"))
            nodes = self.base if low == 0 else self.rounds[low // STEP - 1].filter((F.col("level") == low) & (F.col("top") > low)).select("gid", "at", "digest", "top")
            schema = ", ".join(f"`{n}` {t}" for n, t in nodes.dtypes) + ", path string, subroot string"
            found = nodes.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("gid", "block").cogroup(upper.groupBy("gid", "block")).applyInArrow(_fall(low), schema)
            upper = scratch.written(found) if low else found
        return upper


def grow(base: DataFrame, place: str) -> Tree:
    """The tree over base (gid, at, digest, top, ...), its nodes written below place, partitioned by level."""
    spark = base.sparkSession
    most = base.agg(F.max("top")).first()[0] or 0
    rounds, nodes = [], base
    for low in range(0, most, STEP):
        blocks = nodes.filter(F.col("top") > low).select("gid", "at", "digest", "top", F.floor(F.col("at") / BLOCK).alias("block"))
        made = blocks.groupBy("gid", "block").applyInArrow(_rise(low), _NODE)
        made.write.mode("overwrite").partitionBy("level").parquet(f"{place}/from={low}")
        rounds.append(spark.read.schema(made.schema).parquet(f"{place}/from={low}"))
        nodes = rounds[-1].filter(F.col("level") == low + STEP)
    return Tree(base, rounds)


@dataclass
class Manifest:
    """leaves of all groups, the tree over each group's leaves, the crown over the groups' roots, and the root of all."""

    groups: DataFrame
    tree: Tree
    crown: Tree
    root: str | None

    def proofs(self, scratch: Scratch) -> DataFrame:
        """Every leaf (gid, at, digest, ...) with subroot and path.

        A path has a part for each level, ended by a semicolon: the digests of the siblings ahead, a comma, those of the siblings behind.
        """
        ends = self.crown.tops().select("gid", "top", F.lit("").alias("path"), F.col("digest").alias("subroot"))
        above = self.crown.paths(ends, scratch).select(F.col("at").alias("gid"), F.col("digest").alias("subroot"), "path")
        return self.tree.paths(scratch.written(above.join(self.tree.tops().select("gid", "top"), "gid")), scratch)


def build_manifest(docs: DataFrame, fields: list[str], scratch: Scratch, id_col: str = "doc_id", group_col: str = "source", carry: Mapping[str, Column] | None = None) -> Manifest:
    """The manifest of docs: leaves are digests of fields, in the order of the id within a group, and equal ids in that of their digests.

    carry names further expressions over docs that stay with the leaves. Null ids come first, and null groups are one group, the first.
    Texts of any length are digested whole; repeated rows are leaves of their own; a table without rows has no root.
    """
    names = {"id": F.col(id_col), "group": F.col(group_col), "digest": leaf([F.col(f) for f in fields]), **(carry or {})}
    leaves = scratch.written(docs.select(*(v.alias(k) for k, v in names.items())))  # digests are made once; the sort reads its input twice
    rows, groups = numbered(leaves, "group", ["id", "digest"], scratch)
    base = scratch.written(rows.withColumn("top", _levels(F.col("n")).cast("int")).drop("n", "group"))
    tree = grow(base, f"{scratch.root}/nodes")
    count = groups.agg(F.count("*").alias("__all"))  # one row
    tops = tree.tops().select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("at"), "digest")
    crown = grow(scratch.written(tops.join(F.broadcast(count)).withColumn("top", _levels(F.col("__all")).cast("int")).drop("__all")), f"{scratch.root}/crown")
    root = crown.tops().first()
    return Manifest(groups, tree, crown, root.digest if root else None)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path lead to."""
    step = lambda acc, level: F.sha2(F.concat(F.substring_index(level, ",", 1), acc, F.substring_index(level, ",", -1)), 256)
    return F.aggregate(F.filter(F.split(path, ";"), lambda level: level != ""), digest, step)


def path_digest(path: Column) -> Column:
    """sha256 of a path's digests, from the leaf upwards and from left to right."""
    return F.sha2(F.translate(path, ",;", ""), 256)


def proven(docs: DataFrame, fields: list[str], claims: Mapping[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """(id, digest, subroot, root, path, and folded_<claim> of each claim): every row of docs under the manifest of all of them.

    claims are leaf digests to be proven in place of the row's own, which is claim "own" if none are given. See build_manifest for
    nulls, ties, repeated rows and empty tables; further columns are not read, whatever their names.
    """
    claims = dict(claims or {"own": leaf([F.col(f) for f in fields])})
    with Scratch(docs.sparkSession) as scratch:
        manifest = build_manifest(docs, fields, scratch, id_col, group_col, {f"claim_{k}": v for k, v in claims.items()})
        rows = manifest.proofs(scratch)
        out = rows.select("id", "digest", "subroot", F.lit(manifest.root).cast("string").alias("root"), "path", *(folded(F.col(f"claim_{k}"), F.col("path")).alias(f"folded_{k}") for k in claims))
        return written(out)
