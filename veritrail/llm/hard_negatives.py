"""Hard negatives by inner product, found with a pivot table.

A further coordinate makes all vectors equally long, and anchors get none, so that the greatest inner product is the least Euclidean
distance. A few rows are pivots, and the table keeps every row's distances to them. With an anchor's own distances the triangle
inequality brackets its score with a row, and with all rows of a block by the block's ranges; only what the brackets leave in play is
scored, in whole numbers. Anchors are the query set: they meet all rows in blocks of a fixed size, and each task returns the best few
of what it has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm.shared import Scratch, numbered, written

#: Pivots, the sample they are chosen from, anchors of one block (which is broadcast), and rows that are bracketed together.
PIVOTS, SAMPLE, ANCHORS, ROWS = 12, 1000, 2048, 1024
#: A component's number must be below this, and a row's squares must not sum up to this much, so that scores are long integers.
MOST_COMPONENT, MOST_SQUARES = 1 << 31, float(1 << 62)

SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: float = 256.0) -> DataFrame:
    """(id, label, q) of the rows that take part: id, label and vector are there, and every component is a finite number.

    q has floor(scale * x) of each component x. Vectors too long for scores in 64 bits take no part.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    fits = lambda x: F.coalesce(F.abs(F.floor(x * scale)) < MOST_COMPONENT, F.lit(False)) & ~F.isnan(x)
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & fits(x) & (F.abs(x) < float("inf"))))
    rows = rows.select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("q"))
    return rows.filter(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x) < MOST_SQUARES)


def chosen_pivots(sample: np.ndarray, most_squares: float, count: int) -> np.ndarray:
    """Rows of the sample with their further coordinate, each the farthest from those chosen before it."""
    points = np.column_stack([sample, np.sqrt(np.maximum(0.0, most_squares - (sample * sample).sum(axis=1)))])
    chosen, far = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(count, len(points)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.column_stack([np.linalg.norm(points - p, axis=1) for p in pivots])


def pivot_table(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, np.ndarray, float] | None:
    """The table (id, label, q, dist, cell, near) in ranges of (cell, near), the nearest pivot and its distance; the pivots; the greatest sum of squares.

    Vectors are as long as the longest, filled up with zeros. None if there are no rows.
    """
    squares = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    facts = rows.agg(F.max(F.size("q")).alias("size"), F.max(squares).alias("squares")).first()
    if facts.size is None:
        return None
    size, most = max(1, facts.size), facts.squares
    rows = rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0), F.lit(size) - F.size("q"))))
    sample = rows.select("q").orderBy(F.xxhash64("id", "q")).limit(SAMPLE).collect()  # bounded
    pivots = chosen_pivots(np.array([r.q for r in sample], float), most, PIVOTS)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch["q"], float)
            dist = _distances(np.column_stack([q, np.sqrt(np.maximum(0.0, most - (q * q).sum(axis=1)))]), pivots)
            kept = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * len(pivots), pa.int32()), pa.array(dist.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], batch["q"], kept, pa.array(dist.argmin(axis=1), pa.int32()), pa.array(dist.min(axis=1))], names=["id", "label", "q", "dist", "cell", "near"])

    table = rows.mapInArrow(measured, "id long, label long, q array<int>, dist array<double>, cell int, near double")
    return scratch.written(table.repartitionByRange("cell", "near", "id").sortWithinPartitions("cell", "near", "id")), pivots, most


class Search:
    """A block of anchors with slots, each of which wants the k best scores between its low and high, of its anchor's label or of others."""

    def __init__(self, anchors: list, pivots: np.ndarray, most: float, slots: dict[str, np.ndarray], k: int, same: bool):
        self.ids = np.array([a.id for a in anchors], np.int64)
        self.labels = np.array([a.label for a in anchors], np.int64)
        self.q = np.array([a.q for a in anchors], np.int64)
        exact = self.q.astype(float)
        self.dist = _distances(np.column_stack([exact, np.zeros(len(exact))]), pivots)
        norms = (exact * exact).sum(axis=1)
        self.sums = norms + most  # squared distance and twice the score add up to this
        self.slack = 0.5 + 1e-9 * self.sums
        self.floats = float(norms.max()) * most < 2.0**104  # then sums of products are exact in floating point
        self.slots, self.k, self.same = slots, k, same

    def _upper(self, at, least: np.ndarray) -> np.ndarray:
        return (self.sums[at] - least * least) / 2 + self.slack[at]

    def _lower(self, at, most: np.ndarray) -> np.ndarray:
        return (self.sums[at] - most * most) / 2 - self.slack[at]

    def found(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best (slot, score, id) of every slot among the rows of batches, equal scores by id."""
        owner, low, high = (self.slots[c] for c in ("anchor", "low", "high"))
        need = low.astype(float)  # grows to the k-th best score so far
        kept = [np.empty(0, np.int64)] * 3
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                part = batch.slice(k, ROWS)
                new = self._scored(part, owner, need, high)
                if new is None:
                    continue
                slot, score, row = (np.concatenate(x) for x in zip(kept, new, strict=True))
                order = np.lexsort((row, -score, slot))
                slot, score, row = slot[order], score[order], row[order]
                place = np.arange(len(slot)) - np.searchsorted(slot, slot, "left")
                full = place == self.k - 1
                need[slot[full]] = np.maximum(need[slot[full]], score[full])
                kept = [x[place < self.k] for x in (slot, score, row)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in kept], names=["slot", "score", "id"])

    def _scored(self, part: pa.RecordBatch, owner: np.ndarray, need: np.ndarray, high: np.ndarray):
        dist = _matrix(part["dist"], float)
        near, far = dist.min(axis=0), dist.max(axis=0)
        least = np.maximum(0.0, np.maximum(self.dist - far, near - self.dist).max(axis=1))
        every = np.arange(len(self.ids))
        up, down = self._upper(every, least), self._lower(every, (self.dist + far).min(axis=1))
        alive = np.flatnonzero((up[owner] >= need) & (down[owner] <= high))  # slots that this block may serve
        if not len(alive):
            return None
        at = np.unique(owner[alive])
        wants = np.full(len(self.ids), np.inf)
        np.minimum.at(wants, owner[alive], need[alive])
        bears = np.full(len(self.ids), -np.inf)
        np.maximum.at(bears, owner[alive], high[alive].astype(float))
        least, most = np.zeros((len(at), len(dist))), np.full((len(at), len(dist)), np.inf)
        for p in range(dist.shape[1]):
            mine, theirs = self.dist[at, p][:, None], dist[:, p][None, :]
            np.maximum(least, np.abs(mine - theirs), out=least)
            np.minimum(most, mine + theirs, out=most)
        ids, labels = part["id"].to_numpy(), part["label"].to_numpy()
        mask = (labels[None, :] == self.labels[at][:, None]) == self.same
        mask &= ids[None, :] != self.ids[at][:, None]
        mask &= self._upper(at[:, None], least) >= wants[at][:, None]
        mask &= self._lower(at[:, None], most) <= bears[at][:, None]
        rows = np.flatnonzero(mask.any(axis=0))
        if not len(rows):
            return None
        q = _matrix(part["q"], np.int64)[rows]
        scores = (self.q[at].astype(float) @ q.T.astype(float)).astype(np.int64) if self.floats else self.q[at] @ q.T
        mask, ids = mask[:, rows], ids[rows]
        line = np.searchsorted(at, owner[alive])
        out = []
        for k in range(0, len(alive), 256):  # bounded by slots times rows
            slots, mine = alive[k : k + 256], line[k : k + 256]
            s = scores[mine]
            hit = mask[mine] & (s >= need[slots][:, None]) & (s <= high[slots][:, None])
            i, j = np.nonzero(hit)
            out.append((slots[i], s[i, j], ids[j]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]


_FOUND = "slot long, score long, id long"
_LONG = np.iinfo(np.int64)


def _best(table: DataFrame, search: Search) -> DataFrame:
    """(slot, score, id, nth): the best of what the tasks return."""
    found = table.mapInArrow(search.found, _FOUND)
    nth = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= search.k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of anchors among rows (id, label, q); see quantised.

    An anchor's positives are its first rows of its own label and another id, by score and then by id. Of each of them the first rows
    of other labels are returned whose score times 100 lies between low and high times the positive's, ends included; columns are those
    of SCHEMA. Repeated rows stand each for itself, as anchors too. An anchor without positives or a positive without negatives has no
    row; an empty table gives none.
    """
    spark = rows.sparkSession
    with Scratch(spark) as scratch:
        made = pivot_table(scratch.written(rows.select("id", "label", "q")), scratch)
        if made is None:
            return spark.createDataFrame([], SCHEMA)
        table, pivots, most = made
        anchors, groups = numbered(table.filter(is_anchor).select("id", "label", "q", "cell", "near", F.lit(0).alias("all")), "all", ["cell", "near", "id"], scratch)
        anchors = scratch.written(anchors.select("id", "label", "q", "at"))
        count = groups.first()
        empty, place = spark.createDataFrame([], SCHEMA), f"{scratch.root}/found"
        for first in range(0, count.n if count else 0, ANCHORS):
            block = anchors.filter((F.col("at") >= first) & (F.col("at") < first + ANCHORS)).collect()  # of a fixed size
            written(_of_block(table, block, pivots, most, positives, negatives, low, high), f"{place}/block={first}")
        return written(spark.read.schema(empty.schema).parquet(place).select(empty.columns) if count else empty)


def _of_block(table: DataFrame, block: list, pivots: np.ndarray, most: float, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    n = len(block)
    every = {"anchor": np.arange(n), "low": np.full(n, _LONG.min), "high": np.full(n, _LONG.max)}
    near = _best(table, Search(block, pivots, most, every, positives, same=True)).collect()  # the positives of one block of anchors
    score = [int(r.score) for r in near]
    bands = {
        "anchor": np.array([r.slot for r in near], np.int64),
        "low": np.array([-(-low * s // 100) for s in score], np.int64),
        "high": np.array([high * s // 100 for s in score], np.int64),
    }
    spark = table.sparkSession
    if not near:
        return spark.createDataFrame([], SCHEMA)
    facts = spark.createDataFrame([(k, block[r.slot].id, r.id, r.score) for k, r in enumerate(near)], "slot long, anchor_id long, positive_id long, positive_score long")
    found = _best(table, Search(block, pivots, most, bands, negatives, same=False))
    rows = found.join(F.broadcast(facts), "slot")  # positives of one block of anchors
    return rows.select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
