"""Exact deduplication by an extendible-hash index on shared files, with DataFrame functions only.

A document's key is a 64-bit hash of its text without blanks. The index is a directory over the leading bits of keys and a table of
buckets: a bucket of depth d holds the keys that share d leading bits, and one that is overfull is split by its next bit, which
doubles the directory wherever the bucket was as deep as that. Owner tasks each hold a range of consecutive buckets, sorted by key;
entries of one key with different texts are chained. Texts are compared in bytes, after each task has reduced its own copies to one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm.shared import Scratch, written

#: Entries of a bucket beyond which it is split, and bits a directory may have beyond those that even buckets need.
CAPACITY, SPARE_BITS = 20_000, 4
#: The blanks that normalised texts lack: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def directory(keys: DataFrame, capacity: int = CAPACITY, spare_bits: int = SPARE_BITS) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) for each slot of the directory that has keys (key, a long), and the directory's bits.

    A slot's bucket has the least depth at which no more than capacity keys share its leading bits; its number is its first slot. What
    stays overfull in a single slot, as keys that are all equal do, is a bucket of its own, whose chains are longer.
    """
    total = keys.count()
    bits = spare_bits + max(1, (max(total, 1) // capacity).bit_length())
    slot = F.shiftrightunsigned("key", 64 - bits)
    cells = keys.groupBy(slot.alias("slot")).agg(F.count("*").alias("load"))
    depths = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    # the load of every bucket that the doubling passes through, from that of slots
    prefix = F.expr(f"shiftleft(shiftright(slot, {bits} - depth), {bits} - depth)")
    loads = depths.groupBy(prefix.alias("bucket"), "depth").agg(F.sum("load").alias("load"))
    fits = loads.filter((F.col("load") <= capacity) | (F.col("depth") == bits)).select("bucket", "depth")
    slots = depths.select("slot", "depth", prefix.alias("bucket")).join(fits, ["bucket", "depth"])
    return slots.groupBy("slot").agg(F.min("depth").alias("depth")).select("slot", F.expr(f"shiftleft(shiftright(slot, {bits} - depth), {bits} - depth)").alias("bucket"), "depth"), bits


@dataclass
class Index:
    """buckets: (bucket, key, digest, chain, keep_id, keep_row, group_size), one row for each distinct text, in ranges of buckets."""

    slots: DataFrame
    bits: int
    buckets: DataFrame

    def placed(self, entries: DataFrame) -> DataFrame:
        """entries (key, ...) with the bucket that the directory names; keys whose slot is empty have none."""
        return entries.withColumn("slot", F.shiftrightunsigned("key", 64 - self.bits)).join(self.slots.select("slot", "bucket"), "slot", "left").drop("slot")

    def probe(self, entries: DataFrame) -> DataFrame:
        """entries (key, digest, ...) with keep_id, keep_row and group_size of their text; null where the index lacks it."""
        return self.placed(entries).join(self.buckets, ["bucket", "key", "digest"], "left").drop("bucket", "chain")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=F.xxhash64, digest=None) -> DataFrame:
    """(row, id, n_chars, norm, key, digest) of each document; row tells rows apart while the table is read once."""
    digest = digest or (lambda text: F.sha2(text, 256))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_chars"),
        normalised(F.col(text_col)).alias("norm"),
    )
    return rows.select("row", "id", "n_chars", "norm", key(F.col("norm")).alias("key"), digest(F.col("norm")).alias("digest"))


def build_index(entries: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> Index:
    """The index of entries (row, id, n_chars, key, digest): the entry of most characters, then of the least id, stands for its text.

    Copies are summed up by length before they meet, so a group of any size reaches its owner as a few rows.
    """
    first = F.min(F.struct(F.col("id").isNull(), "id", "row"))
    lengths = entries.groupBy("key", "digest", "n_chars").agg(first.alias("first"), F.count("*").alias("n"))
    texts = lengths.groupBy("key", "digest").agg(F.max_by("first", "n_chars").alias("first"), F.sum("n").alias("group_size"))
    texts = scratch.written(texts.select("key", "digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"))
    slots, bits = directory(texts.select("key"), capacity)
    index = Index(scratch.written(slots), bits, texts)
    owned = index.placed(texts).repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "digest")
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("digest"))  # the texts of one 64-bit key
    index.buckets = scratch.written(owned.select("bucket", "key", "digest", chain.alias("chain"), "keep_id", "keep_row", "group_size"))
    scratch.drop(texts)
    return index


def told_apart(entries: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """entries, with the text behind the digest where texts of different bytes share key and digest; rows are those of keyed().

    Each task first reduces its rows to distinct texts, comparing bytes, so that copies don't gather in one place.
    """
    distinct = rows.groupBy("key", "digest", "norm").agg(F.count("*").alias("n"))
    shared = scratch.written(distinct.groupBy("key", "digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("key", "digest"))
    if shared.isEmpty():  # as always with the hashes given by default
        return entries
    marked = rows.join(shared.withColumn("shared", F.lit(True)), ["key", "digest"], "left")
    apart = F.when(F.col("shared"), F.concat_ws(":", "digest", "norm")).otherwise(F.col("digest"))
    return scratch.written(marked.select("row", "id", "n_chars", "key", apart.alias("digest")))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key=F.xxhash64, digest=None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row for each row of docs.

    Texts are equal if they are so without their blanks; of equal ones the row of most code points, then of the least id, stays. A
    null text counts as empty, and empty texts equal each other. Of repeated rows that agree in id and length one stays. A null id
    comes after all others. Texts of any length are hashed and compared whole. Further columns are not read, whatever their names.
    An empty table gives no rows. key and digest may be weaker hashes: texts that share both are told apart by their bytes, and
    text_sha256 is then the digest given.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = keyed(docs, id_col, text_col, key, digest)
        entries = scratch.written(rows.select("row", "id", "n_chars", "key", "digest"))
        entries = told_apart(entries, rows, scratch)
        found = build_index(entries, scratch, capacity).probe(entries)
        kept = F.col("row") == F.col("keep_row")
        return written(found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.substring_index("digest", ":", 1).alias("text_sha256")))
