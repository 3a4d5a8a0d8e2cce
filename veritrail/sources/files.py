"""Readers and writers: typed CSV, append-only releases, hash manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """A CSV or TSV with a header; types are given, never inferred, and empty fields and NA stay text."""
    rows = spark.read.schema(schema).csv(path, header=True, sep=sep, nullValue="\0", emptyValue="", enforceSchema=False)
    return rows.fillna("", [f.name for f in schema if f.dataType == T.StringType()])  # Spark reads an empty field as null


def read_vectors(spark: SparkSession, path: str, length: int) -> DataFrame:
    """(key, v) of a Parquet store of vectors; the job fails on a vector of another length or with a value that isn't finite."""
    rows = spark.read.parquet(path)
    right = (F.size("v") == length) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fail = F.raise_error(F.concat(F.lit("bad vector "), F.col("key").cast("string"))).cast("boolean")
    return rows.filter(F.when(F.coalesce(right, F.lit(False)), True).otherwise(fail))


def write_release(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Write once; a release that exists is never touched. Spark's commit makes it appear whole or not at all."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_files(now: DataFrame, then: DataFrame) -> DataFrame:
    """(path, change) of two manifests: added, removed or changed."""
    old = then.select("path", F.col("sha256").alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("sha256").isNull(), "removed").when(F.col("old") != F.col("sha256"), "changed")
    return now.join(old, "path", "full").select("path", change.alias("change")).filter("change is not null")
