"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that shuffle files go as soon as the query that wrote them ends, not when the driver collects garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one only on a local master."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    at = tempfile.mkdtemp(prefix="veritrail")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_place(spark: SparkSession) -> str:
    """A path in the shared folder that nothing has."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


#: Tables of this process that no Scratch deletes.
_LEFT: list[str] = []


def written(df: DataFrame, at: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and a lost executor costs only its own tasks.

    The write's shuffle files are dropped at its end, as nothing reads them after it. A table that stands at the given path is
    replaced; df must not read it.
    """
    spark = df.sparkSession
    if at is None:
        at = new_place(spark)
        _LEFT.append(at)
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(at)


def deleted(spark: SparkSession, at: str) -> None:
    """Removes a folder of intermediate tables, in whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def delete_left(spark: SparkSession) -> None:
    """Deletes the tables that written() has made so far outside a Scratch; for a caller that has taken all results that read them."""
    while _LEFT:
        deleted(spark, _LEFT.pop())


class Scratch:
    """Intermediate tables of one job: written like written(), and deleted when dropped or when the job ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.places = spark, new_place(spark), {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        deleted(self.spark, self.root)

    def written(self, df: DataFrame) -> DataFrame:
        at = f"{self.root}/{len(self.places)}"
        out = written(df, at)
        self.places[id(out)] = (at, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in frames:
            deleted(self.spark, self.places[id(df)][0])
