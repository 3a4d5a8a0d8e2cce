"""What the corpus operators share: table access, numbering in order, batches between Spark and Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.functions.vectors import let
from veritrail.sources.storage import Scratch, deleted, new_place, shared_dir, written

__all__ = ["Scratch", "deleted", "free_name", "in_small_batches", "let", "new_place", "numbered", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, group: str, order: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """df with at, each row's place (from 0) in its group by order, and gid, the group's place among groups; and the groups (group, n, gid).

    Rows are sorted into runs of even size, each a range of (group, order), and written once; places are a run's offset in the group,
    summed over runs, and the line within it. Rows equal in all of these have any order. Null groups are a group, the first.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [F.col(group).asc_nulls_first(), *(F.col(o).asc_nulls_first() for o in order), F.col("__tie")]
    line = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the rows of a partition ahead
    runs = scratch.written(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*df.columns, F.spark_partition_id().alias("__run"), line.alias("__line")))
    parts = scratch.written(runs.groupBy(F.col("__run").alias("__r"), F.col(group).alias("__g")).agg(F.min("__line").alias("__first"), F.count("*").alias("__n")))
    ahead = Window.partitionBy("__g").orderBy("__r")  # a row for each run of a group
    offsets = parts.withColumn("__offset", F.sum("__n").over(ahead) - F.col("__n") - F.col("__first"))
    groups = parts.groupBy("__g").agg(F.sum("__n").alias("n"), F.min("__r").alias("__first_run"))
    # groups stand in the order of runs, and several of them within one run in the order of their values
    begun = groups.groupBy("__first_run").agg(F.count("*").alias("__begun"))
    begun = begun.withColumn("__ahead", F.sum("__begun").over(Window.orderBy("__first_run")) - F.col("__begun"))  # a row for each run
    within = F.row_number().over(Window.partitionBy("__first_run").orderBy(F.col("__g").asc_nulls_first()))
    groups = groups.join(begun, "__first_run").select("__g", "n", (F.col("__ahead") + within - 1).alias("gid"))
    groups = scratch.written(groups)
    facts = offsets.join(groups.withColumnRenamed("__g", "__h"), F.col("__g").eqNullSafe(F.col("__h"))).select("__r", "__g", "__offset", "gid", "n")
    rows = runs.join(facts, (F.col("__run") == F.col("__r")) & F.col(group).eqNullSafe(F.col("__g")))
    return rows.select(*df.columns, "gid", (F.col("__offset") + F.col("__line")).alias("at"), "n"), groups.withColumnRenamed("__g", group)


#: Rows and bytes of a batch between Spark and Python where rows carry whole texts; each batch is held several times on both sides.
TEXT_ROWS, TEXT_BYTES = 1000, 4 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches are cut to TEXT_ROWS rows and TEXT_BYTES if they may be larger; a longer text is a batch of its own.

    Spark reads these settings when a query starts, so they can't be set for one operator alone: they stay for the session, and smaller
    ones of the caller's are kept.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)):
        now = conf.get(name)
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(name, str(most))
    return df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until df has no such column, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
