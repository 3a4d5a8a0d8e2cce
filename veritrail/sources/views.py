"""The tables of the benchmark, seen as the engine's objects, with the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.scalars import fold
from veritrail.sources.tables import table


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows: event_id, dataset, cluster, risk, error."""
    risk = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("dataset"), F.col("user_id").alias("cluster"), risk.alias("risk"), F.col("value").alias("error"))


EVENTS = "ev AS (SELECT event_id, event_type AS dataset, user_id AS cluster, CAST(regexp_extract(props, ': *([0-9]+)', 1) AS DOUBLE) AS risk, value AS error FROM events)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of five vectors: task, member (0: the truth), v."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 5).alias("task"), (F.col("vec_id") % 5).alias("member"), "vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


VECTORS = "vec AS (SELECT vec_id // 5 AS task, vec_id % 5 AS member, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(task, member, position, prediction) and (task, position, truth)."""
    long = vectors(spark, sf_dir).select("task", "member", F.posexplode("v").alias("position", "x"))
    return long.filter("member > 0").withColumnRenamed("x", "prediction"), long.filter("member = 0").select("task", "position", F.col("x").alias("truth"))


LONG = VECTORS + ", long AS (SELECT task, member, i AS position, v[i] AS x FROM vec, range(1, 65) t(i)), pred AS (SELECT task, member, position, x AS prediction FROM long WHERE member > 0), truth AS (SELECT task, position, x AS truth FROM long WHERE member = 0)"


#: Rows of a task that joins cells, about; the least rows of tables that are dealt so, and of those they join, which smaller Spark broadcasts.
JOIN_ROWS, DEALT_ROWS, BROAD_ROWS = 1 << 19, 1 << 23, 2_000_000


def _dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    """rows, n of them, dealt by key to as many tasks as keep a task at JOIN_ROWS rows; the session's number of partitions does not grow with the rows."""
    if n < DEALT_ROWS:
        return rows
    return rows.repartition(max(-(-n // JOIN_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: cell, context, perturbation, batch, gene, x."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined, n = line, line.count()  # of the files' footers
    for other, key, its in ((order, "l_orderkey", "o_orderkey"), (customer, "o_custkey", "c_custkey"), (part, "l_partkey", "p_partkey")):
        joined = (_dealt(joined, key, n) if other.count() >= BROAD_ROWS else joined).join(other, F.col(key) == F.col(its))
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cell"),
        F.col("c_mktsegment").alias("context"),
        F.col("p_brand").alias("perturbation"),
        F.col("o_orderpriority").alias("batch"),
        F.concat("l_returnflag", "l_linestatus").alias("gene"),
        F.col("l_quantity").cast("double").alias("x"),
    )


CONTROL = "Brand#1"
CELLS = """cells AS (SELECT l_orderkey || '-' || l_linenumber AS cell, c_mktsegment AS context, p_brand AS perturbation, o_orderpriority AS batch,
    l_returnflag || l_linestatus AS gene, CAST(l_quantity AS DOUBLE) AS x
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""


def splits(df: DataFrame, key: str) -> DataFrame:
    """df with split: six in ten train, two val, two test, by hash of the key."""
    k = fold(F.sha2(F.col(key).cast("string"), 256), 10)
    return df.withColumn("split", F.when(k < 6, "train").when(k < 8, "val").otherwise("test"))


def fold_sql(key: str, n: int) -> str:
    return f"(CAST(concat('0x', substr(sha256(CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) % {n})"


def split_sql(key: str) -> str:
    return f"CASE WHEN {fold_sql(key, 10)} < 6 THEN 'train' WHEN {fold_sql(key, 10)} < 8 THEN 'val' ELSE 'test' END"
