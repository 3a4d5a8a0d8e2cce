"""Prediction records: joins with their features and an ontology of data sets, samples of tasks, similar names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veritrail.operators.contracts import strict_boolean, validated_join
from veritrail.sources.files import read_csv
from veritrail.sources.storage import written

#: What identifies a record, and the flags of an ontology.
MERGE_KEYS = ["record_id", "task_id", "task_key", "dataset_name", "fold_id", "split", "context", "perturbation", "predictor_name"]
FLAGS = ("include_in_gene_perturbation_evidence", "include_in_chemical_evidence", "include_in_cytokine_stimulation_evidence")
ONTOLOGY = ("dataset_name", "as_run_scoring_family", "source_modality", "perturbation_unit", *FLAGS, "chemical_exposure_contract_status", "ontology_status", "rationale")


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """A row for each data set, flags as booleans; an empty name, a repeated one or a flag that is no boolean fails the job.

    Names are read without blanks around them. The table is small, a row for each data set, and is written once it is checked.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ONTOLOGY])
    rows = read_csv(spark, path, schema).withColumn("dataset_name", F.trim("dataset_name"))
    counted = rows.withColumn("__n", F.count("*").over(Window.partitionBy("dataset_name")))
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col("dataset_name"))).cast("boolean")
    right = F.when(F.col("dataset_name") == "", fail("an empty data set name")).when(F.col("__n") > 1, fail("a repeated data set: ")).otherwise(True)
    return written(counted.filter(right).drop("__n").withColumns({c: strict_boolean(F.col(c)) for c in FLAGS}))


def merged_records(records: DataFrame, features: DataFrame, families: DataFrame | None = None, keys: list[str] | None = None, dataset: str = "dataset_name") -> DataFrame:
    """records with the features of the same keys, and dataset_family from families (dataset, family); unknown sets are of family "other".

    Records without features stay. Several feature rows of one record fail the job, as do columns that both sides have besides the keys.
    """
    keys = keys or MERGE_KEYS
    if both := sorted((set(records.columns) & set(features.columns)) - set(keys)):
        raise ValueError(f"columns of records and features: {both}")
    out = validated_join(records, features, keys, "left", unique="right")
    if families is None:
        return out
    named = families.select(F.col(dataset).alias("__set"), F.col("family").alias("dataset_family"))
    joined = out.join(named, F.col(dataset) == F.col("__set"), "left").drop("__set")
    return joined.withColumn("dataset_family", F.coalesce("dataset_family", F.lit("other")))


def sampled_tasks(rows: DataFrame, context: list[str], key: str, most: int, seed: str) -> DataFrame:
    """The first most rows of each context in a hash order of key: a sample that does not depend on how rows are stored.

    Each task keeps its own first rows before anything is shuffled. Equal keys of a context have any order; give a key that is unique.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    drawn = rows.withColumn("__digest", digest)
    nth = F.row_number().over(Window.partitionBy(*context).orderBy("__digest", key))
    return drawn.withColumn("__nth", nth).filter(F.col("__nth") <= most).drop("__digest", "__nth")


def gram_set(text: Column, n: int = 3) -> Column:
    """The distinct n-grams of characters; a shorter text is its own gram, and null or an empty text has none."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).when(F.length(text) < n, F.array(text)).otherwise(grams)


def similar_texts(texts: DataFrame, text: str, least: float, n: int = 3) -> DataFrame:
    """(a, b, jaccard) of distinct texts a < b whose sets of n-grams have at least that Jaccard similarity, which is above zero.

    Texts are compared only if they share one of their rarest grams, as many as a similar text cannot lack all of.
    """
    sets = written(texts.select(F.col(text).alias("t")).distinct().withColumn("g", gram_set(F.col("t"), n)).filter(F.size("g") > 0))
    often = sets.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("f"))
    long = sets.select("t", F.size("g").alias("n"), F.explode("g").alias("gram")).join(often, "gram")
    ordered = long.groupBy("t", "n").agg(F.array_sort(F.collect_list(F.struct("f", "gram"))).alias("s"))  # a text's grams
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1
    heads = written(ordered.select("t", F.explode(F.slice("s", F.lit(1), prefix.cast("int"))).alias("s")).select("t", F.col("s.gram").alias("gram")))
    pairs = heads.alias("x").join(heads.alias("y"), "gram").filter("x.t < y.t").select(F.col("x.t").alias("a"), F.col("y.t").alias("b")).distinct()
    of = lambda c, g: sets.select(F.col("t").alias(c), F.col("g").alias(g))
    both = pairs.join(of("a", "ga"), "a").join(of("b", "gb"), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return both.select("a", "b", (common / (F.size("ga") + F.size("gb") - common)).alias("jaccard")).filter(F.col("jaccard") >= least)
