"""A training-data pipeline over documents: quality, near duplicates, secrets, source mix, tokens.

Every stage takes all that the one before kept, written as Parquet and read again, and all but the last return the columns of
documents. Nulls, empty texts, repeated rows, empty tables and further columns are treated as each operator states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import bpe, mixing, ngram_join, quality, secrets
from veritrail.llm.shared import free_name, table, written

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more, by a model fitted on the labelled ones among them."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "__score")
    return quality.score_quality(docs, model, out=score).filter(F.col(score) >= 0.5).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of every group that links of shingle sets connect."""
    return ngram_join.keep_first(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars counted anew."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; small sources repeat, and none is left out."""
    plan = mixing.mix_sources(docs)
    return plan.withColumn(free_name(plan, "__copy"), F.explode(F.array_repeat(F.lit(0), F.col("mix_copies").cast("int")))).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with n_tokens, token_ids and whether these decode to the text."""
    coded = bpe.decode(bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("tokens.ids").cast("long").alias("n_tokens"), F.col("tokens.ids").alias("token_ids"), exact.alias("exact"))


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each_group), ("secrets", without_secrets), ("mix", mixed), ("tokens", tokens)]

#: No SQL: a fitted model decides the first stage. The tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
