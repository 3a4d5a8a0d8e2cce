"""The registered queries of the corpus operators, one for each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import bpe, exact_dedup, hard_negatives, merkle, mixing, mpeg, ngram_join, order_minhash, pii, quality, secrets, token_counts, urls
from veritrail.llm.shared import table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The key of pseudonyms; a deployment passes its own.
PSEUDONYM_KEY = "veritrail"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s.kind.isin(*(r.kind for r in secrets.BASE_RULES)))
    count = lambda kind: F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return docs.select("doc_id", *(count(r.kind) for r in secrets.BASE_RULES), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY)
    return coded.select("doc_id", F.size("tokens.ids").cast("long").alias("n_tokens"), F.sha2("tokens.packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    parsed = mpeg.parse_column(mpeg.encode_column(docs, "data"))
    back = F.col("audio.payload")
    feature = F.concat_ws(
        ";",
        *(F.concat(F.lit(f"{k}="), F.col(f"audio.{k}").cast("string")) for k in ("hertz", "samples", "duration_num", "duration_den", "table_frames", "crc_checked", "crc_failed", "bytes_skipped", "tags", "vbr_table")),
        F.concat(F.lit("tag_texts="), F.array_join(F.transform("audio.tag_texts", lambda t: F.concat(t["name"], F.lit(":"), t["value"])), ",")),
        F.concat(F.lit("seek_sha256="), F.sha2(F.array_join("audio.seek_points", ","), 256)),
        F.concat(F.lit("offsets_sha256="), F.sha2(F.array_join("audio.frame_offsets", ","), 256)),
    )
    return parsed.select(
        "doc_id",
        F.octet_length("data").cast("long").alias("n_bytes"),
        F.octet_length(back).cast("long").alias("payload_bytes"),
        F.sha2(back, 256).alias("payload_sha256"),
        F.crc32(F.substring(back, -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality.score_quality(docs, model, out="score")
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_tokens", "mix_weight", "mix_copies", "mix_block", "mix_order", "mix_orders")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = order_minhash.with_next(docs, "doc_id", ["text"], {"fingerprint": order_minhash.fingerprint(F.col("text"))})
    n = F.length("text")
    edited = F.concat(F.left("text", n - F.floor(n / 2)), F.left("next_text", F.floor(n / 2)))
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    docs = order_minhash.add_fingerprint(docs, "edited", "edited_fingerprint")
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.as_text(F.col("fingerprint")).alias("fingerprint"),
        order_minhash.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        order_minhash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    count = lambda kind: F.size(F.filter("pii_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return docs.select("doc_id", *map(count, pii.KINDS), "text")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_TOKENIZER)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*fields)
    tampered = [*map(F.col, fields[:-1]), F.translate("text", "\n", "")]
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 1
    claim = F.when(odd, merkle.leaf([F.col(f) for f in fields])).otherwise(merkle.leaf(tampered))
    rows = merkle.proven(docs, fields, {"tampered": claim})
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        merkle.path_digest(F.col("path")).alias("proof_sha256"),
        F.col("folded_tampered").alias("folded_root"),
        (F.col("folded_tampered") == F.col("root")).alias("verified"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.quantised(rows, "vec_id", "embedding", label), F.col("id") % 50 == 0)
