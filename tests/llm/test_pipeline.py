import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken
from test_ngram_join import brute

import corpus_pipeline
from veritrail.llm import bpe, quality
from veritrail.llm.queries import op1_secret_scan, op3_ngram_jaccard, op4_byte_bpe

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = documents(spark)
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {i for i, r in rows.items() if model.score(np.array([quality.features(r.text)]))[0] >= 0.5}
    first = brute([(i, rows[i].text) for i in good])
    kept = {i for i, (_, root) in first.items() if root == i}
    frame, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns
        frame.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage_{name}")
        frame = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/stage_{name}")
        seen.append([r.doc_id for r in frame.collect()])
    assert [set(s) for s in seen] == [good, kept, kept, kept]
    assert not re.search(r"token = \"[0-9a-f]{24,}", " ".join(r.text for r in frame.collect()))
    assert all(r.n_chars == len(r.text) for r in frame.collect())
    final = corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(bpe.read_ranks(corpus_pipeline.VOCABULARY))}, special_tokens={})
    texts = {r.doc_id: r.text for r in frame.collect()}
    assert all(r.exact and r.token_ids == library.encode_ordinary(texts[r.doc_id]) for r in final)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in final)


def test_stages_take_an_empty_table_and_more_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).selectExpr("*", "1 as mix_copies", "2 as component_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_queries_against_plain_python(spark):
    rows = documents(spark)
    expected = brute([(i, r.text) for i, r in rows.items()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op3_ngram_jaccard(spark, SF).collect()} == expected
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(bpe.read_ranks(corpus_pipeline.VOCABULARY))}, special_tokens={})
    for r in op4_byte_bpe(spark, SF).collect():
        text = rows[r.doc_id].text or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    for r in op1_secret_scan(spark, SF).collect():
        hexes = [m for m in re.finditer("[0-9a-f]+", rows[r.doc_id].text or "") if len(m[0]) >= 24]
        assert r.n_hex == len(hexes)


def test_stages_take_nulls_repeats_and_very_long_texts(spark, tmp_path):
    """Every stage on rows without values, repeated rows and a text of 20 MB, with columns named like its own."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    long = " ".join(f"word{k % 997} filler{k % 31}" for k in range(1_500_000))
    odd = [(None, "a text without an id but with quite a few words in it", None, None, None), (900_001, None, "en", "src0", 0), (900_002, "", None, "src1", 0), (900_003, long, "en", "src0", len(long)), (900_004, f"token = abcdef0123456789 {long}", "en", None, None)]
    repeated = base.limit(5).unionByName(base.limit(5))
    docs = base.unionByName(repeated).unionByName(spark.createDataFrame(odd, base.schema)).selectExpr("*", "'own' as __score", "'own' as __first", "'own' as __copy", "'own' as mix_order")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == names, name
        frame.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
    rows = frame.select("doc_id", "text", "n_chars", "__score", "__first", "__copy").collect()
    assert all(r["__score"] == r["__first"] == r["__copy"] == "own" for r in rows)
    assert len({r.doc_id for r in rows}) == len({(r.doc_id, r.text) for r in rows})  # of repeated rows one stays, though the mix may take it twice
    assert not any("abcdef0123456789" in (r.text or "") for r in rows)
    final = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).select("doc_id", "exact", "n_tokens").collect()
    assert len(final) == len(rows) and all(r.exact for r in final)
