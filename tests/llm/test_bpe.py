import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from veritrail.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
PARTS = ["a", "th", "  ", "\n", " ", "é", "漢字", "🎉", "0", "12", "'s", "<unk>", "▁", "⁇", "\x00", "İ", "<|endoftext|>", "ing", "!!", "₞", "׈"]


@pytest.fixture(scope="module")
def both():
    tokens = bpe.read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    return bpe.Codec(tokens, PATTERN), library


def test_ids_equal_the_library(both):
    codec, library = both
    pick = random.Random(5)
    texts = ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 20))) for _ in range(3000)]
    texts += ["".join(chr(pick.choice([pick.randint(0, 0x2FF), pick.randint(0x300, 0xD7FF), pick.randint(0x1F300, 0x1F9FF)])) for _ in range(8)) for _ in range(3000)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_long_words(both):
    codec, library = both
    text = "ab" * 20_000 + " " + "漢" * 3000
    assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "the thing é", "z"), (2, "the thing é", "z"), (None, " ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    out = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH)
    assert out.columns == [*docs.columns, "decoded"]
    assert sorted(bytes(r.decoded).decode() for r in out.collect()) == ["", "", " ", "the thing é", "the thing é"]
    assert all(len(r.tokens.packed) == 4 * len(r.tokens.ids) for r in out.collect())
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0
