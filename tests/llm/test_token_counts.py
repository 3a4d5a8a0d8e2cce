import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veritrail.llm import token_counts
from veritrail.llm.queries import op5_token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "e", "th", "the", "  ", "\n", " ", "é", "é", "漢字", "🎉", "0", "12", "'", "'s", "'re", "'r", "'l", "'ll", "'v", "<|endoftext|>", "<|startoftext|>", "ing", "!!", "...", "İ", "Σ", "THE", "ß", "\x00", "​", "\x1c", "xqz"]


@pytest.fixture(scope="module")
def transducer():
    return token_counts.Transducer(open(PATH).read())


def test_counts_equal_the_library(transducer):
    library, pick = Tokenizer.from_file(PATH), random.Random(7)
    texts = ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(chr(pick.choice([pick.randint(0, 0x2FF), pick.randint(0x300, 0xD7FF), pick.randint(0x1F300, 0x1F9FF)])) for _ in range(8)) for _ in range(2000)]
    for text in texts:
        assert transducer.count(text, pick.choice([1, 3, 7, 100])) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_chunk_maps_compose_in_any_grouping(transducer):
    text = "the things it's 12 don't antidisestablishment!!! " * 3 + "x" * 40
    a, b, c = (transducer.chunk_map(t) for t in (text[:37], text[37:90], text[90:]))
    left, right = transducer.compose(transducer.compose(a, b), c), transducer.compose(a, transducer.compose(b, c))
    assert (left.head, left.rest[0]) == (right.head, right.rest[0]) and left.rest[1] is right.rest[1]
    assert [m.head for m in transducer.scanned([a, b, c])][-1] == left.head


def test_memory_bound_keeps_counts(transducer, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_MOVES", 50)
    small = token_counts.Transducer(open(PATH).read())
    assert [small.count(t) for t in ("the cat", "strange words follow", "the cat")] == [transducer.count(t) for t in ("the cat", "strange words follow", "the cat")]


def test_query_equals_the_library(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    rows = [(1, None, 0), (2, "", 0), (2, "It's " + "word " * 3000, 0), (2, "It's " + "word " * 3000, 0), (None, "z", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in op5_token_counts(spark, str(tmp_path)).collect())
    expected = [len((t or "").encode()) for _, t, _ in rows], [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows]
    assert got == sorted((b, n, n > 2048) for b, n in zip(*expected, strict=True))
    assert token_counts.count_tokens(spark.createDataFrame([], "text string"), PATH).count() == 0
