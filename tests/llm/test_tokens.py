import random

import public_tokenizers
import pytest

from tests.llm.helpers import empty, odd
from wearline.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def counter():
    return tokens.PieceCounter(PATH)


def test_the_proof_holds_and_covers_words(counter):
    assert counter.splits and counter.whole["the"] == 1
    assert all(len(counter.model.encode(w)) == 1 for w in list(counter.whole)[:500])


def test_counts_equal_the_library(counter):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "the", "Th", "é", "▁", "\t", "\r\n", "😀", ",", "<s>", "</s>", "<unk>", "12", "\x00", "ﬁ", "é"]
    texts = ["", " ", "a ", "\n", "a" * 3000, " a\n b ", "▁"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    assert [counter.count(t) for t in texts] == [len(i) for i in counter.model.encode(texts)]


def test_a_small_cache_counts_alike(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 3)
    small = tokens.PieceCounter(PATH)
    text = " ".join(f"wörd{i} thing{i % 7}\nstart{i}" for i in range(300))
    assert small.count(text) == len(small.model.encode(text)) == small.count(text)


def test_edge_rows(spark, counter):
    got = tokens.count_tokens(odd(spark), PATH, limit=20)
    for r in got.collect():
        text = r["text"] or ""
        assert r["n_bytes"] == len(text.encode()) and r["n_tokens"] == len(counter.model.encode(text))
        assert r["over_limit"] == (r["n_tokens"] > 20)
    assert tokens.count_tokens(empty(spark), PATH).count() == 0
