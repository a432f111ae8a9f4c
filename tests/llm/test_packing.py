import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import DOCS, empty, odd
from wearline.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    rng = random.Random(6)
    parts = ["the ", "It's", "don't ", "  ", "\n", "É", "é", "ΣΑΣ ", "ß", "1234", "!?", "😀", "\x1c", "\x85", "\xa0", " ", "\x00", "<|endoftext|>", "İ", "_", "東京"]
    own = packing.WordEncoder(PATH)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids_of(library, text), repr(text)


def check(rows, docs, library, length):
    """Every id once, in order; sequences without gaps, all full but the last."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    want = defaultdict(list)
    for i, text in docs:
        want[i].append(ids_of(library, text) + [2])
    for i, texts in want.items():
        pieces = sorted(by_doc[i], key=lambda r: (r["start"], r["ids"]))
        assert sum(r["length"] for r in pieces) == sum(map(len, texts))
        if len(texts) == 1:
            assert [x for r in pieces for x in r["ids"]] == texts[0]
            assert {r["doc_tokens"] for r in pieces} == {len(texts[0])}
    assert set(by_doc) == set(want)
    for k, places in by_sequence.items():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at == length or k == max(by_sequence)


@pytest.mark.parametrize("length", [16, 64])
def test_round_trip_and_proportions(spark, library, length):
    rng = random.Random(length)
    docs = [(i, " ".join(rng.choice(("the", "big", "elephants", "xyzzy")) for _ in range(rng.randrange(0, 90))), "en",
             rng.choices(["hot", "mid", None], (6, 3, 1))[0], 1) for i in range(300)]
    frame = spark.createDataFrame(docs, DOCS).repartition(5)
    rows = packing.pack(frame, PATH, length=length, per_window=8).collect()
    check(rows, [(r[0], r[1]) for r in docs], library, length)
    total = Counter()
    for r in rows:
        total[r["source"]] += r["length"]
    every = sum(total.values())
    windows = defaultdict(Counter)
    for r in rows:
        windows[r["sequence_id"] // 8][r["source"]] += r["length"]
    last = max(windows)
    for w, found in windows.items():
        if w < last:
            assert all(abs(found[s] - 8 * length * total[s] / every) <= 2 * len(total) + 1 for s in total)


def test_given_weights_steer_the_first_windows(spark, library):
    docs = [(i, "the big dog " * 10, "en", "ab"[i % 2], 1) for i in range(80)]
    rows = packing.pack(spark.createDataFrame(docs, DOCS), PATH, 32, per_window=4, weights={"a": 3.0, "b": 1.0}).collect()
    check(rows, [(r[0], r[1]) for r in docs], library, 32)
    first = Counter()
    for r in rows:
        if r["sequence_id"] < 4:
            first[r["source"]] += r["length"]
    assert abs(first["a"] - 96) <= 1 and abs(first["b"] - 32) <= 1


def served(rows, length):
    """(tokens of all, tokens by source) after each piece in the order of the sequences."""
    by, out = Counter(), []
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        by[r["source"]] += r["length"]
        out.append((r["sequence_id"] * length + r["offset"] + r["length"], Counter(by)))
    return out


def check_shares(rows, length, weights, window):
    """Each queue has its share of what queues with tokens left get, from the first window to the last."""
    total = Counter()
    for r in rows:
        total[r["source"]] += r["length"]
    level, ends = 0.0, sorted(total, key=lambda s: total[s] / weights[s])
    for at, by in served(rows, length):
        assert at == sum(by.values())
        # The level at which the queues together have served as much.
        left = at
        for i, s in enumerate(ends):
            active = sum(weights[x] for x in ends[i:])
            level = (left - sum(total[x] for x in ends[:i])) / active
            if level <= total[s] / weights[s]:
                break
        for s in total:
            assert abs(by[s] - min(total[s], level * weights[s])) <= window + len(total)


def test_repeating_shares_hold_until_queues_end_and_after(spark, library):
    counts = {"a": 40, "b": 70, "c": 30, "é": 50, None: 20}
    shares = {"a": 5, "b": 2, "c": 1, "é": 5, None: 2}
    docs = [(i, "the big dog " * (1 + i % 7), "en", s, 1) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    frame = spark.createDataFrame(docs, DOCS).repartition(6)
    rows = packing.pack(frame, PATH, 32, per_window=2, weights=(5, 2, 1)).collect()
    check(rows, [(r[0], r[1]) for r in docs], library, 32)
    check_shares(rows, 32, shares, 64)
    with pytest.raises(AssertionError):
        check_shares(packing.pack(frame, PATH, 32, per_window=2).collect(), 32, shares, 64)
    with pytest.raises(ValueError):
        packing.pack(frame, PATH, 32, weights=(5, 0))


def test_the_query_packs_at_target_shares(spark):
    from wearline.llm.queries import deficit_packing

    sf = "/root/testdata/sf0.001"
    pieces = deficit_packing(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source"), "doc_id")
    rows = pieces.collect()
    names = sorted({r["source"] for r in rows} - {None})
    shares = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)} | {None: (5, 2, 1)[len(names) % 3]}
    check_shares(rows, 4096, shares, 16 * 4096)


def test_small_buckets_change_nothing_but_the_order(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 3)
    check(packing.pack(odd(spark), PATH, 64).collect(), [(r["doc_id"], r["text"]) for r in odd(spark).collect()], library, 64)


def test_empty_table(spark):
    assert packing.pack(empty(spark), PATH).count() == 0
