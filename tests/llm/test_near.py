import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import DOCS, empty, groups, odd, words
from wearline.llm import near


def shingles(text, k):
    ws = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)]
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def corpus(seed, n=160):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 120))) for _ in range(n // 8)]
    out = []
    for i in range(n):
        ws = rng.choice(base).split(" ")
        for _ in range(rng.choice((0, 0, 1, 2, 5, 20))):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(1000)}"
        out.append((i * 3 + 1, " ".join(ws), "en", "a", 1))
    return out


@pytest.mark.parametrize("length", [2, 5])
def test_components_equal_brute_force(spark, length):
    data = corpus(length)
    sets = [shingles(r[1], length) for r in data]

    def linked(i, j):
        common = len(sets[i] & sets[j])
        return common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common)

    want = [data[g][0] for g in groups(len(data), linked)]
    frame = spark.createDataFrame(data, DOCS).repartition(5)
    got = {r["doc_id"]: r for r in near.near_duplicates(frame, near.Near(shingle=length)).collect()}
    assert [got[r[0]]["component_id"] for r in data] == want
    assert [got[r[0]]["n_shingles"] for r in data] == [len(s) for s in sets]
    assert sum(r["kept"] for r in got.values()) == len(set(want))


def test_edge_rows(spark):
    got = near.near_duplicates(odd(spark), near.Near(shingle=2)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 13
    assert by_id[2]["component_id"] == 1 and not by_id[2]["kept"]
    assert by_id[3]["component_id"] == 1
    for i in (4, 5, 6):  # null, empty, blank: nothing to link
        assert by_id[i]["n_shingles"] == 0 and by_id[i]["component_id"] == i and by_id[i]["kept"]
    assert by_id[8]["n_shingles"] == 1
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]


def test_stage_keeps_columns_and_first(spark):
    kept = near.keep_first(odd(spark))
    assert kept.columns == odd(spark).columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 4, 5, 6, 7, 8, 9, 10, 11, None}
    assert near.near_duplicates(empty(spark)).count() == 0


def test_odd_sketch_estimates_high_similarities():
    rule, rng = near.Near(), np.random.default_rng(3)
    sketcher = near.Sketcher(rule)
    common = rng.integers(0, 1 << 63, 900, np.uint64)
    a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 100, np.uint64)]) for _ in range(2))
    far = rng.integers(0, 1 << 63, 1000, np.uint64)
    odd_of = lambda s: sketcher.odd(sketcher.signature(s)).view(np.uint64)
    apart = lambda x, y: int(np.bitwise_count(x ^ y).sum())
    assert apart(odd_of(a), odd_of(b)) < rule.sketch_limit() < apart(odd_of(a), odd_of(far))
    similarity = 900 / 1100
    want = 512 * (1 - np.exp(-4 * rule.values * (1 - similarity) / 1024))
    assert abs(apart(odd_of(a), odd_of(b)) - want) < 60


def test_shingles_are_those_of_the_words():
    texts = ["A b\tC", "a  B c", "ab c", "a bc", None, "", "É x y z w v", "one"]
    sets = list(near.shingle_sets(pa.array(texts, pa.string()), 2))
    assert [len(s) for s in sets] == [len(shingles(t, 2)) for t in texts]
    assert set(sets[0]) == set(sets[1]) and not set(sets[2]) & set(sets[3])


def test_narrow_marks_of_repeated_rows(spark):
    rows = [(1, "a b c d e", "en", "a", 1), (1, "a b c d e", "en", "a", 1), (2, "a b c d x", "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    got = {r["node"]: r["better"] for r in near._narrow(docs, near.Near(shingle=2))(nodes).collect()}
    assert {n: r["size"] for n, r in got.items()} == {1: 4, 2: 4}
    x, y = (np.array(got[n]["bits"], np.int64).view(np.uint64) for n in (1, 2))
    assert np.bitwise_count(x).sum() == 4 and np.bitwise_count(x ^ y).sum() == 2


def test_whole_set_bitmaps_lose_no_linked_pair(spark):
    """Also for sets far larger than the bitmap; and they tell 0.75 from 0.8 apart."""
    rng, rows = np.random.default_rng(5), []
    for size in (10, 90, 400, 9000):
        for similarity in (0.6, 0.75, 0.8, 0.81, 0.95, 1.0):
            apart = round(size * (1 - similarity) / (1 + similarity))
            sets = rng.permutation(10 * size + 3)
            rows.append((int(size), sets[:size].tolist(), sets[apart : size + apart].tolist()))

    def bits(values):
        place = near.mix(np.array(values, np.uint64), 7) % np.uint64(near.SET_BITS)
        odd_ = np.bincount(place.astype(np.int64), minlength=near.SET_BITS) & 1
        return (len(values), np.packbits(odd_.astype(np.uint8)).view(np.int64).tolist())

    schema = "x struct<size:long,bits:array<long>>, y struct<size:long,bits:array<long>>, linked boolean, size long, j double"
    data = []
    for size, a, b in rows:
        common = len(set(a) & set(b))
        j = common / (2 * size - common)
        data.append((bits(a), bits(b), 100 * common >= 80 * (2 * size - common), size, j))
    frame = spark.createDataFrame(data, schema)
    got = frame.withColumn("fits", near.Near().fits_sets(frame["x"], frame["y"])).collect()
    assert all(r["fits"] for r in got if r["linked"])
    assert not any(r["fits"] for r in got if 90 <= r["size"] <= 400 and r["j"] < 0.77)


def test_loosely_alike_documents_are_not_all_confirmed(spark, monkeypatch):
    """Documents at similarities of 0.6 to 0.75 to each other: what is confirmed grows with their number."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    asked = []
    confirm = near._confirm

    def counted(docs, rule):
        inner = confirm(docs, rule)
        return lambda pairs: inner(asked.append(pairs.count()) or pairs)

    monkeypatch.setattr(near, "_confirm", counted)
    totals = []
    for n in (40, 160):
        rows = []
        for i in range(n):
            ws = list(base)
            for at in rng.sample(range(120), 6):
                ws[at] = f"own{i}at{at}"
            rows.append((i, " ".join(ws), "en", "a", 1))
        asked.clear()
        found = near.near_duplicates(spark.createDataFrame(rows, DOCS), near.Near(shingle=2))
        assert found.where("kept").count() >= 0.9 * n
        totals.append(sum(asked))
    assert totals[1] <= 6 * totals[0] + 40 and totals[1] < 160 * 20
