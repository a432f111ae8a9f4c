import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.llm import topk

KIND = "vec_id long, embedding array<float>"


def brute(rows, k):
    use = [(i, [math.floor(256 * np.float32(x).item()) for x in v]) for i, v in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({(i, tuple(v)) for i, v in use if i % 10 == 0}):
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in use if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 64, 5000])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "CHUNK_ROWS", 5)
    rng = random.Random(block)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.25, rng.gauss(0, 1))) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(300, None), (310, [1.0, None]), (320, [float("nan")] * 6), (330, [float("inf")] * 6), (None, [1.0] * 6), (340, [0.0] * 6), (350, []), (360, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, KIND).repartition(4)
    got = topk.top_k(frame, F.col("vec_id") % 10 == 0, 5).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == brute(rows, 5)


def test_few_candidates_and_none(spark):
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], KIND)
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") % 10 == 0).select("query_id", "rank", "vec_id", "score").collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(two.limit(0), F.lit(True)).count() == 0


def test_reading_stops_before_the_end_on_clear_winners():
    rng = np.random.default_rng(2)
    values = rng.integers(-20, 20, (2000, 8))
    query = np.full(8, 30)
    values[:6] += 400
    ids, scores, read = topk.Block(np.arange(2000), values).best(-1, query, 5)
    want = np.lexsort((np.arange(2000), -(values @ query)))[:5]
    assert ids.tolist() == want.tolist() and read < 1
