import random
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import empty, odd
from wearline.llm import sharding


def corpus(spark, n=6000, seed=3, single=160):
    rng = random.Random(seed)
    rows = [
        (i, f"text {rng.randrange(50)} é" * rng.randrange(4), rng.choices(("a", "b", "c", None), (70, 20, 8, 2))[0])
        for i in range(n)
    ]
    rows += [(n + i, "x", f"one{i}") for i in range(single)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def placed(frame, **options):
    return sharding.assign_shards(frame, **options).collect()


def law_of_rows(got, shards):
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert set(slots) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("single, near", [(0, 2), (160, 8)])
def test_every_shard_matches_the_mixture(spark, single, near):
    """Sources of one row fall at random places, which moves the cuts of the others a little."""
    frame, rows = corpus(spark, single=single)
    got = placed(frame, carry=["doc_id", "source", "text"])
    law_of_rows(got, 16)
    assert sorted(r["doc"]["doc_id"] for r in got) == sorted(r[0] for r in rows)
    total = Counter(r["doc"]["source"] for r in got)
    held = defaultdict(Counter)
    for r in got:
        text = (r["doc"]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        held[r["shard"]][r["doc"]["source"]] += 1
    for source in ("a", "b", "c", None):
        for shard in range(16):
            assert abs(held[shard][source] - total[source] / 16) <= near
    alone = [sum(c for s, c in held[k].items() if s and s.startswith("one")) for k in range(16)]
    assert max(alone) <= 25  # sources of one row don't gather in the middle


def test_prefixes_of_a_shard_match_too(spark):
    frame, _ = corpus(spark)
    rows = [r for r in placed(frame, carry=["source"]) if r["shard"] == 5]
    front = [r["doc"]["source"] for r in sorted(rows, key=lambda r: r["slot"])[: len(rows) // 2]]
    whole = Counter(r["doc"]["source"] for r in rows)
    assert abs(front.count("a") - whole["a"] / 2) <= 4


def test_reruns_and_small_ranges_agree(spark, monkeypatch):
    frame, _ = corpus(spark, 1500)
    key = lambda rows: sorted((r["doc"]["doc_id"], r["shard"], r["slot"]) for r in rows)
    one = key(placed(frame, carry=["doc_id"]))
    assert key(placed(frame.repartition(7), carry=["doc_id"])) == one
    monkeypatch.setattr(sharding, "RANGE_ROWS", 10)
    assert key(placed(frame, carry=["doc_id"])) == one
    assert key(placed(frame, carry=["doc_id"], seed=24)) != one


def test_repeated_rows_and_null_ids_spread(spark):
    frame = spark.range(5000).selectExpr("cast(null as long) doc_id", "'same' text", "'hot' source")
    got = placed(frame.unionByName(spark.range(700).selectExpr("id doc_id", "'y' text", "'cold' source")))
    law_of_rows(got, 16)
    hot = Counter(r["shard"] for r in got if r["doc"]["doc_id"] is None)
    assert sum(hot.values()) == 5000 and max(hot.values()) - min(hot.values()) <= 4


def test_edge_rows_and_files(spark, tmp_path):
    got = placed(odd(spark))
    assert len(got) == 13
    law_of_rows(got, 16)
    assert sharding.assign_shards(empty(spark)).count() == 0
    sharding.write_shards(odd(spark), str(tmp_path / "s"), shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 13 and back.select("doc.*").columns == odd(spark).columns
    assert sorted(r["n"] for r in back.groupBy("shard").agg({"slot": "count"}).withColumnRenamed("count(slot)", "n").collect()) == [4, 4, 5]


def test_main_path_is_native(spark, plan):
    text = plan(sharding.assign_shards(odd(spark)))
    assert "Python" not in text and "Arrow" not in text
