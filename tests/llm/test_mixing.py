import random
from collections import defaultdict

import pytest

from tests.llm.helpers import empty, odd, words
from wearline.llm import mixing


def targets(sizes, share=1.5, most=2):
    """Sharing by weight, with what is above the most given to the others until none is above."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + ([None] if None in sizes else [])
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    out, open_names, left = {}, set(names), share * sum(sizes.values())
    while open_names:
        rate = left / sum(weight[n] for n in open_names)
        above = {n for n in open_names if rate * weight[n] > most * sizes[n]}
        if not above:
            out.update({n: rate * weight[n] for n in open_names})
            break
        for n in above:
            out[n] = most * sizes[n]
            left -= out[n]
        open_names -= above
    return out


def corpus(spark, n=3000, seed=1):
    rng = random.Random(seed)
    names = ["s1", "s2", "s3", "s4", "é", "Z", None]
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 5, 40, 300))), rng.choices(names, (30, 5, 5, 2, 1, 1, 9))[0]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_targets_and_taken_words(spark):
    frame, rows = corpus(spark)
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
        largest[s] = max(largest[s], len(words(t)))
    want = targets(sizes)
    got = mixing.mix(frame, carry=["doc_id", "source"]).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        name = r["doc"]["source"]
        assert abs(r["target"] - want[name]) < 1e-6 * want[name] and r["source_size"] == sizes[name]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[name] += r["taken"]
    assert all(abs(taken[n] - want[n]) <= largest[n] / 2 for n in want)


def test_reruns_and_partitions_agree(spark):
    frame, _ = corpus(spark, 500, 2)
    runs = [
        sorted((r["doc"]["doc_id"], r["copies"]) for r in mixing.mix(frame.repartition(p), carry=["doc_id"]).collect())
        for p in (1, 7)
    ]
    assert runs[0] == runs[1]


def test_a_small_bin_count_gives_the_same_sample(spark, monkeypatch):
    frame, _ = corpus(spark, 400, 3)
    take = lambda: sorted((r["doc"]["doc_id"], r["copies"]) for r in mixing.mix(frame, carry=["doc_id"]).collect())
    fine = take()
    monkeypatch.setattr(mixing, "BINS", 2)
    assert take() == fine


def test_inclusion_follows_preference(spark):
    """Longer documents are preferred: their share of copies is larger."""
    frame, _ = corpus(spark, 4000, 4)
    got = mixing.mix(frame, weights=(1,), share=0.5, carry=["doc_id"]).where("size > 0")
    mean = {r["size"]: r["m"] for r in got.groupBy("size").agg({"copies": "avg"}).withColumnRenamed("avg(copies)", "m").collect()}
    assert mean[300] > mean[5] > 0


@pytest.mark.parametrize("ids", ["repeated", "null", "distinct"])
def test_repeated_rows_and_null_ids_meet_the_target(spark, ids):
    key = {"repeated": "7", "null": "cast(null as long)", "distinct": "id"}[ids]
    hot = spark.range(1000).selectExpr(f"cast({key} as long) doc_id", "'a b c d e f g h i j' text", "'s' source")
    other = spark.range(10).selectExpr("id + 5000 doc_id", "'a b c d e f g h i j' text", "'s' source")
    docs = hot.unionByName(other)
    for carry in (["doc_id"], None):
        got = mixing.mix(docs, carry=carry).collect()
        assert len(got) == 1010 and got[0]["target"] == 15150
        assert abs(sum(r["taken"] for r in got) - 15150) <= 10
    again = [sorted((r["doc"]["doc_id"] or -1, r["taken"]) for r in mixing.mix(docs.repartition(p), carry=["doc_id"]).collect()) for p in (2, 9)]
    assert again[0] == again[1]
    taken = mixing.repeat(docs)
    assert taken.columns == docs.columns and abs(taken.count() - 1515) <= 1


def test_edge_rows(spark):
    got = mixing.mix(odd(spark)).collect()
    assert len(got) == 13
    for r in got:
        assert r["size"] == len(words(r["doc"]["text"])) and r["taken"] <= 2 * r["size"]
    assert mixing.mix(empty(spark)).count() == 0
    stage = mixing.repeat(odd(spark))
    assert stage.columns == odd(spark).columns and stage.count() == sum(r["copies"] for r in got)


def test_main_path_is_native(spark, plan):
    text = plan(mixing.mix(odd(spark)))
    assert "Python" not in text and "Arrow" not in text
