import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import empty, odd
from wearline.llm import toxicity


def test_pairs_are_learned_that_single_terms_cannot_tell():
    """Toxic only if an insult meets a group; each term alone is as frequent in both classes."""
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for _ in range(3000):
        insult, group = rng.integers(0, 2, 2)
        noise = 10 + rng.choice(40, 5, replace=False)
        docs.append(np.array(sorted([insult, 2 + group, *noise]), np.int32))
        labels.append(float(insult == group))
    labels = np.array(labels)
    machine = toxicity.fit(docs, labels, epochs=60, least_association=0)
    right = (machine.scores(docs) >= 0.5) == (labels == 1)
    assert right.mean() > 0.9


def test_edge_rows(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (7, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    got = toxicity.score(docs, machine).collect()
    assert len(got) == 13 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert toxicity.score(empty(spark), machine).count() == 0
    untrained = toxicity.train(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs, untrained).collect()} == {0}


def test_held_out_precision_and_recall(spark):
    from wearline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op6_factorization_toxicity"](spark, sf).join(labels, "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["n"] for r in got.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert n.get((0, 1), 0) <= 0.01 * n[(0, 0)]
    assert n[(1, 1)] >= 0.65 * (n[(1, 1)] + n.get((1, 0), 0))


def explicit(machine, buckets):
    """The score with every pair of the document's terms summed one by one."""
    place = {int(b): k for k, b in enumerate(machine.buckets)}
    known = [place[int(b)] for b in buckets if int(b) in place]
    margin = machine.bias + sum(machine.weights[k] for k in known)
    margin += sum(float(machine.vectors[i] @ machine.vectors[j]) for i, j in combinations(known, 2))
    return 1 / (1 + math.exp(-margin))


def test_scores_equal_explicit_pair_sums():
    rng = np.random.default_rng(4)
    buckets = np.sort(rng.choice(300, 60, replace=False)).astype(np.int32)
    machine = toxicity.Machine(-0.4, buckets, rng.normal(0, 0.3, 60), rng.normal(0, 0.2, (60, toxicity.FACTORS)))
    docs = [np.sort(rng.choice(300, n, replace=False)).astype(np.int32) for n in (0, 1, 2, 5, 40, 300)]
    assert machine.scores(docs).tolist() == pytest.approx([explicit(machine, d) for d in docs])
    # Pairs matter: without them the scores are others.
    alone = toxicity.Machine(-0.4, buckets, machine.weights, 0 * machine.vectors)
    assert abs(alone.scores(docs[-1:]) - machine.scores(docs[-1:]))[0] > 1e-3


def test_every_document_equals_explicit_pair_sums(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    machine = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert len(machine.buckets)
    got = toxicity.score(docs, machine).collect()
    for r in got:
        terms = toxicity.features(pa.array([r["doc"]["text"]], pa.string()))[0]
        assert r["score"] == pytest.approx(explicit(machine, terms), rel=1e-6)
