import itertools
import random

import numpy as np

from tests.llm.helpers import empty, odd, rows, words
from wearline.llm import interactions

LABELS = "doc_id long, quality int, toxic int, part string, mask int, rows long"


def failed(text, repeat):
    w = words(text)
    marks = [
        len(w) < 200,
        100 * len(set(w)) < 50 * len(w),
        100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
        any(c in "#$%&*|" for c in text),
        repeat,
    ]
    return {c for c, m in zip("ABCDE", marks) if m}


def brute(docs, labels):
    """Every order applied from left to right to every document."""
    docs = [(i, t or "", lang or "") for i, t, lang in docs]
    found = []
    for i, t, part in docs:
        repeat = any(j is not None and i is not None and j < i and u == t for j, u, _ in docs)
        good = any(d == i and q == 1 for d, q, _ in labels if i is not None)
        toxic = any(d == i and x == 1 for d, _, x in labels if i is not None)
        found.append((part, failed(t, repeat), good, toxic))
    out = {}
    for part in {p for p, *_ in found}:
        mine = [f for f in found if f[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            alive, gone = mine, []
            for step, letter in enumerate(order, 1):
                lost = [f for f in alive if letter in f[1]]
                alive = [f for f in alive if letter not in f[1]]
                shapley[letter] += len(lost)
                steps.append(
                    ("".join(order), step, letter, len(alive), len(lost), sum(letter in f[1] for f in gone),
                     sum(f[1] == {letter} for f in mine), sum(f[2] for f in lost), sum(f[3] for f in lost))
                )
                gone = gone + lost
        for name, step, letter, *counts in steps:
            out[part, name, step] = (*counts, shapley[letter])
    return out


def check(spark, docs, labels):
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in interactions.audit(frame, marked).collect()}
    assert got == brute(docs, labels)


def test_against_every_order_on_every_document(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        n = rng.choice((3, 150, 199, 200, 201, 260))
        w = [f"w{k % rng.choice((90, 100, 101, 400))}" for k in range(n)]
        if rng.random() < 0.4:
            w = [x.upper() for x in w]
        if rng.random() < 0.3:
            w[0] = rng.choice("#$%&*|")
        texts.append(" ".join(w))
    docs = [(i, rng.choice(texts), rng.choice(("en", "de", None, ""))) for i in range(200)]
    docs += [(None, texts[0], "en"), (7, texts[1], "de"), (7, texts[1], "de"), (300, None, "de"), (301, "", "en")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1))) for i in range(0, 200, 2)]
    check(spark, docs, labels + [(0, 1, 1), (0, 0, 0), (None, 1, 1), (999, 1, 1)])


def test_edge_rows(spark):
    labels = spark.createDataFrame([(2, 1, 0, "x", 1, 1), (7, 0, 1, "x", 1, 1)], LABELS)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in interactions.audit(odd(spark), labels).collect()}
    plain = [(r[0], r[1], r[2]) for r in rows()]
    assert got == brute(plain, [(2, 1, 0), (7, 0, 1)])
    assert interactions.audit(empty(spark), labels).count() == 0
    lost = interactions.audit(odd(spark), labels.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(lost) == (0, 0)


def test_the_walk_stores_every_subset():
    counts = np.random.default_rng(1).integers(0, 50, (32, 3))
    states = interactions.survivors(counts)
    masks = np.arange(32)
    for subset in range(32):
        assert (states[subset] == counts[(masks & subset) == 0].sum(0)).all()


def test_many_copies_of_one_text_stay_spread(spark, plan):
    """Rows are matched to the first of their text by digest and id, never grouped by text alone."""
    frame = spark.range(4000).selectExpr("id doc_id", "'the same text' text", "'en' lang")
    failed_ = interactions.failures(frame)
    assert failed_.where("mask >= 16").count() == 3999
    assert "Window" not in plan(failed_)
