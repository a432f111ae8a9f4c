import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import empty, odd
from wearline.llm import language

SAMPLES = {
    "en": "the quick brown fox and the lazy dog went to the river with all of their friends",
    "fr": "le renard brun et le chien sont allés vers la rivière avec tous leurs amis de la ville",
    "de": "der schnelle braune Fuchs und der Hund gingen mit allen ihren Freunden zum Fluss",
}


def training(spark):
    rows = [(i * 10 + k, t, lang) for k, (lang, t) in enumerate(SAMPLES.items()) for i in range(5)]
    return spark.createDataFrame(rows + [(999, None, "en"), (998, "x", None)], "doc_id long, text string, lang string")


def test_learned_languages_are_told_apart(spark):
    profiles = language.learn(training(spark))
    assert profiles.languages == ["de", "en", "fr"]
    tests = [(1, "the dog and the fox", "en"), (2, "le chien et la ville", "fr"), (3, "der Hund und der Fluss", "de")]
    frame = spark.createDataFrame(tests, "doc_id long, text string, lang string")
    got = language.identify(frame, profiles).collect()
    assert [r["lang_pred"] for r in got] == [r["doc"]["lang"] for r in got]
    assert all(0 < r["score"] <= 1 for r in got)


def test_profile_ranks_are_the_counts_order():
    found, counts = language.grams("ab ab, a1b")
    named = {n: c for n, c in zip(found.tolist(), counts.tolist())}
    assert named[ord("a")] == 3 and named[ord("b")] == 3
    assert named[ord("a") << 21 | ord("b")] == 2
    assert named[ord("b") << 21 | 32] == 3  # the end of a word, also of the last
    top = language.top(found, counts, 2)
    assert sorted(counts, reverse=True)[0] == named[int(top[0])]


def test_out_of_place_distance_by_hand():
    profiles = language.learn.__globals__["Profiles"](
        ["x", "y"], *(lambda g: (g, __import__("numpy").array([[0, 3], [1, 3], [3, 0]])))(
            __import__("numpy").array(sorted([ord("a"), 32 << 21 | ord("a"), ord("z")]))), 3)
    name, score = profiles.predict("a")
    # n-grams of "_a_", each once: a, _a, a_ ; the triple is cut off. x: 0 + 0 + 3 out of place of 9.
    assert name == "x" and 0 < score < 1


def test_edge_rows(spark):
    profiles = language.learn(training(spark))
    got = {r["doc"]["doc_id"]: r for r in language.identify(odd(spark), profiles).collect()}
    assert [got[i]["lang_pred"] for i in (4, 5, 6)] == ["und"] * 3 and got[4]["score"] == 0
    assert got[9]["lang_pred"] in profiles.languages
    assert language.identify(empty(spark), profiles).count() == 0
    nothing = language.learn(training(spark).limit(0))
    assert {r["lang_pred"] for r in language.identify(odd(spark), nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from wearline.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op4_rank_order_language"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got) > 100


def plain_ranks(counts, length):
    """n-grams in the order of their counts, ties by the number that their characters make."""
    number = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:length]


def plain_grams(text):
    runs = re.findall(r"[^\W\d_]+", (text or "").lower())
    whole = f" {' '.join(runs)} " if runs else ""
    return Counter(whole[i : i + n] for n in (1, 2, 3) for i in range(len(whole) - n + 1) if whole[i : i + n] != " ")


def test_every_document_equals_brute_force(spark):
    from wearline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = defaultdict(Counter)
    for r in docs:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None:
            counts[r["lang"]] += plain_grams(r["text"])
    places = {lang: {g: k for k, g in enumerate(plain_ranks(c, 300))} for lang, c in counts.items()}
    got = {r["doc_id"]: r for r in QUERIES["op4_rank_order_language"](spark, sf).collect()}
    assert len(got) == len(docs) > 100 and len(places) > 2
    for r in docs:
        mine = plain_ranks(plain_grams(r["text"]), 300)
        if not mine:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        away = {
            lang: sum(abs(known[g] - k) if g in known else 300 for k, g in enumerate(mine))
            for lang, known in places.items()
        }
        best = min(sorted(away), key=away.get)
        assert got[r["doc_id"]]["lang_pred"] == best
        assert got[r["doc_id"]]["score"] == pytest.approx(1 - away[best] / (300 * len(mine)))
