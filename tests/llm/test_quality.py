import random
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.helpers import LONG, empty, odd, rows, words
from wearline.llm import quality


def repeated(ws):
    wins = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    seen = Counter(wins)
    return len({p for i, w in enumerate(wins) if seen[w] > 1 for p in range(i, i + 5)})


def test_repeated_words_equal_brute_force(spark):
    texts = ["a b c d e a b c d e", "a " * 40, "a b c d", "a b c d e", "a b c d e f a b c d e x a b c", LONG, LONG + " " + LONG, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    split = F.array_remove(F.split("t", " "), "")
    got = [r[0] for r in frame.select(split.alias("w")).select(quality.repeated_words(F.col("w"))).collect()]
    assert got == [repeated(words(t)) for t in texts]


def test_base_measures_and_edge_rows(spark):
    got = quality.judge(odd(spark)).collect()
    assert len(got) == len(rows())
    for r in got:
        text = r["doc"]["text"] or ""
        ws = words(text)
        lines = [x for x in text.split("\n") if words(x)]
        assert r["n_words"] == len(ws)
        assert r["word_chars"] == sum(map(len, ws))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeated(ws)
        assert r["base_failed"] == (len(ws) < 10 or 100 * repeated(ws) > 20 * len(ws))
        assert r["kept"] <= (not r["base_failed"])


def test_empty_table_and_columns(spark):
    assert quality.judge(empty(spark)).count() == 0
    assert quality.keep_good(odd(spark)).columns == odd(spark).columns


def test_divergent_texts_go_and_clean_ones_stay(spark):
    rng = random.Random(3)
    listed = quality.COMMON_WORDS["en"]
    clean = lambda: ". ".join(" ".join(rng.choice(listed) if rng.random() < 0.4 else f"na{rng.choice('klmn')}e{rng.choice('opqr')}s" for _ in range(9)).capitalize() for _ in range(20))
    junk = "###$$ %%%{0} &&&&{0} ***{0}>>> <<<|| ||{0}|| #### "
    docs = [(i, clean(), "en") for i in range(40)]
    docs += [(100, "".join(junk.format(k) for k in range(60)), "en")]
    docs += [(101, "".join(junk.format(k) for k in range(60)), "xx")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r["doc"]["doc_id"]: r for r in quality.judge(frame).collect()}
    assert all(got[i]["kept"] for i in range(40))
    assert not got[100]["kept"] and not got[100]["base_failed"]
    assert got[101]["kept"] and got[101]["class_distance"] is None  # no reference


def test_identical_histograms_are_at_distance_zero(spark):
    one = spark.range(1).select(
        quality._distance(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (2, 4, 6)))).alias("same"),
        quality._distance(F.array(*map(F.lit, (1, 0))), F.array(*map(F.lit, (0, 5)))).alias("apart"),
    ).first()
    assert one["same"] == 0 and abs(one["apart"] - 1) < 1e-12


def test_main_path_is_native(spark, plan):
    assert "Python" not in plan(quality.judge(odd(spark))) and "Arrow" not in plan(quality.judge(odd(spark)))
