import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from tests.llm.helpers import DOCS, empty, groups, odd
from wearline.llm import lines
from wearline.llm.texts import mix

RULE = lines.FuzzyLines(min_words=4, bits=6)


def norm(line):
    return tuple(re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[0-9]", "0", line.lower())))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(500)}x" for _ in range(rng.randrange(2, 40))] for _ in range(40)]
    base = [[w.replace("1", "k").replace("2", "z") for w in b] for b in base]
    out = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(0, 6)):
            ws = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 2))):
                ws[rng.randrange(len(ws))] = f"q{rng.choice('abcdefgh')}"
            text.append(" ".join(ws).capitalize() + rng.choice((".", "", " 12")))
        out.append((i, "\n".join(text), "en", "a", 1))
    return out


def test_removals_equal_brute_force(spark):
    data = corpus(8)
    frame = spark.createDataFrame(data, DOCS).repartition(4)
    where = [(i, k, norm(line)) for i, t, *_ in data for k, line in enumerate(t.split("\n"))]
    where = sorted((w for w in where if len(w[2]) >= RULE.min_words), key=lambda w: w[:2])
    sims = {(r["doc_id"], r["place"]): np.uint64(r["sim"] % (1 << 64)) for r in lines.occurrences(frame, RULE).collect()}
    assert set(sims) == {w[:2] for w in where}

    def linked(i, j):
        a, b = where[i], where[j]
        longer = max(len(a[2]), len(b[2]))
        near = np.bitwise_count(sims[a[:2]] ^ sims[b[:2]]) <= RULE.bits
        return a[2] == b[2] or near and 100 * (longer - edits(a[2], b[2])) >= RULE.percent * longer

    firsts = groups(len(where), linked)
    want = {i: [] for i, *_ in data}
    for k, first in enumerate(firsts):
        if first != k:
            want[where[k][0]].append(where[k][1])
    got = {r["doc_id"]: r for r in lines.removals(frame, RULE).collect()}
    assert {i: got[i]["removed"] for i in got} == want
    assert all(got[i]["n_lines"] == len(t.split("\n")) for i, t, *_ in data)
    assert sum(map(len, want.values())) > 20


def test_every_close_pair_shares_a_bucket(spark):
    rng = random.Random(9)
    rows = []
    for i in range(200):
        sim = rng.getrandbits(64)
        flipped = sim
        for bit in rng.sample(range(64), rng.randrange(0, 4)):
            flipped ^= 1 << bit
        rows.append((i, *(x - (1 << 64) if x >= 1 << 63 else x for x in (sim, flipped))))
    frame = spark.createDataFrame(rows, "i long, x long, y long")
    rule = lines.DEFAULT
    got = frame.select(lines._buckets(frame["x"], rule).alias("a"), lines._buckets(frame["y"], rule).alias("b")).collect()
    assert all(any(p == q for p, q in zip(r["a"], r["b"])) for r in got)


def test_lines_of_texts():
    found = lines.lines_of(pa.array(["a b\nc", None, "", "\n", "x\n"], pa.string()))
    assert found.text.tolist() == [0, 0, 1, 2, 3, 3, 4, 4]
    assert found.place.tolist() == [0, 1, 0, 0, 0, 1, 0, 1]
    assert np.diff(found.bounds).tolist() == [2, 1, 0, 0, 0, 0, 1, 0]


def test_simhash_chunks_agree(monkeypatch):
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 1000, np.uint64)
    begin, size = np.array([0, 3, 50, 900]), np.array([3, 47, 850, 100])
    whole = lines.simhash(hashes, begin, size)
    monkeypatch.setattr(lines, "CHUNK_WORDS", 16)
    assert (lines.simhash(hashes, begin, size) == whole).all()


def test_stage_cuts_and_drops(spark):
    long_line = "this line has more than eight words in it for sure"
    rows = [
        (1, f"{long_line}\nkept only here one", "en", "a", 9),
        (2, f"{long_line.upper()}!\nanother short tail", "en", "a", 9),
        (3, long_line, "en", "a", 9),
        (4, None, None, None, None),
        (None, f"{long_line}\nends with this", "en", "a", 9),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in lines.dedup_lines(frame).collect()}
    # Rows without an id come first, so theirs is the occurrence that stays.
    assert got[None]["text"] == f"{long_line}\nends with this"
    assert got[1]["text"] == "kept only here one" and got[1]["n_chars"] == 18
    assert got[2]["text"] == "another short tail"
    assert 3 not in got and got[4]["text"] is None


def test_edge_rows(spark):
    got = lines.removals(odd(spark)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 13 and by_id[4]["n_lines"] == 0 and by_id[5]["n_lines"] == 1
    assert by_id[11]["removed"] == [1, 2]
    assert by_id[2]["removed"] == [0] and by_id[1]["removed"] == []
    assert lines.removals(empty(spark)).count() == 0
    assert lines.dedup_lines(odd(spark)).columns == odd(spark).columns
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_production_rule_equals_brute_force_by_edit_similarity(spark):
    rng = random.Random(12)
    bases = [[f"w{rng.choice('abcdefghij')}{rng.choice('klmnop')}" for _ in range(n)] for n in (9, 10, 12, 19, 20, 27, 29, 30, 31, 45, 60, 100, 140, 230, 420)]
    rows = []
    for ws in bases:
        for k in range(9):
            out = list(ws)
            for _ in range(rng.randrange(0, 3 + len(ws) // 12)):
                at = rng.randrange(len(out))
                out[at : at + 1] = rng.choice(([f"q{rng.choice('abcdef')}"], [], [out[at], "more"]))
            rows.append((len(rows), " ".join(out), "en", "a", 1))
    where = [norm(r[1]) for r in rows]
    longer = lambda i, j: max(len(where[i]), len(where[j]))
    linked = lambda i, j: 100 * (longer(i, j) - edits(where[i], where[j])) >= 90 * longer(i, j)
    want = groups(len(rows), linked)
    got = {r["doc_id"] for r in lines.removals(spark.createDataFrame(rows, DOCS).repartition(4)).where("size(removed) > 0").collect()}
    assert got == {i for i, first in enumerate(want) if first != i} and len(got) > 30


def test_one_replaced_word_in_ten_is_a_repeat(spark):
    base = [f"{a}{b}" for a in "klmnpr" for b in "aeiou"]
    texts = []
    for k in range(20):
        ws = random.Random(k).sample(base, 9) + [f"own{'abcdefghijklmnopqrst'[k]}"]
        texts += [" ".join(ws), " ".join([*ws[:4], "other", *ws[5:]])]
    frame = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["removed"] for r in lines.removals(frame).collect()}
    assert all(got[i] == ([0] if i % 2 else []) for i in got)


def test_short_lines_repeat_exactly(spark):
    rows = [(1, "read more here\n\n...\nShare", "en", "a", 1), (2, "Read more here!\n\n...\nshare this", "en", "a", 1), (3, "share\n...", "en", "a", 1)]
    got = {r["doc_id"]: r["removed"] for r in lines.removals(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: [], 2: [0], 3: [0]}


def test_within_edits_equals_brute_force():
    rng = random.Random(5)
    seen = set()
    for _ in range(600):
        x = [rng.randrange(rng.choice((3, 40))) for _ in range(rng.randrange(1, 30))]
        y = list(x)
        for _ in range(rng.randrange(0, 7)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = [rng.randrange(40)] * rng.randrange(2)
        limit = rng.randrange(0, 6)
        # Hashes use all 64 bits, so half of them are negative as Spark's longs.
        a, b = (np.array([(v * 0x9E3779B97F4A7C15) % (1 << 64) for v in w], np.uint64).view(np.int64) for w in (x, y))
        want = edits(x, y) <= limit
        seen.add(want)
        assert lines.within_edits(a, b, limit) == want
    assert seen == {True, False}


def test_a_line_of_a_million_words_is_compared():
    x = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 1_000_000)
    y = np.concatenate([x[:10], x[11:500_000], [7, 8], x[500_000:]])
    assert lines.within_edits(x, y, 100_000) and not lines.within_edits(x, y, 2)
    assert not lines.within_edits(x, np.roll(x[::-1], 5) + 1, 100_000)


def test_close_lines_share_as_many_buckets_as_the_last_step_asks(spark):
    rng = random.Random(21)
    rule = lines.DEFAULT
    for n in (9, 10, 20, 28, 30, 45, 99, 100, 210, 430):
        for _ in range(20):
            x = [rng.getrandbits(64) for _ in range(n)]
            y = list(x)
            allowed = n * rule.away // 100
            for at in rng.sample(range(n), allowed):
                y[at] = rng.getrandbits(64)
            if rng.random() < 0.5 and allowed:
                y = x[allowed:]
            words = np.array([*x, *y], np.uint64)
            first, size = np.array([0, len(x)]), np.array([len(x), len(y)])
            order = np.zeros(lines.ORDER_SLOTS, np.int32)
            a, b = lines.rare_keys(words, first, size, order, rule).to_pylist()
            shorter = min(len(x), len(y))
            least = 2 + shorter // lines.WORDS_PER_SHARED if shorter >= rule.length_of(3) else 1
            assert allowed == 0 or len(set(a) & set(b)) >= least


def test_close_lines_share_a_run_of_words():
    """For any order of the runs, and for lines that repeat few words."""
    rng = random.Random(22)
    for percent, run in ((90, 3), (95, 3), (85, 2), (60, 1)):
        rule = lines.FuzzyLines(percent=percent, within_bits=False)
        assert rule.run_length() == run
        for n in range(2, 60) if run > 1 else ():
            for known in (3, 1 << 60):
                x = [rng.randrange(known) for _ in range(n)]
                y, allowed = list(x), rule.edits_of(n)
                for _ in range(allowed):
                    at = rng.randrange(len(y))
                    y[at : at + 1] = rng.choice(([rng.randrange(known)], [], [y[at], rng.randrange(known)]))
                if x == y or edits(x, y) > max(len(x), len(y)) * rule.away // 100:
                    continue
                words = mix(np.array([*x, *y], np.uint64), 3)
                order = np.random.default_rng(n).integers(0, 1 << 30, lines.ORDER_SLOTS).astype(np.int32)
                a, b = lines.run_keys(words, np.array([0, len(x)]), np.array([len(x), len(y)]), order, rule).to_pylist()
                assert set(a) & set(b) and len(set(a)) == len(a)


def test_lines_with_common_words_do_not_meet(spark):
    """Lines of one small vocabulary are no candidates of each other, so pairs don't grow with the square of the lines."""
    rng = random.Random(23)
    texts = [" ".join(f"w{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}" for _ in range(40)) for _ in range(400)]
    found = lines.occurrences(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS), lines.DEFAULT)
    members = {}
    for row in found.collect():
        for bucket in row["keys"]:
            members.setdefault(bucket, set()).add(row["doc_id"])
    assert sum(len(m) * (len(m) - 1) // 2 for m in members.values()) < 400


def test_parts_of_a_batch_hold_all_rows(monkeypatch):
    monkeypatch.setattr(lines, "PART_BYTES", 5)
    texts = ["abc", None, "de", "a text longer than a part", "", "x"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    parts = [part.column("text").to_pylist() for part in lines._parts(batch)]
    assert parts == [["abc", None, "de"], ["a text longer than a part"], ["", "x"]]


def test_variants_just_too_far_apart_are_not_confirmed(spark, monkeypatch):
    """Variants of one line with 3 of 30 words replaced, at other places each: 4 edits apart or more, which the short marks don't show."""
    asked, confirmed = [], lines._confirmed

    def counted(pairs, rule):
        asked.append(pairs.count())
        return confirmed(pairs, rule)

    monkeypatch.setattr(lines, "_confirmed", counted)
    base = [f"{a}{b}" for a in "klmnpr" for b in "aeiou"]
    rows, rng = [], random.Random(24)
    for i, places in enumerate(rng.sample(list(combinations(range(30), 3)), 60)):
        ws = list(base)
        for at in places:
            ws[at] = "q" + "".join(rng.choices("abcdefgh", k=6))
        rows.append((i, " ".join(ws), "en", "a", 1))
    assert lines.removals(spark.createDataFrame(rows, DOCS)).where("size(removed) > 0").count() == 0
    # Star and round: at most one pair per line and bucket; the last step none of 1,770.
    assert asked[-1] <= 60
