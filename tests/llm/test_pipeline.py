from collections import Counter, defaultdict

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.compare import compare, connect
from tests.llm.helpers import empty, groups, odd, words
from tests.llm.test_lines import edits, norm
from tests.llm.test_near import shingles
from tests.llm.test_packing import PATH, check
from wearline.llm import quality
from wearline.llm.queries import ORACLES, QUERIES
from wearline.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_work_on_what_came_before(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF))
        steps.append((name, before, docs))
        if name != "packing":
            assert docs.columns == columns
    by_name = {n: (a, b) for n, a, b in steps}
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    start, good = by_name["quality_rules"]
    verdicts = {r["doc"]["doc_id"]: r["kept"] for r in quality.judge(start).collect()}
    assert ids(good) == {i for i, kept in verdicts.items() if kept} < ids(start)
    _, deduped = by_name["line_dedup"]
    whole = {r["doc_id"]: r["text"] for r in good.collect()}
    for r in deduped.collect():
        old, new = whole[r["doc_id"]].split("\n"), r["text"].split("\n")
        assert all(line in old for line in new) and r["n_chars"] == len(r["text"])
    _, single = by_name["near_dedup"]
    assert ids(single) <= ids(deduped)
    mixed_from, mixed = by_name["mixing"]
    assert ids(mixed) <= ids(mixed_from) and mixed.count() > mixed_from.count()
    _, pieces = by_name["packing"]
    tokens = defaultdict(int)
    for r in pieces.collect():
        tokens[r["sequence_id"]] += r["length"]
    assert all(n == 4096 for k, n in tokens.items() if k != max(tokens))
    assert ids(pieces) == ids(mixed)


def lines_kept(rows):
    """Texts by doc_id after all but the first line of every group of like lines is gone."""
    places = [(i, k, norm(line)) for i, text in rows for k, line in enumerate(text.split("\n"))]
    places = sorted(p for p in places if p[2])
    distinct = list(dict.fromkeys(p[2] for p in places))
    bags = [Counter(d) for d in distinct]

    def linked(i, j):
        longer = max(len(distinct[i]), len(distinct[j]))
        if longer < 10 or 100 * sum((bags[i] & bags[j]).values()) < 90 * longer:
            return False
        return 100 * (longer - edits(distinct[i], distinct[j])) >= 90 * longer

    group = dict(zip(distinct, groups(len(distinct), linked)))
    first, gone = {}, defaultdict(set)
    for i, k, words_ in places:
        if first.setdefault(group[words_], (i, k)) != (i, k):
            gone[i].add(k)
    out = {}
    for i, text in rows:
        left = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone[i])
        if i not in gone or words(left):
            out[i] = left
    return out


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF))
        con = duckdb.connect()
        con.register("documents", before.toArrow())
        steps[name] = (con, [(r[0], r[1]) for r in before.select("doc_id", "text").collect()], docs.collect())
    con, _, after = steps["quality_rules"]
    kept = con.execute(f"SELECT doc_id FROM ({ORACLES['op1_quality_divergence']}) WHERE kept").fetchall()
    assert sorted(r["doc_id"] for r in after) == sorted(i for (i,) in kept)
    _, before, after = steps["line_dedup"]
    assert {r["doc_id"]: r["text"] for r in after} == lines_kept(before)
    _, before, after = steps["near_dedup"]
    sets = [shingles(text, 5) for _, text in before]
    alike = lambda i, j: sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    order = sorted(range(len(before)), key=lambda k: before[k][0])
    found = groups(len(order), lambda i, j: alike(order[i], order[j]))
    assert sorted(r["doc_id"] for r in after) == [before[order[k]][0] for k, g in enumerate(found) if g == k]
    con, _, after = steps["mixing"]
    want = con.execute(f"SELECT doc_id, taken // size FROM ({ORACLES['op7_pareto_mix']}) WHERE taken > 0").fetchall()
    assert Counter(r["doc_id"] for r in after) == {i: int(n) for i, n in want}
    _, before, after = steps["packing"]
    check(after, before, Tokenizer.from_file(PATH), 4096)


def test_stages_take_odd_and_empty_tables(spark):
    for make in (odd, empty):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF))
        assert docs.count() >= 0
