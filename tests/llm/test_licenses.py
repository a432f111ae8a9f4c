import random

import pytest

from tests.llm.helpers import empty, odd
from wearline.llm import licenses


def found(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["doc"]["doc_id"], r["license"], r["start"]) for r in licenses.scan_licenses(frame).orderBy("doc.doc_id", "start").collect()]


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_every_template_is_its_own_license(spark, name):
    scanner = licenses.scanner(tuple((n, t) for n, texts in licenses.TEMPLATES.items() for t in texts))
    for text in licenses.TEMPLATES[name]:
        assert [x[1] for x in scanner.statements(f"Some words before. {text} And after.", 0.1)] == [name]


def test_versions_and_near_names_are_told_apart(spark):
    texts = [
        "x\nLicensed under the Apache License, Version 2.0.\ny",
        "Licensed under the Apache License, Version 1.1.",
        "This work is licensed under the GNU General Public License, version 2.",
        "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.",
        "Licensed under CC BY-NC 4.0. " + "word " * 200 + "\nReleased under the MIT License.",
        "He has a licence to drive and she licensed the song.",
        None,
        "",
    ]
    assert [(i, n) for i, n, _ in found(spark, texts)] == [
        (0, "Apache-2.0"), (2, "GPL-2.0"), (3, "GPL-3.0"), (4, "CC-BY-NC-4.0"), (4, "MIT"),
    ]


def test_small_wording_differences_are_reported(spark):
    notice = licenses.TEMPLATES["GPL-3.0"][1].replace("redistribute", "share")
    frame = spark.createDataFrame([(1, notice)], "doc_id long, text string")
    r = licenses.scan_licenses(frame).first()
    assert r["license"] == "GPL-3.0" and r["missing"] == ["redistribute"] and r["extra"] == ["share"] and 0 < r["saved"] < 1


def test_edge_rows(spark):
    assert licenses.scan_licenses(odd(spark)).count() == 0
    assert licenses.scan_licenses(empty(spark)).count() == 0
    long_text = "word " * 100_000 + "Released under the MIT License." + " word" * 100_000
    assert [n for _, n, _ in found(spark, [long_text])] == ["MIT"]


def test_all_planted_statements_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {(r["doc"]["doc_id"], r["license"]) for r in licenses.scan_licenses(docs).collect()}
    want = set()
    for r in docs.where("text like '%icense%'").collect():
        for name in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0"):
            if licenses.TEMPLATES[name][0] in r["text"]:
                want.add((r["doc_id"], name))
    assert want and want == got


def test_a_verbatim_statement_is_found_at_any_rank(spark):
    around = ("Anyone may redistribute and use this software with or without modification, provided that the terms and"
              " conditions of the General Public License, version 3, of the Free Software Foundation are met.")
    names = [(n, t) for n, texts in licenses.TEMPLATES.items() for t in texts]
    scanner = licenses.scanner(tuple(names))
    texts = [f"{around} {t} {around}" for _, t in names]
    ranks = [[scanner.templates[i][0] for _, i in scanner.ranked(t)].index(n) for (n, _), t in zip(names, texts)]
    assert max(ranks) >= 3
    assert {(i, n) for i, n, _ in found(spark, texts)} >= {(i, n) for i, (n, _) in enumerate(names)}


def test_wrapped_late_and_several_statements(spark):
    wrapped = [t for texts in licenses.TEMPLATES.values() for t in texts if len(t.split()) > 12]
    names = [n for n, texts in licenses.TEMPLATES.items() for t in texts if len(t.split()) > 12]
    for width in (3, 6):
        texts = []
        for t in wrapped:
            ws = t.split()
            texts.append("\n".join("# " + " ".join(ws[i : i + width]) for i in range(0, len(ws), width)))
        got = found(spark, texts)
        assert [n for _, n, _ in got] == names
    long_one = "The license. " + "word " * 55 + licenses.TEMPLATES["GPL-3.0"][1] + " word" * 9
    both = "Released under the MIT License. Or: Licensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0."
    got = found(spark, [long_one, both])
    assert [(i, n) for i, n, _ in got] == [(0, "GPL-3.0"), (1, "MIT"), (1, "CC-BY-4.0"), (1, "CC-BY-SA-4.0")]
    assert [both[s:].startswith(("Released", "Licensed")) for i, _, s in got if i] == [True] * 3


TWINS = {
    "X": ("Use, copying and any distribution of these files are allowed under this license by its holders",),
    "Y": ("Use, copying and any distribution of these notes are allowed under this license by its holders",),
}


def test_compression_decides_between_like_templates(spark, monkeypatch):
    frame = spark.createDataFrame([(1, TWINS["X"][0]), (2, TWINS["Y"][0])], "doc_id long, text string")
    for templates in (TWINS, dict(reversed(TWINS.items()))):
        got = licenses.scan_licenses(frame, templates).orderBy("doc.doc_id").collect()
        assert [(r["license"], r["missing"], r["saved"] > 0.5) for r in got] == [("X", [], True), ("Y", [], True)]
    scanner = licenses.Scanner(tuple((n, t) for n, (t,) in TWINS.items()))
    best = scanner.ranked
    # The wording would allow either; without a saving there is no candidate.
    monkeypatch.setattr(scanner, "ranked", lambda block: [(0.5, i) for _, i in reversed(best(block))])
    assert [(x[1], x[3]) for x in scanner.statements(TWINS["X"][0], 0.1)] == [("Y", ["notes"])]
    monkeypatch.setattr(scanner, "ranked", lambda block: [(0.0, i) for _, i in best(block)])
    assert scanner.statements(TWINS["X"][0], 0.1) == []


def test_decided_stretches_are_not_compared_again(monkeypatch):
    scanner = licenses.Scanner(tuple((n, t) for n, (t,) in TWINS.items()))
    asked = []
    whole = scanner.differences
    monkeypatch.setattr(scanner, "differences", lambda number, have: asked.append(number) or whole(number, have))
    assert [x[1] for x in scanner.statements(TWINS["Y"][0], 0.1)] == ["Y"]
    assert set(asked) == {1}


def every_statement(scanner, block, allowed=0.1):
    """The names found if every template is compared, whatever it saves."""
    have = licenses.words(block)
    found, taken = [], bytearray(len(have))
    for _, number in scanner.ranked(block):
        for first, end, *_ in scanner.confirmed(number, have, bytearray(len(have)), allowed):
            if not any(taken[first:end]):
                taken[first:end] = b"\1" * (end - first)
                found.append(scanner.templates[number][0])
    return sorted(found)


def test_no_statement_is_lost_for_lack_of_a_saving():
    scanner = licenses.scanner(tuple((n, t) for n, texts in licenses.TEMPLATES.items() for t in texts))
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    noise = " ".join(f"w{i * i % 997}x and the license of {i}" for i in range(60))
    blocks = [f"{a} {noise} {b}" for a in texts for b in texts]
    blocks += [" ".join([a, a, *texts, a]) for a in texts]
    rng = random.Random(3)
    blocks += [" ".join([rng.choice((noise, "the license of a version", a)) for _ in range(60)]) for a in texts]
    blocks += [" ".join([noise] * n + [a] + [noise] * 40) for a in texts for n in (0, 7, 40)]
    for block in blocks:
        assert sorted(x[1] for x in scanner.statements(block, 0.1)) == every_statement(scanner, block)
