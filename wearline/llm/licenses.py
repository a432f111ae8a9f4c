"""License scans by conditional compression.

Blocks of text around license words are compressed with each template as a raw dictionary. Every
template that makes its block smaller is a candidate; the best saving is confirmed first, by the exact
differences in wording: words of the template that the text lacks, and words it has in between. A
stretch of words belongs to the first template confirmed there, and no later one is compared with it.
"""

from __future__ import annotations

import difflib
import functools
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wearline.llm.shared import wrap

# Common license statements and notices, by SPDX identifier.
TEMPLATES: Mapping[str, Sequence[str]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file'
        " except in compliance with the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        ' associated documentation files (the "Software"), to deal in the Software without restriction',
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
        " General Public License as published by the Free Software Foundation, either version 3 of the"
        " License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

# Lower levels skip ahead in text without matches and miss a short statement at its end.
LEVEL = 9
TRIGGER = r"(?i)licen[cs]e|permission\W+is\W+hereby|redistribution\W+and\W+use|public\W+domain|copyleft"
AROUND = 600  # least characters of a block before and after a license word
_FOUND = re.compile(TRIGGER[4:], re.IGNORECASE)
_EMPTY_LINE = re.compile(r"\n[ \t\r]*\n")
_WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def blocks(text: str, reach: int = AROUND) -> Iterator[tuple[int, str]]:
    """(start, text) of the stretches around license words.

    Each reaches ``reach`` characters to both sides of its license words, over line feeds but not
    over empty lines. Stretches that touch are one.
    """
    start = end = -1
    for hit in _FOUND.finditer(text):
        low, high = max(0, hit.start() - reach), min(len(text), hit.end() + reach)
        for low in (m.end() for m in _EMPTY_LINE.finditer(text, low, hit.start())):
            pass
        gap = _EMPTY_LINE.search(text, hit.end(), high)
        high = gap.start() if gap else high
        if start >= 0 and low > end:
            yield start, text[start:end]
            start = low
        start = low if start < 0 else start
        end = max(end, high)
    if start >= 0:
        yield start, text[start:end]


class Scanner:
    """Templates with their compressors, made once per Python worker."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.templates = [(name, words(text)) for name, text in templates]
        self.counts = [Counter(want) for _, want in self.templates]
        # Line feeds and comment marks stretch a notice.
        self.reach = max([AROUND, *(2 * len(text) for _, text in templates)])
        self.given = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(
                    text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
                ),
            )
            for _, text in templates
        ]

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(share of the compressed size that the template saves, its number), best first.

        Long blocks are compressed in parts that overlap by the reach of a statement; the best part counts.
        """
        block = block.lower()
        saved = [-1.0] * len(self.given)
        for at in range(0, max(1, len(block) - self.reach), 3 * self.reach):
            data = block[at : at + 4 * self.reach].encode("utf-8", "replace")
            alone = len(self.plain.compress(data))
            saved = [max(s, 1 - len(c.compress(data)) / alone) for s, c in zip(saved, self.given)]
        return sorted(((s, i) for i, s in enumerate(saved)), key=lambda x: (-x[0], x[1]))

    def differences(self, number: int, have: list[str]) -> tuple[int, int, list[str], list[str]]:
        """(first and last + 1 matching word, template words lacking, words in between)."""
        want = self.templates[number][1]
        runs = difflib.SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks()[:-1]
        if not runs:
            return 0, 0, want, []
        in_want = {i for r in runs for i in range(r.a, r.a + r.size)}
        in_have = {i for r in runs for i in range(r.b, r.b + r.size)}
        first, end = runs[0].b, runs[-1].b + runs[-1].size
        missing = [w for i, w in enumerate(want) if i not in in_want]
        return first, end, missing, [have[i] for i in range(first, end) if i not in in_have]

    def confirmed(self, number: int, have: list[str], taken: bytearray, allowed: float) -> list[tuple[int, int, list[str], list[str]]]:
        """The template's places among the words ``have`` that are not ``taken``, the most alike first."""
        want = self.templates[number][1]
        limit = int(allowed * len(want) + 1e-9)
        if (self.counts[number] - Counter(have)).total() > limit:
            return []
        # At most ``limit`` words lack, so one of the first ``limit + 1`` begins the statement.
        begins, out = set(want[: limit + 1]), []
        for at, word in enumerate(have):
            if taken[at] or word not in begins:
                continue
            part = have[at : at + len(want) + limit]
            if (self.counts[number] - Counter(part)).total() > limit:
                continue
            first, end, missing, extra = self.differences(number, part)
            naming = any(w in self.naming or any(c.isdigit() for c in w) for w in missing + extra)
            if len(missing) <= limit and len(extra) <= limit and not naming:
                out.append((at + first, at + end, missing, extra))
        return sorted(out, key=lambda x: (len(x[2]) + len(x[3]), x[0]))

    def statements(self, block: str, allowed: float) -> list[tuple[int, str, float, list[str], list[str]]]:
        """(start, license, saved, missing, extra) of the block's statements, none over another."""
        places = [m.span() for m in _WORDS.finditer(block)]
        have = [block[a:b].lower() for a, b in places]
        taken, out = bytearray(len(have)), []
        for saved, number in self.ranked(block):
            if saved <= 0:
                break
            for first, end, missing, extra in self.confirmed(number, have, taken, allowed):
                if not any(taken[first:end]):
                    taken[first:end] = b"\1" * (end - first)
                    out.append((places[first][0], self.templates[number][0], saved, missing, extra))
        return sorted(out)

    # Words that tell one license from another; a difference in them is never accepted.
    naming = frozenset(
        "apache mit gnu general lesser affero public mozilla bsd bsd-style cc cc0 by by-sa by-nc by-nd"
        " attribution sharealike noncommercial".split()
    )


@functools.lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(templates)


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    allowed: float = 0.1,
) -> DataFrame:
    """Every license statement: ``doc``, ``start``, ``license``, ``saved``, ``missing``, ``extra``.

    ``start`` is the statement's first character; ``saved`` the share of its block's compressed size
    that the template saves; ``missing`` and ``extra`` the differing words, at most ``allowed`` of the
    template's words each. Templates that save nothing are no candidates; of statements that overlap
    the best saving stays, at equal saving the earlier template. Null and empty
    texts have none; texts are read whole; a repeated row repeats its rows; an empty table gives none.
    """
    listed = tuple((name, text) for name, texts in templates.items() for text in texts)

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = scanner(listed)
        for batch in batches:
            out = []
            for text in batch:
                rows = []
                for start, block in blocks(text.as_py() or "", known.reach):
                    for at, name, saved, missing, extra in known.statements(block, allowed):
                        rows.append({"start": start + at, "license": name, "saved": saved, "missing": missing, "extra": extra})
                out.append(rows)
            yield pa.array(out, kind)

    item = [
        ("start", pa.int64()),
        ("license", pa.string()),
        ("saved", pa.float64()),
        ("missing", pa.list_(pa.string())),
        ("extra", pa.list_(pa.string())),
    ]
    kind = pa.list_(pa.struct(item))
    result = "array<struct<start:bigint,license:string,saved:double,missing:array<string>,extra:array<string>>>"
    # Most texts hold no license word and never reach Python.
    candidates = wrap(docs).where(F.col("doc.text").rlike(TRIGGER))
    found = candidates.withColumn("found", F.arrow_udf(find, result)(F.col("doc.text")))
    return found.select("doc", F.inline("found"))
