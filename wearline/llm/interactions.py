"""Audit of how filters interact: what each removes, alone and behind the others, in every order.

Documents are counted per part and set of filters they fail, at most one cell per such set. A walk in
Gray-code order then visits every subset of filters by turning one filter on or off at a time. Each
cell keeps the number of active filters it fails; when that leaves or reaches zero, the cell leaves or
joins the running survivors. The survivors of all subsets are stored, and every step of every order
is a difference of two of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wearline.llm.shared import SPACES, let, text_of, wrap
from wearline.session import materialize

LETTERS = "ABCDE"
COUNTS = ("docs", "good", "toxic")
SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


@dataclass(frozen=True)
class Filters:
    """When a text fails: A too few words, B too few distinct ones, C capitals, D symbols; E is a repeat."""

    min_words: int = 200
    min_distinct_percent: int = 50
    max_capital_percent: int = 3
    symbols: str = "#$%&*|"


DEFAULT = Filters()


def failures(docs: DataFrame, rules: Filters = DEFAULT) -> DataFrame:
    """Distinct ``doc_id, part, mask`` with the number of ``rows``; bit k of mask is the k-th letter.

    A text repeats if any smaller doc_id has it. The first id of a text is found by its digest, and
    rows are matched to it by digest and id, so that copies of one text don't meet in one task.
    """
    words = F.array_remove(F.split("text", SPACES), "")
    counted = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = [
        F.col("words.n") < rules.min_words,
        100 * F.col("words.distinct") < rules.min_distinct_percent * F.col("words.n"),
        100 * capitals > rules.max_capital_percent * F.length("text"),
        F.regexp_like("text", F.lit("[" + "".join("\\" + s for s in rules.symbols) + "]")),
    ]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    texts = wrap(docs).select(
        F.col("doc.doc_id").alias("doc_id"), F.coalesce("doc.lang", F.lit("")).alias("part"), text_of().alias("text")
    )
    judged = texts.withColumn("words", counted).select(
        "doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")
    )
    rows = materialize(judged.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("rows")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    first = first.select(F.col("digest").alias("of"), "first_id")
    found = rows.join(first, (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("first_id")), "left")
    repeat = F.col("doc_id").isNotNull() & F.col("first_id").isNull()
    found = found.withColumn("mask", F.col("mask") + F.when(repeat, 1 << len(fails)).otherwise(0))
    return found.groupBy("doc_id", "part", "mask").agg(F.sum("rows").alias("rows"))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones per ``part`` and ``mask``.

    A document is good or toxic if any of its label rows says 1; without label it is neither.
    """
    by_id = wrap(labels).groupBy(F.col("doc.doc_id").alias("labelled")).agg(
        F.max(F.coalesce((F.col("doc.quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("doc.toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
    )
    joined = failed.join(by_id, F.col("doc_id") == F.col("labelled"), "left")
    return joined.groupBy("part", "mask").agg(
        F.sum("rows").alias("docs"),
        F.sum(F.col("rows") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("rows") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def survivors(counts: np.ndarray) -> np.ndarray:
    """Counts left by every subset of filters; ``counts`` holds one row per mask of failed filters.

    Subsets are walked in Gray-code order, one filter toggled at a time.
    """
    masks = np.arange(len(counts))
    active_failures = np.zeros(len(counts), np.int64)
    alive = counts.sum(axis=0)
    states = np.empty_like(counts)
    states[0] = alive
    active = 0
    for place in range(1, len(counts)):
        subset = place ^ (place >> 1)
        toggled = subset ^ active
        cells_of = (masks & toggled) != 0
        if subset & toggled:
            alive = alive - counts[cells_of & (active_failures == 0)].sum(axis=0)
            active_failures[cells_of] += 1
        else:
            active_failures[cells_of] -= 1
            alive = alive + counts[cells_of & (active_failures == 0)].sum(axis=0)
        active = subset
        states[active] = alive
    return states


def order_steps(counts: np.ndarray, letters: str = LETTERS) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    states = survivors(counts)
    width = len(letters)
    everything = (1 << width) - 1
    bits = [1 << i for i in range(width)]
    failing = [int(states[0, 0] - states[b, 0]) for b in bits]
    alone = [int(states[everything ^ b, 0] - states[everything, 0]) for b in bits]
    shapley = [0] * width
    for i, b in enumerate(bits):
        for before in range(everything + 1):
            if not before & b:
                size = before.bit_count()
                orders = factorial(size) * factorial(width - 1 - size)
                shapley[i] += orders * int(states[before, 0] - states[before | b, 0])
    for order in permutations(range(width)):
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | bits[i]
            lost = states[before] - states[after]
            removed = int(lost[0])
            yield (
                name, step, int(states[after, 0]), removed, failing[i] - removed, alone[i],
                int(lost[1]), int(lost[2]), shapley[i],
            )
            before = after


def _steps_of_part(part: pd.DataFrame) -> pd.DataFrame:
    counts = np.zeros((1 << len(LETTERS), len(COUNTS)), np.int64)
    counts[part["mask"].to_numpy()] = part[list(COUNTS)].to_numpy()
    columns: Sequence[str] = [c.split()[0] for c in SCHEMA.split(", ")]
    name = part["part"].iloc[0]
    return pd.DataFrame([(name, *row) for row in order_steps(counts)], columns=list(columns))


def audit(docs: DataFrame, labels: DataFrame, rules: Filters = DEFAULT) -> DataFrame:
    """Per part, order of the five filters and step: what is kept and what the step's filter removes.

    Parts are the values of ``lang``; null and empty are one part. Null text is empty. Rows repeated
    in all columns are documents of their own and no repeats of each other, as none has a
    smaller id; a document without id never fails E and has no labels. Several label rows of an id count
    as one that says 1 where any does. Columns but doc_id, text, lang, quality and toxic are not read.
    Empty documents give no rows; empty labels lose nothing good or toxic. A part's at most 32 cells meet in one task.
    """
    counted = cells(failures(docs, rules), labels)
    return counted.groupBy("part").applyInPandas(_steps_of_part, SCHEMA)
