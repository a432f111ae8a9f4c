"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are compared with
the reference of its language by the Jensen-Shannon distance. The references are measured on all
documents of the language, so a document is judged against its peers and no model is shipped.
Everything is built-in column functions; texts are scanned once and their histograms written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from wearline.llm.shared import SPACES, let, text_of, wrap
from wearline.session import materialize

# Very common function words of each language, the bins of the word histogram.
COMMON_WORDS: Mapping[str, Sequence[str]] = {
    "en": "the of and to in a is that for it as was with be by on".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht".split(),
    "es": "de la que el en y a los del se las por un para con no".split(),
}

# Character classes among printable ASCII without small letters. Three bins follow them: bytes
# beyond the first of each character (a measure of other scripts), white space, and the rest.
CLASSES = {
    "upper": "A-Z",
    "digit": "0-9",
    "symbol": "#*$%&|<>",
    "punctuation": ".,;:!?()'\"-",
}
NOT_RARE = r"[^!-`{-~]+"


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules.

    A histogram is judged only if the document has at least ``min_chars`` characters or
    ``min_words`` words, and only against a reference of at least ``min_reference`` words; short
    texts are too noisy. Distances lie between 0 and 1.
    """

    min_words_kept: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    min_chars: int = 200
    min_words: int = 80
    min_reference: int = 500
    max_class_distance: float = 0.25
    max_word_distance: float = 0.28
    common_words: Mapping[str, Sequence[str]] = field(default_factory=lambda: COMMON_WORDS)


DEFAULT = QualityRules()


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words inside windows of ``window`` words that occur at least twice in ``words``.

    Windows are compared by 64-bit hashes. Only texts with a repeated hash pay for the sort.
    """
    n = F.size(words) - (window - 1)

    def longer(grams: Column, step: int) -> Column:
        shifted = F.slice(grams, 1 + step, F.greatest(F.size(grams) - step, F.lit(0)))
        return F.zip_with(grams, shifted, lambda a, b: F.xxhash64(a, b))

    def windows(h: Column) -> Column:
        """Hashes of all windows, each built from two shorter overlapping ones."""

        def build(grams: Column, length: int) -> Column:
            if length == window:
                return F.slice(grams, 1, n)
            step = min(length, window - length)
            return let(longer(grams, step), lambda g: build(g, length + step))

        return build(h, 1)

    hashes = F.when(
        n > 1, let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        step = F.transform(
            starts, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - p, F.lit(window)))
        )
        return F.aggregate(step, F.lit(0), lambda total, s: total + s)

    def starts_of(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda e, k: (F.get(ordered, k - 1)["h"] == e["h"]) | (F.get(ordered, k + 1)["h"] == e["h"]),
        )
        return F.array_sort(F.transform(twice, lambda e: e["p"]))

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            let(F.sort_array(pairs), lambda ordered: let(starts_of(ordered), covered)),
        ).otherwise(F.lit(0))

    return let(hashes, count)


def _distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts, each with a positive sum."""
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    def part(x: Column, mean: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / mean)).otherwise(F.lit(0.0))

    def of(sums: Column) -> Column:
        terms = F.zip_with(
            counts,
            reference,
            lambda p, r: let(
                F.struct((p / sums["p"]).alias("p"), (r / sums["r"]).alias("r")),
                lambda x: let(
                    (x["p"] + x["r"]) / 2, lambda m: (part(x["p"], m) + part(x["r"], m)) / 2
                ),
            ),
        )
        return F.sqrt(F.greatest(F.lit(0.0), total(terms)))

    return let(F.struct(total(counts).alias("p"), total(reference).alias("r")), of)


def _language_words(docs: DataFrame, rules: QualityRules) -> DataFrame:
    rows = [(lang, list(words)) for lang, words in rules.common_words.items()]
    return docs.sparkSession.createDataFrame(rows, "language string, common array<string>")


def _measure(
    docs: DataFrame, rules: QualityRules, carry: Sequence[str] | None = None
) -> DataFrame:
    """Each row's ``doc`` with counts and histograms, in one scan of the texts."""
    listed = sorted({w for words in rules.common_words.values() for w in words})
    text = text_of()
    frame = wrap(docs).withColumn("words", F.array_remove(F.split(text, SPACES), ""))
    frame = frame.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    frame = frame.withColumn("rare", F.regexp_replace(text, NOT_RARE, ""))
    frame = frame.withColumns(
        {
            f"n_{name}": F.length(F.regexp_replace("rare", f"[^{members}]+", "")).cast("long")
            for name, members in CLASSES.items()
        }
    )
    frame = frame.withColumn("seen", F.filter("words", lambda w: w.isin(listed)))
    # One row per language of the parameter: a bounded broadcast.
    languages = F.broadcast(_language_words(docs, rules))
    frame = frame.join(languages, F.col("doc.lang") == F.col("language"), "left")
    lines = F.filter(
        F.split(text, "\n"), lambda line: F.length(F.trim(line, F.lit(" \t\n\x0b\f\r"))) > 0
    )
    frame = frame.withColumn("lines", lines)
    n_words = F.size("words").cast("long")
    n_chars = F.length(text).cast("long")
    counted = [F.col(f"n_{name}") for name in CLASSES]
    found = F.transform("common", lambda w: (F.size("seen") - F.size(F.array_remove("seen", w))).cast("long"))
    kept = "doc" if carry is None else F.struct(*[F.col(f"doc.`{c}`") for c in carry]).alias("doc")
    return frame.select(
        kept,
        "language",
        n_words.alias("n_words"),
        "word_chars",
        n_chars.alias("n_chars"),
        F.col("n_symbol").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words"), rules.window).cast("long").alias("n_repeat_words"),
        F.array(
            *counted,
            F.octet_length(text).cast("long") - n_chars,
            n_chars - F.col("word_chars"),
            F.col("word_chars") - sum(counted[1:], counted[0]),
        ).alias("classes"),
        let(
            found,
            lambda f: F.concat(
                f, F.array(n_words - F.aggregate(f, F.lit(0).cast("long"), lambda total, x: total + x))
            ),
        ).alias("common_counts"),
    )


def _references(measured: DataFrame, rules: QualityRules) -> DataFrame:
    """Summed histograms per listed language: at most one row per language of the rules."""
    bins = max(len(words) for words in rules.common_words.values()) + 1
    n_classes = len(CLASSES) + 3
    sums = (
        measured.where(F.col("language").isNotNull())
        .groupBy(F.col("language").alias("ref_language"))
        .agg(
            *[F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(n_classes)],
            *[F.sum(F.get("common_counts", F.lit(i))).alias(f"w{i}") for i in range(bins)],
        )
    )
    return sums.select(
        "ref_language",
        F.array(*[F.col(f"c{i}") for i in range(n_classes)]).alias("ref_classes"),
        F.array_compact(F.array(*[F.col(f"w{i}") for i in range(bins)])).alias("ref_words"),
    )


def judge(
    docs: DataFrame, rules: QualityRules = DEFAULT, carry: Sequence[str] | None = None
) -> DataFrame:
    """Every row of ``docs`` with its measures and verdict, as ``doc`` and plain columns.

    Returns ``doc`` (struct of the input columns), ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, class_distance, word_distance, base_failed, kept``. ``carry`` names the columns
    that ``doc`` keeps besides the text, which is then left out; None keeps all.

    Null text counts as empty: no words, base failed. A null or unlisted language, or one with
    little text, has no reference: only the base rules decide. A text below the length guards is
    not compared. Repeated rows each get their own, equal row. An empty table gives no rows.
    """
    measured = materialize(_measure(docs, rules, carry))
    known = _references(measured, rules)
    frame = measured.join(F.broadcast(known), F.col("language") == F.col("ref_language"), "left")
    reference_words = F.aggregate("ref_words", F.lit(0).cast("long"), lambda total, x: total + x)
    trusted = F.col("ref_language").isNotNull() & (reference_words >= rules.min_reference)
    frame = frame.select(
        "doc",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        F.when(
            trusted & (F.col("n_chars") >= rules.min_chars),
            _distance(F.col("classes"), F.col("ref_classes")),
        ).alias("class_distance"),
        F.when(
            trusted & (F.col("n_words") >= rules.min_words),
            _distance(F.col("common_counts"), F.col("ref_words")),
        ).alias("word_distance"),
    )
    failed = (F.col("n_words") < rules.min_words_kept) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    far = (F.coalesce("class_distance", F.lit(0.0)) > rules.max_class_distance) | (
        F.coalesce("word_distance", F.lit(0.0)) > rules.max_word_distance
    )
    return frame.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


def keep_good(docs: DataFrame, rules: QualityRules = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    return judge(docs, rules).where("kept").select("doc.*")
