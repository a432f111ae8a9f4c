"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words. A document's expected number of copies grows with the
length class of its text and is scaled so that a source's expected words meet its target. The whole
part is taken for certain. The rest is its inclusion probability in an order sample: documents are
ranked by the odds of a random number divided by the odds of inclusion, and taken in this
order until the words that are still open are filled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wearline.llm.shared import SPACES, text_of, wrap
from wearline.operators.ordered import row_index
from wearline.session import broadcast_if_small, materialize

MOST_COPIES = 2
LEVELS = 16
BINS = 4096


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = MOST_COPIES
) -> DataFrame:
    """Targets of ``sizes`` (source, source_size): weights by code point order, null last.

    Targets share ``share`` of all words by weight, none above ``most`` times its source; what is
    cut off goes to the others by weight. One row per source goes through one window, so
    ``sizes`` must be grouped already.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1)
    filled = Window.orderBy("ratio", "place")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    frame = ranked.withColumn("weight", weight).withColumn("ratio", F.col("source_size") / F.col("weight"))
    frame = frame.withColumns(
        {
            "words_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "all_words": F.sum("source_size").over(Window.partitionBy()),
            "all_weight": F.sum("weight").over(Window.partitionBy()),
        }
    )
    # If the sources of a smaller ratio are full, this is what one unit of weight gets of the rest.
    rate = (share * F.col("all_words") - most * F.col("words_before")) / (
        F.col("all_weight") - F.col("weight_before")
    )
    frame = frame.withColumn("rate", F.when(rate <= most * F.col("ratio"), rate))
    frame = frame.withColumn("rate", F.min_by("rate", F.when(F.col("rate").isNotNull(), F.col("ratio"))).over(Window.partitionBy()))
    most_words = most * F.col("source_size").cast("double")
    target = F.least(most_words, F.coalesce(F.col("rate") * F.col("weight"), most_words))
    return frame.select("source", "source_size", target.alias("target"))


def _expected(levels: DataFrame, most: int) -> DataFrame:
    """Expected copies per (source, level): in proportion to preference, at most ``most``.

    The steepest levels reach the most first; the first level whose scale keeps it below sets it.
    """
    down = Window.partitionBy("source").orderBy(F.col("level").desc())
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    source = Window.partitionBy("source")
    wanted = F.col("preference") * F.col("words")
    frame = levels.withColumns(
        {
            "full": most * F.coalesce(F.sum("words").over(before), F.lit(0)),
            "left": F.sum(wanted).over(source) - F.coalesce(F.sum(wanted).over(before), F.lit(0.0)),
        }
    )
    scale = F.when(F.col("left") > 0, (F.col("target") - F.col("full")) / F.col("left"))
    fits = (scale >= 0) & (scale * F.col("preference") <= most)
    frame = frame.withColumn("scale", F.max_by(scale, F.when(fits, F.col("level"))).over(source))
    expected = F.least(F.lit(float(most)), F.coalesce(F.col("scale") * F.col("preference"), F.lit(float(most))))
    return frame.withColumn("expected", F.when(F.col("target") > 0, expected).otherwise(F.lit(0.0)))


def draw(key: Column, copy: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that depends on key, copy and seed only."""
    again = F.when(copy > 0, F.concat(F.lit("#"), copy.cast("string"))).otherwise(F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), again))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**48))


def with_sizes(docs: DataFrame) -> DataFrame:
    """``doc`` (all columns) with ``source``, ``size`` in words, its length ``level`` and key."""
    words = F.array_remove(F.split(text_of(), SPACES), "")
    frame = wrap(docs).select("doc", F.size(words).cast("long").alias("size"))
    level = F.least(F.length(F.bin("size")), F.lit(LEVELS))
    return frame.select(
        "doc",
        F.col("doc.doc_id").alias("key"),
        F.col("doc.source").alias("source"),
        "size",
        level.alias("level"),
    )


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def numbered(sized: DataFrame, compact: DataFrame) -> DataFrame:
    """``sized`` with ``copy``: 0, 1, ... within rows of one key, source and size, so that each has its own draw.

    ``compact`` is a written table with the same rows. Only rows that have equals are numbered, in ranges
    that cut also the largest group.
    """
    identity = ["key", "source", "size"]
    groups = compact.groupBy(*identity).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    again = materialize(groups.select(*[F.col(c).alias(f"_{c}") for c in identity]))
    if not again.take(1):
        return sized.withColumn("copy", F.lit(0).cast("long"))
    same = reduce(Column.__and__, [_same(c, f"_{c}") for c in identity])
    again = broadcast_if_small(again)
    once = sized.join(again, same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    content = F.xxhash64("doc") if "doc" in sized.columns else F.lit(0).cast("long")
    repeated = sized.join(again, same, "left_semi").withColumn("content", content)
    # The number is fixed once the rows are written; it tells rows with the same content apart.
    repeated = materialize(repeated.withColumn("written", F.monotonically_increasing_id()))
    counted = row_index(repeated, ["content", "written"], identity, name="copy")
    return once.unionByName(counted.drop("content", "written"))


def _ranked(sized: DataFrame, levels: DataFrame, seed: int) -> DataFrame:
    """Adds target, whole copies and the Pareto rank, null if the copies are whole."""
    plan = levels.select(
        F.col("source").alias("in_source"),
        F.col("level").alias("in_level"),
        "source_size",
        "target",
        F.floor("expected").cast("int").alias("whole"),
        (F.col("expected") - F.floor("expected")).alias("inclusion"),
    )
    frame = sized.join(
        broadcast_if_small(plan), _same("source", "in_source") & (F.col("level") == F.col("in_level"))
    ).drop("in_source", "in_level")
    u = draw(F.col("key"), F.col("copy"), seed)
    odds = (u / (1 - u)) / (F.col("inclusion") / (1 - F.col("inclusion")))
    return frame.withColumn("pareto", F.when((F.col("inclusion") > 0) & (F.col("size") > 0), odds))


def _cuts(ranked: DataFrame) -> DataFrame:
    """Per source the last rank taken, by (pareto, key, size).

    Ranks are binned first, so that only one bin of a source is ever put in order: the one in
    which the open words run out. A document is taken if it brings the words nearer to the target.
    """
    open_words = F.col("target") - F.col("certain")
    certain = ranked.groupBy("source", "target").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    certain = certain.select(F.col("source").alias("in_source"), open_words.alias("open"))
    sampled = ranked.where(F.col("pareto").isNotNull()).withColumn(
        "bin", F.floor(F.col("pareto") / (1 + F.col("pareto")) * BINS)
    )
    bins = sampled.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("after", F.sum("words").over(running))
    bins = bins.join(broadcast_if_small(certain), _same("source", "in_source")).drop("in_source")
    crossing = (
        bins.where(F.col("after") > F.col("open"))
        .groupBy("source", "open")
        .agg(F.min("bin").alias("cut_bin"), F.min(F.struct("bin", "after", "words")).alias("at"))
        .select(
            F.col("source").alias("in_source"),
            "open",
            "cut_bin",
            (F.col("at.after") - F.col("at.words")).alias("before"),
        )
    )
    crossing = materialize(crossing)
    inside = sampled.join(
        broadcast_if_small(crossing), _same("source", "in_source") & (F.col("bin") == F.col("cut_bin"))
    )
    ordered = Window.partitionBy("source").orderBy("pareto", "key", "size")
    inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(ordered) - F.col("size") / 2)
    last = (
        inside.where(F.col("upto") <= F.col("open"))
        .groupBy("in_source")
        .agg(F.max(F.struct("pareto", "key", "size")).alias("last"))
    )
    return crossing.join(last.withColumnRenamed("in_source", "of"), _same("in_source", "of"), "left").select(
        F.col("in_source").alias("cut_source"), "cut_bin", "last"
    )


def mixing_plan(
    sized: DataFrame, weights: Sequence[int], share: float, most: int, seed: int
) -> tuple[DataFrame, DataFrame]:
    """(levels, cuts): expected copies per source and level, and where each source's sample ends."""
    groups = materialize(sized.groupBy("source", "level").agg(F.sum("size").alias("words")))
    sizes = groups.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "of")
    preference = (F.lit(8.0) + F.col("level")) / 8.0
    levels = groups.join(targets, _same("source", "of")).drop("of").withColumn("preference", preference)
    levels = materialize(_expected(levels, most))
    return levels, materialize(_cuts(_ranked(sized, levels, seed)))


def apply_plan(sized: DataFrame, levels: DataFrame, cuts: DataFrame, seed: int) -> DataFrame:
    """Each row of ``sized`` with its ``copies`` and ``taken`` words."""
    frame = _ranked(sized, levels, seed).join(
        broadcast_if_small(cuts), _same("source", "cut_source"), "left"
    )
    rank = F.struct("pareto", "key", "size")
    bin_of = F.floor(F.col("pareto") / (1 + F.col("pareto")) * BINS)
    within = (
        F.col("cut_bin").isNull()
        | (bin_of < F.col("cut_bin"))
        | ((bin_of == F.col("cut_bin")) & F.coalesce(rank <= F.col("last"), F.lit(False)))
    )
    picked = F.col("pareto").isNotNull() & within
    frame = frame.withColumn("copies", F.col("whole") + picked.cast("int"))
    return frame.withColumn("taken", F.col("copies") * F.col("size")).drop(
        "cut_source", "cut_bin", "last", "pareto", "inclusion", "whole", "level"
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    most: int = MOST_COPIES,
    seed: int = 17,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """How often the mix takes each row: ``doc, size, source_size, target, copies, taken``.

    ``carry`` names the columns that ``doc`` keeps; None keeps all. Null text has size 0 and takes no
    words; a source without words has target 0. A null source is a source, the last one. Repeated rows, and
    rows without doc_id, are drawn one by one. Reruns agree; an empty table gives no rows.
    """
    sized = with_sizes(docs)
    kept = F.struct(*[F.col(f"doc.`{c}`") for c in carry or ()])
    compact = materialize(sized.withColumn("doc", kept) if carry else sized.drop("doc"))
    drawn = numbered(compact, compact)
    levels, cuts = mixing_plan(drawn, weights, share, most, seed)
    rows = drawn if carry else numbered(sized, compact)
    return apply_plan(rows, levels, cuts, seed).drop("key", "source", "copy")


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken."""
    mixed = mix(docs, **options).where(F.col("copies") > 0)
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")
