"""Shards that all hold the mixture: proportional stratified interleaving.

Each source's rows are shuffled by a seeded hash and ranked. A row's fractional rank is its rank in its
source divided by the source's rows, shifted by a seeded part of one rank, so that small sources don't
all start at the same place. All rows in order of fractional rank hold every source in proportion
at every length, and equal cuts of that order are the shards.

No source and no group of equal rows is ever put in order in one task: ranks come from totals of
hash ranges, positions from totals of ranges of the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wearline.llm.shared import text_of, wrap
from wearline.session import broadcast_if_small, materialize

# Rows per range that is put in order, and the most ranges of a source or of all rows.
RANGE_ROWS = 2048
MOST_RANGES = 65536
# Equal rows travel as one row with a count, up to this many.
TOGETHER = 1024
_SPAN = float(2**48)


def _hash(*parts: Column) -> Column:
    """48 bits as a long; null parts are empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 12), 16, 10).cast("long")


def _ranges(rows: Column) -> Column:
    return F.least(F.ceil(rows / RANGE_ROWS), F.lit(MOST_RANGES))


def _before(totals: DataFrame, value: str, place: str, *keys: str) -> DataFrame:
    """``totals`` with ``before``: the sum of ``value`` at earlier places of the same keys."""
    order = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("before", F.coalesce(F.sum(value).over(order), F.lit(0)))


def _counted(docs: DataFrame, carry: Sequence[str] | None, seed: int) -> DataFrame:
    """Equal rows once, with ``rows`` up to TOGETHER and the hash ``u`` that shuffles them."""
    kept = F.col("doc") if carry is None else F.struct(*[F.col(f"doc.`{c}`") for c in carry])
    sized = wrap(docs).select(
        kept.alias("doc"),
        F.col("doc.doc_id").alias("key"),
        F.col("doc.source").alias("source"),
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("crc"),
    )
    grouped = sized.groupBy("doc", "key", "source", "size", "crc").agg(F.count(F.lit(1)).alias("all"))
    last = F.floor((F.col("all") - 1) / TOGETHER)
    split = grouped.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = F.least(F.lit(TOGETHER).cast("long"), F.col("all") - F.col("part") * TOGETHER)
    u = _hash(F.lit(seed), F.col("key"), F.col("crc"), F.col("part"))
    return split.select("doc", "key", "source", "size", "crc", "part", rows.alias("rows"), u.alias("u"))


def _fractions(rows: DataFrame, seed: int) -> DataFrame:
    """Every row on its own with its ``fraction`` of the way through its source."""
    sources = rows.groupBy("source").agg(F.sum("rows").alias("n"))
    shift = (_hash(F.lit(seed), F.lit("source"), F.col("source")) + F.lit(0.5)) / F.lit(_SPAN)
    sources = materialize(
        sources.select(F.col("source").alias("of"), "n", _ranges(F.col("n")).alias("ranges"), shift.alias("shift"))
    )
    placed = rows.join(broadcast_if_small(sources), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = placed.withColumn("range", F.floor(F.col("u") / F.lit(_SPAN) * F.col("ranges")))
    totals = placed.groupBy("source", "range").agg(F.sum("rows").alias("held"))
    starts = _before(totals, "held", "range", "source").select(
        F.col("source").alias("of"), F.col("range").alias("at"), "before"
    )
    starts = broadcast_if_small(materialize(starts))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")))
    inside = Window.partitionBy("source", "range").orderBy("u", "key", "size", "crc", "part")
    first = F.col("before") + F.sum("rows").over(inside) - F.col("rows")
    one = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))
    ranked = placed.withColumn("first", first).withColumn("nth", one)
    fraction = (F.col("first") + F.col("nth") + F.col("shift")) / F.col("n")
    return ranked.select("doc", "key", "size", "crc", "part", "u", fraction.alias("fraction"))


def assign_shards(
    docs: DataFrame, shards: int = 16, seed: int = 23, carry: Sequence[str] | None = None
) -> DataFrame:
    """Every row's place: ``doc, size, text_crc32, shard, slot``.

    Numbers of rows per shard differ by one at most; slots of a shard are gapless from 0. ``carry``
    names the columns that ``doc`` keeps; None keeps all. Size is the text's bytes plus one; a null text
    has none. A null source is a source of its own. Rows equal in all they carry are interchangeable;
    documents of equal text are spread like all others, as no law of equal counts could keep large groups
    of them together. Fewer rows than shards leave shards empty; an empty table gives no rows. Reruns agree.
    """
    rows = materialize(_counted(docs, carry, seed))
    frame = materialize(_fractions(rows, seed))
    total = frame.agg(F.count(F.lit(1)).alias("total"))
    frame = frame.join(F.broadcast(total))
    frame = frame.withColumn("cut", F.floor(F.col("fraction") * _ranges(F.col("total"))))
    totals = frame.groupBy("cut").agg(F.count(F.lit(1)).alias("held"))
    starts = _before(totals, "held", "cut").select(F.col("cut").alias("at"), "before")
    starts = broadcast_if_small(materialize(starts))
    order = Window.partitionBy("cut").orderBy("fraction", "u", "key", "size", "crc", "part")
    frame = frame.join(starts, F.col("cut") == F.col("at"))
    frame = frame.withColumn("place", F.col("before") + F.row_number().over(order) - 1)
    return frame.withColumn("shard", F.expr(f"int((place * {shards}) div total)")).select(
        "doc",
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        F.expr(f"place - (shard * total + {shards - 1}) div {shards}").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 23) -> None:
    """The rows of ``docs`` with all columns, one folder per shard, every file sorted by slot."""
    placed = assign_shards(docs, shards, seed).select("shard", "slot", "doc")
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
