"""Ordered computations without a one-task sort: running totals, row numbers, row frames.

``Window.orderBy`` with no partition, or with one very large partition, sends those rows to
one task. Above ``rows_per_bucket`` rows the table is therefore partitioned by ranges of the keys
and the whole order, in their own types, and written once with its range numbers. Each (key, range)
is one window partition, and the totals of a key's earlier ranges are added. As ranges follow keys
and order together, a hot key or a hot value is spread by what comes after it, and only keys
that lie in several ranges need totals: never more than two per range.

Smaller inputs use a plain window per key, which puts the rows in the same order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from wearline.session import materialize

_R = "_range"

ROWS_PER_BUCKET = 1_000_000
# Choices of plan only; results are the same on both sides.
# Ranges of a table below the usual size each; more rows than that make them larger, not more, as the
# sample behind their borders, the tasks and the broadcast totals all grow with their number.
MAX_SMALL_RANGES = 200
MAX_SKETCHES = 100
NARROW_BUCKETS = 20
_SKETCH_ACCURACY = 10_000


@dataclass(frozen=True)
class Ranged:
    """A table laid out for ordered passes by ``keys`` and ``order``.

    If ``cut``, ``frame`` has a column with the range numbers, fixed by having been written.
    """

    frame: DataFrame
    order: tuple[str, ...]
    keys: tuple[str, ...]
    cut: bool

    def over(self, frame: DataFrame) -> Ranged:
        """The same layout with further columns."""
        return replace(self, frame=frame)

    def plain(self) -> DataFrame:
        return self.frame.drop(_R)

    def window(self):
        """Rows of a key in order, as far as they lie in one range."""
        place = [*self.keys, *([_R] if self.cut else [])]
        return Window.partitionBy(*(place or [F.lit(0)])).orderBy(*self.order)


def arrange(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> Ranged:
    """Lay ``df`` out once for any number of ordered passes: one count, and above it one shuffle.

    Ranges smaller than ``ROWS_PER_BUCKET`` are at most ``MAX_SMALL_RANGES``, and hold more rows instead.
    """
    rows = df.count()
    if rows <= rows_per_bucket:
        return Ranged(df, tuple(order), tuple(keys), False)
    usual = max(MAX_SMALL_RANGES, -(-rows // ROWS_PER_BUCKET))
    parts = min(-(-rows // rows_per_bucket), usual)
    placed = df.repartitionByRange(parts, *keys, *order).withColumn(_R, F.spark_partition_id())
    return Ranged(materialize(placed), tuple(order), tuple(keys), True)


_FUNCTIONS = {"sum": F.sum, "min": F.min, "max": F.max}


def add_running(
    ranged: Ranged, totals: Mapping[str, tuple[str, str]], grand: Mapping[str, str] | None = None
) -> Ranged:
    """:func:`running` on an arranged table, which stays arranged."""
    grand = dict(grand or {})
    upto = ranged.window().rowsBetween(Window.unboundedPreceding, 0)
    whole = ranged.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    frame = ranged.frame
    local = frame.select(
        "*",
        *[_FUNCTIONS[how](c).over(upto).alias(n) for n, (how, c) in totals.items()],
        *[F.sum(c).over(whole).alias(n) for n, c in grand.items()],
    )
    if not ranged.cut:
        return ranged.over(local)
    keys = list(ranged.keys)
    per_range = frame.groupBy(*keys, _R).agg(
        *[_FUNCTIONS[how](c).alias(f"_t_{n}") for n, (how, c) in totals.items()],
        *[F.sum(c).alias(f"_g_{n}") for n, c in grand.items()],
    )
    ranges = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(_R)
    all_ranges = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *[F.col(c).alias(f"_k_{c}") for c in [*keys, _R]],
        *[_FUNCTIONS[how](f"_t_{n}").over(before).alias(f"_o_{n}") for n, (how, _) in totals.items()],
        *[F.sum(f"_g_{n}").over(all_ranges).alias(f"_w_{n}") for n in grand],
        F.count("*").over(all_ranges).alias("_parts"),
    )
    # Keys of several ranges only: at most two (key, range) pairs per range border.
    offsets = F.broadcast(materialize(offsets.where(F.col("_parts") > 1).drop("_parts")))
    match = F.lit(True)
    for c in [*keys, _R]:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))

    def combine(name: str, how: str) -> Column:
        mine, earlier = F.col(name), F.col(f"_o_{name}")
        if how == "sum":
            both = mine + earlier
        else:
            both = F.least(mine, earlier) if how == "min" else F.greatest(mine, earlier)
        # ``least``/``greatest`` skip nulls; a sum with a missing part keeps the other part.
        return F.coalesce(both, mine, earlier).alias(name)

    combined = [combine(n, how) for n, (how, _) in totals.items()]
    grands = [F.coalesce(f"_w_{n}", n).alias(n) for n in grand]
    return ranged.over(local.join(offsets, match, "left").select(*frame.columns, *combined, *grands))


def running(
    df: DataFrame,
    order: Sequence[str],
    totals: Mapping[str, tuple[str, str]],
    keys: Sequence[str] = (),
    *,
    grand: Mapping[str, str] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add inclusive running values: ``totals = {new_column: ("sum"|"min"|"max", column)}``.

    ``grand`` adds the overall sum of a column per key: ``{new_column: column}``.
    Rows equal in ``order`` get an arbitrary but fixed sequence, so make ``order`` unique per
    key, or aggregate by it first.
    """
    ranged = arrange(df, order, keys, rows_per_bucket=rows_per_bucket)
    return add_running(ranged, totals, grand).plain()


def row_index(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    *,
    name: str = "row_index",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the 0-based position in ``order`` (per key). ``order`` must be unique per key."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    counted = running(
        ones, order, {name: ("sum", "_one")}, keys, rows_per_bucket=rows_per_bucket
    )
    return counted.withColumn(name, F.col(name) - 1).drop("_one")


def with_frames(
    df: DataFrame,
    index: str,
    columns: Mapping[str, object],
    keys: Sequence[str] = (),
    *,
    before: int = 0,
    after: int = 0,
    block_rows: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Evaluate expressions over a row frame, in blocks of consecutive positions.

    ``columns`` maps a new column to ``f(window) -> Column``, where ``window`` is the ordered
    window without a frame. Each block carries ``before`` rows of the block before it and
    ``after`` rows of the one behind, so any frame within these limits is complete and a
    large key is spread over many tasks.
    """
    keys = list(keys)
    block_rows = max(block_rows, before, after, 1)
    position = F.pmod(F.col(index), F.lit(block_rows))
    home = F.floor(F.col(index) / block_rows).cast("long")
    copies = [home]
    if before:
        copies.append(F.when(position >= block_rows - before, home + 1))
    if after:
        copies.append(F.when((position < after) & (home > 0), home - 1))
    spread = df.withColumn("_home", home).withColumn(
        "_block", F.explode(F.array_compact(F.array(*copies)))
    )
    window = Window.partitionBy(*keys, "_block").orderBy(index)
    out = spread.select("*", *[f(window).alias(n) for n, f in columns.items()])
    return out.where(F.col("_block") == F.col("_home")).drop("_home", "_block")


def count_values(
    df: DataFrame, value: str, keys: Sequence[str] = (), **sums: Column
) -> DataFrame:
    """One row per distinct value (and key) with its row count and further sums.

    Partial aggregation runs before the shuffle, so a frequent value costs one row per task.
    """
    extra = [F.sum(c).alias(n) for n, c in sums.items()]
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"), *extra)


def mean_rank(
    df: DataFrame,
    score: str,
    keys: Sequence[str] = (),
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per distinct score: its count and the mean 1-based rank of its ties."""
    counted = count_values(df, score, keys)
    ranked = running(counted, [score], {"_upto": ("sum", "n")}, keys, rows_per_bucket=rows_per_bucket)
    rank = F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2.0
    return ranked.withColumn("mean_rank", rank).drop("_upto")


def ecdf(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per distinct value with the share of rows at or below it."""
    keys = list(keys)
    with_total = running(
        count_values(df, value, keys),
        [value],
        {"_upto": ("sum", "n")},
        keys,
        grand={"_total": "n"},
        rows_per_bucket=rows_per_bucket,
    )
    return with_total.withColumn("ecdf", F.col("_upto") / F.col("_total")).drop("_upto", "_total")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact linearly interpolated quantiles per key: one row per (key, prob).

    Values are counted, cumulated over ranges and picked by rank; no task holds a whole
    column, unlike ``percentile``. Large inputs with few keys are narrowed first: a sketch
    gives a bracket around each quantile, values outside the brackets are only counted, and
    the few inside are ranked exactly. If a bracket misses, the plain way is taken.
    Missing values are skipped. Values count as doubles, on either way.
    """
    keys = list(keys)
    number = F.col(value).cast("double")
    present = df.select(*keys, number.alias("_value")).where(F.col("_value").isNotNull())
    rows = present.count()
    few = rows > NARROW_BUCKETS * rows_per_bucket and (
        not keys
        or present.select(*keys).distinct().limit(MAX_SKETCHES + 1).count() <= MAX_SKETCHES
    )
    if few:
        narrowed = materialize(_count_cells(_narrow(present, probs, keys), keys))
        # At most MAX_SKETCHES keys times the asked quantiles.
        found = _pick(narrowed, probs, keys, rows_per_bucket)
        answers = found.collect()
        if all(r["quantile"] is not None for r in answers):
            return df.sparkSession.createDataFrame(answers, found.schema)
    counts = _count_cells(present.withColumn("_gap", F.lit(0)), keys)
    return _pick(counts, probs, keys, rows_per_bucket)


def quantiles_of_counts(
    counted: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """:func:`exact_quantiles` of rows that are already counted, as (keys, value, n)."""
    cells = counted.select(*keys, F.col(value).alias("_value"), F.lit(0).alias("_gap"), "n")
    return _pick(cells.where(F.col("_value").isNotNull()), probs, list(keys), rows_per_bucket)


def _count_cells(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys, "_value", "_gap").agg(F.count("*").alias("n"))


def _narrow(df: DataFrame, probs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Keep values inside a bracket; turn others into the border below them, ``_gap`` 1.

    The brackets reach three times the sketch's rank error to both sides.
    """
    reach = 3.0 / _SKETCH_ACCURACY
    pairs = [(max(0.0, p - reach), min(1.0, p + reach)) for p in probs]
    asked = [q for pair in pairs for q in pair]
    value = F.col("_value")
    sketch = F.percentile_approx(value, asked, _SKETCH_ACCURACY).alias("_borders")
    # One row per key.
    borders = (df.groupBy(*keys) if keys else df).agg(sketch)
    if keys:
        renamed = borders.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_borders")
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        joined = df.join(F.broadcast(renamed), match, "left")
        border = [F.col("_borders")[i] for i in range(len(asked))]
    else:
        joined = df
        border = [F.lit(b) for b in (borders.first()["_borders"] or [])]
    inside, below = F.lit(False), F.lit(float("-inf"))
    for i, (low_p, high_p) in enumerate(pairs):
        low, high = border[2 * i], border[2 * i + 1]
        over, under = (value >= low) | F.lit(low_p == 0.0), (value <= high) | F.lit(high_p == 1.0)
        inside = inside | (over & under)
        # Outside all brackets, a value lies just above the highest bracket end below it.
        below = F.greatest(below, F.when(value > high, high).otherwise(F.lit(float("-inf"))))
    return joined.select(
        *keys,
        F.when(inside, value).otherwise(below).alias("_value"),
        F.when(inside, 0).otherwise(1).alias("_gap"),
    )


def _pick(
    counted: DataFrame, probs: Sequence[float], keys: Sequence[str], rows_per_bucket: int
) -> DataFrame:
    """Quantiles from counted cells in order; null where a rank falls into a gap."""
    sized = running(
        counted,
        ["_value", "_gap"],
        {"_upto": ("sum", "n")},
        keys,
        grand={"_total": "n"},
        rows_per_bucket=rows_per_bucket,
    )
    first, last = F.col("_upto") - F.col("n"), F.col("_upto") - 1
    kept = F.when(F.col("_gap") == 0, F.col("_value"))
    picks = []
    for i, p in enumerate(probs):
        rank = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.floor(rank), F.ceil(rank)
        picks += [
            F.max(F.when((first <= low) & (low <= last), kept)).alias(f"_lo{i}"),
            F.max(F.when((first <= high) & (high <= last), kept)).alias(f"_hi{i}"),
            F.max(rank - low).alias(f"_w{i}"),
        ]
    wide = (sized.groupBy(*keys) if keys else sized).agg(*picks)
    rows = []
    for i, p in enumerate(probs):
        low, high, weight = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_w{i}")
        at = (low + (high - low) * weight).cast("double")
        rows.append(F.struct(F.lit(float(p)).alias("prob"), at.alias("quantile")))
    return wide.select(*keys, F.inline(F.array(*rows)))


def shifted(
    df: DataFrame,
    order: Sequence[str],
    columns: Mapping[str, tuple[str, int]],
    keys: Sequence[str] = (),
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add neighbours' values: ``{new_column: (column, offset)}``, negative = earlier row.

    ``order`` must be unique per key. Large keys go through row numbers and blocks.
    """
    keys = list(keys)
    ranged = arrange(df, order, keys, rows_per_bucket=rows_per_bucket)
    return add_shifted(ranged, columns, rows_per_bucket=rows_per_bucket)


def add_shifted(
    ranged: Ranged, columns: Mapping[str, tuple[str, int]], *, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """:func:`shifted` on an arranged table."""

    def neighbour(window, name: str, offset: int) -> Column:
        return F.lag(name, -offset).over(window) if offset < 0 else F.lead(name, offset).over(window)

    if not ranged.cut:
        window = ranged.window()
        return ranged.frame.select(
            "*", *[neighbour(window, c, o).alias(n) for n, (c, o) in columns.items()]
        )
    ones = ranged.over(ranged.frame.withColumn("_one", F.lit(1).cast("long")))
    indexed = add_running(ones, {"_at": ("sum", "_one")}).plain().drop("_one")
    offsets = [o for _, o in columns.values()]
    framed = with_frames(
        indexed,
        "_at",
        {n: (lambda w, c=c, o=o: neighbour(w, c, o)) for n, (c, o) in columns.items()},
        ranged.keys,
        before=max([0, *[-o for o in offsets]]),
        after=max([0, *offsets]),
        block_rows=rows_per_bucket,
    )
    return framed.drop("_at")
