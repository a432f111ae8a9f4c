"""Data-quality profile of telemetry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from wearline.operators.ordered import ROWS_PER_BUCKET, exact_quantiles, quantiles_of_counts, running, shifted
from wearline.operators.tiles import Signals
from wearline.session import materialize

# Profile quantiles and their names.
PROFILE_QUANTILES = {"p01": 0.0001, "p1": 0.01, "p50": 0.5, "p99": 0.99, "p9999": 0.9999}


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    exact: bool = True,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Quantiles of several columns as (column, prob, quantile).

    ``exact=False`` uses Spark's sketch, whose rank error is 1/10,000 of the rows.
    """
    columns = list(columns)
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if exact:
        long = wide.unpivot([], columns, "column", "value")
        return exact_quantiles(long, "value", probs, ["column"], rows_per_bucket=rows_per_bucket)
    sketched = wide.agg(*[F.percentile_approx(c, list(probs), 10_000).alias(c) for c in columns])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("prob"), F.col(c)[i].alias("quantile"))
        for c in columns
        for i, p in enumerate(probs)
    ]
    return sketched.select(F.inline(F.array(*rows)))


def value_sets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column with their counts, one row per value."""
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = wide.unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count("*").alias("rows"))


def non_binary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values other than 0 and 1 of digital columns."""
    return value_sets(df, columns).where(~F.col("value").isin(0.0, 1.0))


def duplicate_times(df: DataFrame, ts: str) -> DataFrame:
    """Rows that repeat an earlier timestamp (missing ones repeat each other)."""
    groups = df.groupBy(ts).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_timestamps"))


def channel_counts(
    df: DataFrame, columns: Sequence[str], ts: str, seq: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Rows per (keys, column, value), missing values included, from one scan.

    The time column counts as microseconds and also has the least and the greatest ``seq`` of each time.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
    cells = [F.struct(F.lit(ts).alias("column"), micros.alias("value"), F.col(seq).alias("seq"))]
    cells += [
        F.struct(
            F.lit(c).alias("column"),
            F.col(c).cast("double").alias("value"),
            F.lit(None).cast(df.schema[seq].dataType).alias("seq"),
        )
        for c in columns
    ]
    rows = df.select(*keys, F.inline(F.array(*cells)))
    return rows.groupBy(*keys, "column", "value").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


def quality_profile(
    df: DataFrame,
    signals: Signals,
    bounds: Mapping[str, tuple[float, float]],
    *,
    ts: str = "ts",
    seq: str,
    keys: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """The profile as (keys, column, metric, value) rows, all read off one written count of values.

    Table metrics sit under the time column's name. Null counts are listed only where there
    are nulls. Time bounds are µs since the epoch, flags 0 or 1. Rows are in order if no time comes
    before a smaller one in arrival order; missing times neither break nor hide an order.
    """
    keys = list(keys)
    counts = materialize(channel_counts(df, signals.all, ts, seq, keys))
    n, value = F.col("n"), F.col("value")
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for c in signals.analog:
        low = F.when(F.col("column") == c, F.lit(float(bounds[c][0]))).otherwise(low)
        high = F.when(F.col("column") == c, F.lit(float(bounds[c][1]))).otherwise(high)
    none = F.lit(0).cast("long")
    facts = counts.groupBy(*keys, "column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(value.isNull(), n).otherwise(none)).alias("nulls"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
        F.sum(F.when((value < low) | (value > high), n).otherwise(none)).alias("outside"),
        F.sum(n - 1).alias("repeats"),
    )
    if not keys:
        # An empty table has a profile too; one row per column.
        names = F.explode(F.array(*[F.lit(c) for c in [ts, *signals.all]])).alias("column")
        grid = counts.agg(F.count("*")).select(names)
        facts = grid.join(F.broadcast(facts), "column", "left")

    def entry(metric: str, what: F.Column, when: F.Column | None = None) -> F.Column:
        cell = F.struct(F.lit(metric).alias("metric"), what.cast("double").alias("value"))
        return cell if when is None else F.when(when, cell)

    timed = F.col("column") == ts
    analog = F.col("column").isin(list(signals.analog))
    rows = F.coalesce("rows", none)
    cells = [
        entry("rows", rows, timed),
        entry("first", F.col("least"), timed),
        entry("last", F.col("greatest"), timed),
        entry("duplicate_timestamps", F.coalesce("repeats", none), timed),
        entry("null_count", F.col("nulls"), ~timed & (F.col("nulls") > 0)),
        entry("min", F.col("least"), analog),
        entry("max", F.col("greatest"), analog),
        entry("out_of_bound_rows", F.coalesce("outside", none), analog),
        entry("bound_low", low, analog),
        entry("bound_high", high, analog),
    ]
    table = facts.select(*keys, "column", F.inline(F.array_compact(F.array(*cells))))

    name_of = F.create_map(*[F.lit(x) for n, p in PROFILE_QUANTILES.items() for x in (p, n)])
    ranks = quantiles_of_counts(
        counts.where(analog), "value", list(PROFILE_QUANTILES.values()), [*keys, "column"], rows_per_bucket=rows_per_bucket
    ).select(*keys, "column", name_of[F.col("prob")].alias("metric"), F.col("quantile").alias("value"))
    times = counts.where(timed & value.isNotNull())
    late = running(times, ["value"], {"upto": ("max", "last_seq")}, keys, rows_per_bucket=rows_per_bucket)
    # A time whose first arrival lies before the last arrival of an earlier time.
    stepped = shifted(late, ["value"], {"before": ("upto", -1)}, keys, rows_per_bucket=rows_per_bucket)
    broken = F.coalesce(F.max((F.col("before") > F.col("first_seq")).cast("int")), F.lit(0))
    ordered = stepped.groupBy(*keys).agg(broken.alias("broken")).select(
        *keys, F.lit(ts).alias("column"), F.lit("monotonic").alias("metric"), (1.0 - F.col("broken")).alias("value")
    )
    digital = counts.where(F.col("column").isin(list(signals.digital)) & value.isNotNull()).select(
        *keys, "column", F.concat(F.lit("rows_at_"), value.cast("string")).alias("metric"), n.cast("double").alias("value")
    )
    return table.unionByName(ranks).unionByName(ordered).unionByName(digital)


# Rank error of a sketch of this size, for one quantile, at a confidence of 99 %: about 0.3 %.
SKETCH_SIZE = 1000
SKETCH_RANK_ERROR = 2.296 / SKETCH_SIZE**0.9723


def quantile_sketches(
    df: DataFrame, columns: Sequence[str], *, ts: str = "ts", keys: Sequence[str] = (), size: int = SKETCH_SIZE
) -> DataFrame:
    """One mergeable sketch per (keys, day, column), to be stored: ``sketch`` and its values ``n``.

    Missing values and NaN are left out. The rank error does not grow with rows or by merging.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    rows = df.select(*keys, F.to_date(F.col(ts).cast("timestamp")).alias("day"), F.inline(F.array(*cells)))
    present = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return present.groupBy(*keys, "day", "column").agg(
        F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"), F.count("*").alias("n")
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """Sketches of larger groups, from stored ones."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def sketched_quantiles(sketches: DataFrame, probs: Sequence[float], by: Sequence[str] = ("column",)) -> DataFrame:
    """(by, prob, quantile) of merged sketches; a quantile is a value that occurs."""
    merged = merge_sketches(sketches, by)
    asked = [
        F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("quantile"))
        for p in probs
    ]
    return merged.select(*by, "n", F.inline(F.array(*asked)))
