"""Tumbling tiles, request aggregation, row sequences and smoothing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wearline.functions.columns import require_columns
from wearline.operators.ordered import ROWS_PER_BUCKET, row_index, with_frames

WINDOW_START = "window_start"


@dataclass(frozen=True)
class Signals:
    """Which columns are analog measurements and which are on/off states."""

    analog: tuple[str, ...]
    digital: tuple[str, ...] = ()

    @property
    def all(self) -> tuple[str, ...]:
        return (*self.analog, *self.digital)


def feature_names(signals: Signals) -> list[str]:
    """Feature order shared by batch tiles, requests and streams."""
    return [
        *[f"{c}_{stat}" for c in signals.analog for stat in ("mean", "std", "min", "max")],
        *[f"{c}_mean" for c in signals.digital],
    ]


def feature_columns(df: DataFrame, other: Sequence[str] = ()) -> list[str]:
    """Every column but the tile start and the named non-features."""
    return [c for c in df.columns if c != WINDOW_START and c not in set(other)]


def tile_aggregates(signals: Signals) -> list[Column]:
    """The aggregate expressions behind every tile, in feature order."""
    out: list[Column] = []
    for c in signals.analog:
        value = F.col(c).cast("double")
        out += [
            F.avg(value).alias(f"{c}_mean"),
            F.stddev_samp(value).alias(f"{c}_std"),
            F.min(value).alias(f"{c}_min"),
            F.max(value).alias(f"{c}_max"),
        ]
    out += [F.avg(F.col(c).cast("double")).alias(f"{c}_mean") for c in signals.digital]
    return out


def check_width(width: str) -> None:
    """Tiles start at the epoch here and at the first midnight elsewhere; both agree only
    for widths that divide a day."""
    import pandas as pd

    span = pd.Timedelta(width)
    if span <= pd.Timedelta(0) or pd.Timedelta(days=1) % span != pd.Timedelta(0):
        raise ValueError(f"tile width must divide a day, got {width!r}")


def window_features(
    df: DataFrame,
    signals: Signals,
    *,
    ts: str = "ts",
    width: str = "10 minutes",
    min_rows: int = 6,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Per tile: mean, sample deviation, min and max of analogs and duty of digitals.

    Tiles with fewer than ``min_rows`` rows are dropped, and missing aggregates become 0.
    One hash aggregation with partials; also valid on a stream. Rows come unsorted.
    """
    require_columns(df, [ts, *signals.all, *keys])
    check_width(width)
    if min_rows < 1:
        raise ValueError(f"min_rows must be at least 1, got {min_rows}")
    tiles = (
        df.where(F.col(ts).isNotNull())
        .groupBy(*keys, F.window(ts, width).alias("_w"))
        .agg(*tile_aggregates(signals), F.count("*").alias("_rows"))
        .where(F.col("_rows") >= min_rows)
    )
    names = feature_names(signals)
    return tiles.select(
        *keys,
        F.col("_w.start").alias(WINDOW_START),
        *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names],
    )


def aggregate_request(
    df: DataFrame, signals: Signals, *, readings: str = "readings"
) -> DataFrame:
    """The tile statistics over an array of readings in each row, without a shuffle.

    A missing deviation becomes 0; the array is one request and so small.
    """

    def values(c: str) -> Column:
        read = F.transform(F.col(readings), lambda r: r[c].cast("double"))
        return F.filter(read, lambda v: v.isNotNull())

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)

    def squares(a: Column, mean: Column) -> Column:
        return F.transform(a, lambda x: (x - mean) * (x - mean))

    out: list[Column] = []
    for c in signals.all:
        v = values(c)
        n = F.size(v)
        mean = F.when(n > 0, total(v) / n)
        out.append(mean.alias(f"{c}_mean"))
        if c in signals.analog:
            std = F.when(n > 1, F.sqrt(total(squares(v, mean)) / (n - 1))).otherwise(F.lit(0.0))
            out += [
                std.alias(f"{c}_std"),
                F.array_min(v).alias(f"{c}_min"),
                F.array_max(v).alias(f"{c}_max"),
            ]
    kept = [c for c in df.columns if c != readings]
    return df.select(*kept, F.size(readings).cast("long").alias("n_samples"), *out)


def downsample(
    df: DataFrame,
    value: str,
    *,
    ts: str = WINDOW_START,
    width: str = "1 hour",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Mean value per tile; tiles without rows are absent."""
    out = df.groupBy(*keys, F.window(ts, width).alias("_w")).agg(F.avg(value).alias(value))
    return out.where(F.col(value).isNotNull()).select(*keys, F.col("_w.start").alias(ts), value)


def stack_sequences(
    df: DataFrame,
    features: Sequence[str],
    k: int,
    order: Sequence[str],
    keys: Sequence[str] = (),
    *,
    nested: bool = False,
    name: str = "sequence",
    block_rows: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Each row with the ``k - 1`` rows before it, oldest first (flat, or ``k`` arrays).

    Rows are consecutive by position; time gaps are ignored. The first ``k - 1`` rows of a
    key have no sequence and are left out, and the other columns are those of the last row.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    row = F.array(*[F.col(c).cast("double") for c in features])
    indexed = row_index(df, order, keys, name="_at", rows_per_bucket=block_rows)
    framed = with_frames(
        indexed.withColumn("_row", row),
        "_at",
        {name: lambda w: F.collect_list("_row").over(w.rowsBetween(-(k - 1), 0))},
        keys,
        before=k - 1,
        block_rows=block_rows,
    )
    full = framed.where(F.col("_at") >= k - 1).drop("_at", "_row")
    return full if nested else full.withColumn(name, F.flatten(name))


def centered_mean(
    df: DataFrame,
    value: str,
    size: int,
    order: Sequence[str],
    keys: Sequence[str] = (),
    *,
    name: str = "smoothed",
    block_rows: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Centred moving mean; windows at the ends are partial, even sizes lean back."""
    back, ahead = size // 2, size - size // 2 - 1
    indexed = row_index(df, order, keys, name="_at", rows_per_bucket=block_rows)
    framed = with_frames(
        indexed,
        "_at",
        {name: lambda w: F.avg(value).over(w.rowsBetween(-back, ahead))},
        keys,
        before=back,
        after=ahead,
        block_rows=block_rows,
    )
    return framed.drop("_at")
