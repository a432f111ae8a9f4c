"""Column expressions whose rules must hold everywhere (time, division, rounding, NaN)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_SECOND = 1_000_000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hours_interval(hours: float) -> Column:
    """A duration of ``hours`` (fractions allowed) as a day-time interval."""
    return F.make_dt_interval(secs=F.lit(float(hours) * 3600.0).cast("decimal(18,6)"))


def whole_days(start: str | Column, end: str | Column) -> Column:
    """Complete 24 h periods between two instants (midnights crossed do not count)."""
    seconds = F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))
    return F.floor(seconds / F.lit(86_400 * MICROS_PER_SECOND)).cast("long")


def hours_between(start: str | Column, end: str | Column) -> Column:
    micros = F.unix_micros(col(end).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))
    return micros / F.lit(float(MICROS_PER_HOUR))


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den``, and 0 where ``den`` is 0."""
    return F.when(col(den) != 0, col(num) / col(den)).otherwise(F.lit(0.0))


def half_even(c: str | Column, places: int = 0) -> Column:
    return F.bround(col(c), places)


def nan_to_null(c: str | Column) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def clean_doubles(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating column, once, at ingest."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floating:
        return df
    return df.select(*[nan_to_null(c).alias(c) if c in floating else F.col(c) for c in df.columns])


def alert(score: str | Column, threshold: str | Column | float) -> Column:
    """``score >= threshold``; a missing or NaN score never alerts."""
    limit = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else col(threshold)
    hit = (col(score) >= limit) & ~F.isnan(col(score)) & ~F.isnan(limit)
    return F.coalesce(hit, F.lit(False))


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Fail while planning, naming every missing column at once."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
