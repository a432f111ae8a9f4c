"""Forward-chaining folds with an embargo, and stratified splits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from wearline.operators.ordered import ROWS_PER_BUCKET, row_index


@dataclass(frozen=True)
class Fold:
    number: int
    train_end: int
    test_start: int
    test_end: int


def fold_bounds(n: int, *, n_splits: int = 5, embargo: int = 0) -> list[Fold]:
    """Row ranges of each fold: train ``[0, train_end)``, test ``[test_start, test_end)``.

    Folds whose training side the embargo empties are skipped; numbers count kept folds.
    """
    if n_splits < 1:
        raise ValueError("n_splits must be at least 1")
    if embargo < 0:
        raise ValueError("embargo must not be negative")
    if n <= n_splits:
        raise ValueError(f"{n_splits} folds need more than {n_splits} rows, got {n}")
    size = n // (n_splits + 1)
    starts = [size * i for i in range(1, n_splits + 1)]
    ends = [*starts[1:], n]
    kept = [(s - embargo, s, e) for s, e in zip(starts, ends) if s > embargo and e > s]
    return [Fold(i, *bounds) for i, bounds in enumerate(kept)]


def embargo_rows(warn_hours: float, windows_per_hour: float) -> int:
    """Rows to leave out so that no training label looks into the test period."""
    return int(round(warn_hours * windows_per_hour))


def assign_folds(
    df: DataFrame,
    order: Sequence[str],
    *,
    n_splits: int = 5,
    embargo: int = 0,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per (row, fold) with its role, train or test.

    The fold table is a handful of literals, so membership is an expression, not a join.
    """
    folds = fold_bounds(df.count(), n_splits=n_splits, embargo=embargo)
    indexed = row_index(df, order, rows_per_bucket=rows_per_bucket)
    at = F.col("row_index")
    roles = [
        F.when(at < f.train_end, F.struct(F.lit(f.number).alias("fold"), F.lit("train").alias("role")))
        .when(
            (at >= f.test_start) & (at < f.test_end),
            F.struct(F.lit(f.number).alias("fold"), F.lit("test").alias("role")),
        )
        for f in folds
    ]
    return indexed.select("*", F.inline(F.array_compact(F.array(*roles))))


def fold_sides(indexed: DataFrame, fold: Fold) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of one fold of a frame that carries ``row_index``."""
    at = F.col("row_index")
    return (
        indexed.where(at < fold.train_end),
        indexed.where((at >= fold.test_start) & (at < fold.test_end)),
    )


def test_shares(sizes: dict, share: float) -> dict:
    """Whole test rows per class: proportional, leftovers to the largest remainders."""
    total = sum(sizes.values())
    target = math.ceil(total * share)
    exact = {c: target * n / total for c, n in sizes.items()}
    counts = {c: math.floor(v) for c, v in exact.items()}
    missing = target - sum(counts.values())
    by_remainder = sorted(exact, key=lambda c: (counts[c] - exact[c], str(c)))
    for c in by_remainder[:missing]:
        counts[c] += 1
    return counts


test_shares.__test__ = False  # not a test case


def stratified_split(
    df: DataFrame,
    y: str,
    share: float,
    ident: str,
    *,
    seed: int = 42,
    name: str = "is_test",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Mark an exact share of every class for test, by the order of a seeded hash.

    The same rows are chosen however the data is partitioned. ``ident`` must be unique and
    orderable; class labels are few, so their sizes are read to the driver.
    """
    sizes = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return df.withColumn(name, F.lit(False))
    counts = test_shares(sizes, share)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")))
    hashed = df.withColumn("_hash", F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"))
    indexed = row_index(
        hashed, ["_hash", ident], [y], name="_at", rows_per_bucket=rows_per_bucket
    )
    limit = F.lit(0)
    for label, n in counts.items():
        limit = F.when(F.col(y).eqNullSafe(F.lit(label)), n).otherwise(limit)
    return indexed.withColumn(name, F.col("_at") < limit).drop("_hash", "_at")
