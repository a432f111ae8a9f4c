"""Maintenance cost: confusion counts, cost curves, cutoffs and calendars."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wearline.functions.columns import alert, col, ratio
from wearline.operators.ordered import (
    ROWS_PER_BUCKET,
    count_values,
    row_index,
    running,
)


@dataclass(frozen=True)
class CostModel:
    """Price of a missed failure, a false alarm and a correct alarm; quiet is free."""

    cost_fn: float
    cost_fp: float
    cost_tp: float = 0.0

    def __post_init__(self) -> None:
        prices = {"cost_fn": self.cost_fn, "cost_fp": self.cost_fp, "cost_tp": self.cost_tp}
        negative = [name for name, price in prices.items() if price < 0]
        if negative:
            raise ValueError(f"costs must not be negative: {negative}")
        if not self.cost_fn > self.cost_fp:
            raise ValueError("a missed failure must cost more than a false alarm")

    def price(self, tp: Column | str, fp: Column | str, fn: Column | str) -> Column:
        return (
            col(fn) * F.lit(float(self.cost_fn))
            + col(fp) * F.lit(float(self.cost_fp))
            + col(tp) * F.lit(float(self.cost_tp))
        )


# Default prices of one decision, and the candidate calendars in days.
DEFAULT_COST = CostModel(cost_fn=3000.0, cost_fp=200.0, cost_tp=200.0)
SCHEDULE_DAYS = (1, 3, 7, 14)


def _positive(y: str | Column) -> Column:
    """Any non-zero label counts as a failure."""
    return F.coalesce(col(y) != 0, F.lit(False))


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def confusion(
    df: DataFrame, y: str, pred: str | Column, by: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """tp, fp, fn, tn, precision and recall (0 where undefined); labels are 0 or 1."""
    hit = F.coalesce(col(pred).cast("boolean"), F.lit(False))
    counted = df.groupBy(*by).agg(
        _count(hit & (F.col(y) == 1)).alias("tp"),
        _count(hit & (F.col(y) == 0)).alias("fp"),
        _count(~hit & (F.col(y) == 1)).alias("fn"),
        _count(~hit & (F.col(y) == 0)).alias("tn"),
        *extra,
    )
    return counted.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn(
        "recall", ratio("tp", F.col("tp") + F.col("fn"))
    )


def confusion_cost(
    df: DataFrame, y: str, pred: str | Column, cost: CostModel, by: Sequence[str] = ()
) -> DataFrame:
    """Total price of hard decisions."""
    hit, bad = F.coalesce(col(pred).cast("boolean"), F.lit(False)), _positive(y)
    price = cost.price(_count(hit & bad), _count(hit & ~bad), _count(~hit & bad))
    return df.groupBy(*by).agg(price.alias("cost"))


def expected_cost(
    df: DataFrame,
    y: str,
    score: str,
    threshold: float | str,
    cost: CostModel,
    by: Sequence[str] = (),
) -> DataFrame:
    """Price of alerting wherever the score reaches the threshold."""
    return confusion_cost(df, y, alert(score, threshold), cost, by)


def baseline_costs(df: DataFrame, y: str, cost: CostModel, by: Sequence[str] = ()) -> DataFrame:
    """Acting on everything, and on nothing."""
    bad, good, none = _count(_positive(y)), _count(~_positive(y)), F.lit(0)
    return df.groupBy(*by).agg(
        cost.price(bad, good, none).alias("always_cost"),
        cost.price(none, none, bad).alias("never_cost"),
    )


def score_counts(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Failing (``pos``) and quiet (``neg``) rows per distinct score; null is "no score"."""
    usable = df.withColumn("_score", F.when(~F.isnan(score), F.col(score).cast("double")))
    bad = _positive(y)
    return count_values(usable, "_score", by, pos=bad.cast("long"), neg=(~bad).cast("long"))


def curve_of(
    counted: DataFrame, by: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """The cutoff curve from :func:`score_counts` rows."""
    below = running(
        counted,
        ["_score"],
        {"_pos_upto": ("sum", "pos"), "_neg_upto": ("sum", "neg")},
        by,
        grand={"total_pos": "pos", "total_neg": "neg"},
        rows_per_bucket=rows_per_bucket,
    )
    # Missing scores sort first, so they are below every cutoff.
    return below.where(F.col("_score").isNotNull()).select(
        *by,
        F.col("_score").alias("cutoff"),
        "pos",
        "neg",
        (F.col("total_pos") - F.col("_pos_upto") + F.col("pos")).alias("tp"),
        (F.col("total_neg") - F.col("_neg_upto") + F.col("neg")).alias("fp"),
        "total_pos",
        "total_neg",
    )


def score_curve(
    df: DataFrame,
    y: str,
    score: str,
    by: Sequence[str] = (),
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per distinct score as cutoff: tp and fp at or above it, and class totals.

    Rows are counted per score first, so the ordered part sees distinct scores only. Rows
    without a score never alert but stay in the totals.
    """
    return curve_of(score_counts(df, y, score, by), by, rows_per_bucket)


def cost_curve(
    df: DataFrame,
    y: str,
    score: str,
    cost: CostModel,
    by: Sequence[str] = (),
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Price of every distinct score as cutoff, and of a cutoff one above the highest.

    A group without any score has one row: no cutoff, and the price of missing everything.
    """
    curve = score_curve(df, y, score, by, rows_per_bucket=rows_per_bucket)
    missed = F.col("total_pos") - F.col("tp")
    real = curve.select(
        *by, F.col("cutoff").alias("threshold"), cost.price("tp", "fp", missed).alias("cost")
    )
    silent = df.groupBy(*by).agg(
        (F.max(F.when(~F.isnan(score), F.col(score))).cast("double") + 1.0).alias("threshold"),
        cost.price(F.lit(0), F.lit(0), _count(_positive(y))).alias("cost"),
        F.count("*").alias("n"),
    )
    return real.unionByName(silent.where(F.col("n") > 0).drop("n"))


def optimal_threshold(
    df: DataFrame,
    y: str,
    score: str,
    cost: CostModel,
    by: Sequence[str] = (),
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """The cheapest cutoff; among equals the highest, which alarms least."""
    if not df.take(1):
        raise ValueError("no rows to choose a threshold from")
    curve = cost_curve(df, y, score, cost, by, rows_per_bucket=rows_per_bucket)
    best = F.struct(F.col("cost"), -F.col("threshold"))
    return curve.groupBy(*by).agg(
        F.min_by("threshold", best).alias("threshold"), F.min("cost").alias("cost")
    )


def _act_every(interval: int) -> Column:
    return F.pmod(F.col("_at"), F.lit(interval)) == 0


def schedule_cost(
    df: DataFrame,
    y: str,
    interval: int,
    cost: CostModel,
    order: Sequence[str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Price of acting on every ``interval``-th row in time order."""
    if interval < 1:
        raise ValueError(f"interval must be at least 1, got {interval}")
    indexed = row_index(df.select(*keys, *order, y), order, keys, name="_at")
    return confusion_cost(indexed, y, _act_every(interval), cost, keys)


def schedule_intervals(
    windows_per_day: float, days: Sequence[int] = SCHEDULE_DAYS
) -> dict[int, int]:
    """Rows between two actions for each calendar (Python rounds halves to even)."""
    return {d: max(1, round(d * windows_per_day)) for d in days}


def best_schedule(
    df: DataFrame,
    y: str,
    windows_per_day: float,
    cost: CostModel,
    order: Sequence[str],
    keys: Sequence[str] = (),
    *,
    days: Sequence[int] = SCHEDULE_DAYS,
) -> DataFrame:
    """The cheapest calendar; among equals the shortest. All are priced in one pass."""
    indexed = row_index(df.select(*keys, *order, y), order, keys, name="_at")
    bad = _positive(y)
    priced = []
    for d, interval in schedule_intervals(windows_per_day, days).items():
        act = _act_every(interval)
        price = cost.price(_count(act & bad), _count(act & ~bad), _count(~act & bad))
        priced.append(F.struct(price.alias("cost"), F.lit(d).alias("days")))
    best = indexed.groupBy(*keys).agg(F.array_min(F.array(*priced)).alias("_best"))
    return best.select(
        *keys, F.col("_best.cost").alias("schedule_cost"), F.col("_best.days").alias("schedule_days")
    )


def roi(schedule: str | Column, model: str | Column) -> Column:
    """Share of the schedule's price that the model saves; 0 for a free schedule."""
    return ratio(col(schedule) - col(model), schedule)
