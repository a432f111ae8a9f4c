"""Cost-tuned evaluation over forward-chaining folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wearline.functions.columns import alert
from wearline.operators.cost import (
    DEFAULT_COST,
    CostModel,
    baseline_costs,
    best_schedule,
    confusion,
    confusion_cost,
    optimal_threshold,
    roi,
)
from wearline.operators.ordered import row_index
from wearline.operators.ranking import ranking_metrics
from wearline.operators.splits import Fold, fold_bounds, fold_sides
from wearline.operators.supervised import fit_mlp, spread_sequence
from wearline.operators.tiles import stack_sequences
from wearline.session import materialize

Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def score_fold(
    test: DataFrame, threshold: float, windows_per_day: float, cost: CostModel, y: str
) -> DataFrame:
    """One row of metrics for frozen decisions on scored test rows."""
    hit = alert("score", threshold)
    parts = [
        ranking_metrics(test, y, "score"),
        confusion(test, y, hit).select("precision", "recall"),
        confusion_cost(test, y, hit, cost).withColumnRenamed("cost", "model_cost"),
        best_schedule(test, y, windows_per_day, cost, ["row_index"]),
        baseline_costs(test, y, cost).select(F.col("never_cost").alias("run_to_failure_cost")),
    ]
    row = parts[0]
    for part in parts[1:]:
        # Every part is a single row.
        row = row.join(F.broadcast(part), F.lit(True), "left")
    return row.withColumn("roi_vs_schedule", roi("schedule_cost", "model_cost")).withColumn(
        "threshold", F.lit(threshold)
    )


def scored_folds(
    df: DataFrame,
    features: Sequence[str],
    order: Sequence[str],
    fit: Fit,
    *,
    y: str = "y",
    n_splits: int = 5,
    embargo: int = 0,
    at_once: int = 4,
) -> list[tuple[int, DataFrame, DataFrame]]:
    """(fold, scored training rows, scored test rows) of every scorable fold, written.

    Folds with no failure on a side are left out, by one count over all folds before any
    fit. The few folds are fitted side by side; each step is a distributed job.
    """
    rows = materialize(row_index(df.select(*order, y, *features), order))
    folds = fold_bounds(rows.count(), n_splits=n_splits, embargo=embargo)
    at, bad = F.col("row_index"), F.col(y) == 1
    counted = rows.agg(
        *[
            c
            for f in folds
            for c in (
                F.count_if(bad & (at < f.train_end)).alias(f"train_{f.number}"),
                F.count_if(bad & (at >= f.test_start) & (at < f.test_end)).alias(f"test_{f.number}"),
            )
        ]
    ).first()
    usable = [f for f in folds if counted[f"train_{f.number}"] and counted[f"test_{f.number}"]]
    if not usable:
        raise ValueError("no scorable folds: failures are too clustered")

    def run(fold: Fold) -> tuple[int, DataFrame, DataFrame]:
        train, test = fold_sides(rows, fold)
        score = fit(train)
        kept = [materialize(score(side).select("row_index", y, "score")) for side in (train, test)]
        return fold.number, *kept

    with ThreadPoolExecutor(max(1, min(at_once, len(usable)))) as pool:
        return list(pool.map(run, usable))


def temporal_cv(
    df: DataFrame,
    features: Sequence[str],
    order: Sequence[str],
    fit: Fit,
    *,
    y: str = "y",
    model: str = "model",
    n_splits: int = 5,
    embargo: int = 0,
    windows_per_day: float = 144.0,
    cost: CostModel = DEFAULT_COST,
) -> DataFrame:
    """Per scorable fold: fit on train, choose the cutoff on train, judge on test."""
    folds = scored_folds(df, features, order, fit, y=y, n_splits=n_splits, embargo=embargo)
    return judge_folds(folds, y=y, model=model, windows_per_day=windows_per_day, cost=cost)


def judge_folds(
    folds: Sequence[tuple[int, DataFrame, DataFrame]],
    *,
    y: str = "y",
    model: str = "model",
    windows_per_day: float = 144.0,
    cost: CostModel = DEFAULT_COST,
) -> DataFrame:
    """One row per fold of :func:`scored_folds`: the cheapest training cutoff, frozen for the test rows."""
    results = []
    for number, train, test in folds:
        best = optimal_threshold(train, y, "score", cost).first()["threshold"]
        judged = score_fold(test, float(best), windows_per_day, cost, y)
        results.append(
            judged.select(F.lit(model).alias("model"), F.lit(number).cast("long").alias("fold"), "*")
        )
    return reduce(DataFrame.unionByName, results)


def sequence_cv(
    df: DataFrame,
    features: Sequence[str],
    order: Sequence[str],
    *,
    k: int = 6,
    y: str = "y",
    fit: Callable[..., Callable[[DataFrame], DataFrame]] = fit_mlp,
    model: str = "network",
    **options,
) -> DataFrame:
    """:func:`temporal_cv` of a network on each row stacked with the ``k - 1`` before it.

    A stacked row has the label of its last row. Scaling and early stopping see the training side only.
    """
    stacked = stack_sequences(df.select(*order, y, *features), features, k, order).select(*order, y, "sequence")
    width = k * len(features)
    names = [f"x{i}" for i in range(width)]
    wide = spread_sequence(stacked, width)
    return temporal_cv(
        wide, names, order, lambda rows: fit(rows, names, y, order="row_index"), y=y, model=model, **options
    )
