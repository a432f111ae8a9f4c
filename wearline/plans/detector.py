"""Unsupervised detector, end to end: fit on healthy tiles, judge on the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from wearline.functions.columns import alert
from wearline.operators.cost import confusion
from wearline.operators.iforest import (
    CONTAMINATION,
    TREES,
    Forest,
    fit_iforest,
    score_iforest,
    score_with_prefixes,
)
from wearline.operators.labels import interval_labels, lead_times, mark_healthy
from wearline.operators.ordered import exact_quantiles
from wearline.operators.ranking import ranking_metrics
from wearline.session import materialize


@dataclass(frozen=True)
class DetectorReport:
    forest: Forest
    metrics: DataFrame
    lead_times: DataFrame
    scored: DataFrame


def _metrics(scored: DataFrame, score: str, threshold: float) -> DataFrame:
    """One row of metrics over the rows after the healthy period."""
    test = scored.where(~F.col("healthy"))
    ranks = ranking_metrics(test, "y", score)
    sizes = scored.agg(
        F.count_if("healthy").alias("train_windows"),
        F.count_if(~F.col("healthy")).alias("test_windows"),
        F.count_if(~F.col("healthy") & (F.col("y") == 1)).alias("test_positives"),
    )
    decided = confusion(test, "y", alert(score, threshold)).select("recall", "precision")
    # Three one-row results.
    return (
        sizes.join(F.broadcast(ranks), F.lit(True), "left")
        .join(F.broadcast(decided), F.lit(True), "left")
        .withColumn("threshold", F.lit(threshold))
    )


def evaluate_detector(
    tiles: DataFrame,
    events: DataFrame,
    features: Sequence[str],
    *,
    ts: str = "window_start",
    keys: Sequence[str] = (),
    trees: int = TREES,
    contamination: float = CONTAMINATION,
    warn_hours: float = 2.0,
    quantile: float = 0.99,
    lookback_hours: float = 48.0,
    seed: int = 42,
    version: str = "",
) -> DetectorReport:
    """Fit without labels, score everything once, then measure against the reports.

    The offset comes from the same scores, so training rows are not scored twice.
    """
    marked = materialize(mark_healthy(tiles.select(*keys, ts, *features), events, ts=ts, keys=keys))
    calm = marked.where("healthy")
    forest = fit_iforest(
        calm, features, ident=[*keys, ts], trees=trees, contamination=None, seed=seed, version=version
    )
    labelled = interval_labels(
        marked, events, ts=ts, warn_hours=warn_hours, active=True, keys=keys, name="y"
    )
    raw = materialize(score_iforest(labelled, forest).select(*keys, ts, "healthy", "y", "score"))
    marks = exact_quantiles(raw.where("healthy"), "score", [1.0 - contamination, quantile]).collect()
    offset = next(r["quantile"] for r in marks if r["prob"] == 1.0 - contamination)
    limit = next(r["quantile"] for r in marks if r["prob"] == quantile) - offset
    scored = raw.withColumn("score", F.col("score") - F.lit(float(offset)))
    return DetectorReport(
        replace(forest, offset=float(offset), threshold=float(limit)),
        _metrics(scored, "score", float(limit)),
        lead_times(
            scored, events, float(limit), ts=ts, lookback_hours=lookback_hours, keys=keys
        ),
        scored,
    )


def ensemble_sweep(
    tiles: DataFrame,
    events: DataFrame,
    features: Sequence[str],
    *,
    sizes: Sequence[int] = (300, 100, 50),
    ts: str = "window_start",
    keys: Sequence[str] = (),
    warn_hours: float = 2.0,
    quantile: float = 0.99,
    seed: int = 42,
) -> DataFrame:
    """Ranking quality by number of trees. One fit and one scoring pass serve all sizes."""
    marked = materialize(mark_healthy(tiles.select(*keys, ts, *features), events, ts=ts, keys=keys))
    calm = marked.where("healthy")
    forest = fit_iforest(calm, features, ident=[*keys, ts], trees=max(sizes), contamination=None, seed=seed)
    labelled = interval_labels(marked, events, ts=ts, warn_hours=warn_hours, keys=keys, name="y")
    scored = materialize(
        score_with_prefixes(labelled, forest, sizes).select(
            "healthy", "y", *[f"score_{n}" for n in sizes]
        )
    )
    long = scored.unpivot(["healthy", "y"], [f"score_{n}" for n in sizes], "size", "score")
    limits = exact_quantiles(long.where("healthy"), "score", [quantile], ["size"])
    # One row per ensemble size.
    test = long.where(~F.col("healthy")).join(
        F.broadcast(limits.select("size", F.col("quantile").alias("threshold"))), "size"
    )
    ranks = ranking_metrics(test, "y", "score", ["size"])
    decided = confusion(test, "y", alert("score", F.col("threshold")), ["size"])
    return ranks.join(decided, "size").select(
        F.regexp_extract("size", r"(\d+)$", 1).cast("long").alias("trees"), "roc_auc", "pr_auc", "recall"
    )
