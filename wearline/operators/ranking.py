"""Ranking quality of scores, and truth that arrives late."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wearline.functions.columns import alert, ratio
from wearline.operators.cost import curve_of, score_counts, score_curve
from wearline.operators.labels import interval_labels
from wearline.operators.ordered import ROWS_PER_BUCKET
from wearline.session import materialize


def ranking_metrics(
    df: DataFrame,
    y: str,
    score: str,
    by: Sequence[str] = (),
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``roc_auc`` and ``pr_auc`` from one ordered pass over the distinct scores.

    AUC counts, for each failure, the quiet rows below it and half of those tied with it;
    it is null with one class only. Average precision is the step sum of precision over
    recall, 0 without failures.
    """
    return metrics_of(score_curve(df, y, score, by, rows_per_bucket=rows_per_bucket), by)


def metrics_of(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`ranking_metrics` from a finished cutoff curve."""
    wins = F.col("pos") * (F.col("total_neg") - F.col("fp") + F.col("neg") / 2.0)
    steps = F.when(F.col("pos") > 0, F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    summed = curve.groupBy(*by).agg(
        F.sum(wins).alias("_wins"),
        F.sum(steps).alias("_steps"),
        F.max("total_pos").alias("_p"),
        F.max("total_neg").alias("_n"),
    )
    pairs = F.col("_p").cast("double") * F.col("_n")
    return summed.select(
        *by,
        F.when(pairs > 0, F.col("_wins") / pairs).alias("roc_auc"),
        F.coalesce(F.when(F.col("_p") > 0, F.col("_steps") / F.col("_p")), F.lit(0.0)).alias(
            "pr_auc"
        ),
    )


def roc_auc(df: DataFrame, y: str, score: str, by: Sequence[str] = (), **options) -> DataFrame:
    return ranking_metrics(df, y, score, by, **options).select(*by, "roc_auc")


def average_precision(
    df: DataFrame, y: str, score: str, by: Sequence[str] = (), **options
) -> DataFrame:
    return ranking_metrics(df, y, score, by, **options).select(*by, "pr_auc")


def backfill_performance(
    predictions: DataFrame,
    events: DataFrame,
    threshold: float | str,
    *,
    ts: str = "ts",
    score: str = "score",
    warn_hours: float = 2.0,
    keys: Sequence[str] = (),
    by: Sequence[str] = (),
    at: str = "",
) -> DataFrame:
    """True performance of stored predictions once failure reports are in.

    The range join with the reports runs once: its result is counted per score and
    decision, written, and everything else is derived from those counts.
    """
    by = list(by)
    labelled = interval_labels(
        predictions, events, ts=ts, warn_hours=warn_hours, active=True, keys=keys, name="_y"
    )
    decided = labelled.withColumn("_hit", alert(score, threshold))
    counted = materialize(score_counts(decided, "_y", score, [*by, "_hit"]))
    hit, pos, neg = F.col("_hit"), F.col("pos"), F.col("neg")
    counts = counted.groupBy(*by).agg(
        F.sum("n").alias("n"),
        *[
            F.coalesce(F.sum(F.when(which, what)), F.lit(0)).alias(name)
            for name, which, what in (
                ("tp", hit, pos),
                ("fp", hit, neg),
                ("fn", ~hit, pos),
                ("tn", ~hit, neg),
            )
        ],
    )
    merged = counted.groupBy(*by, "_score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ranks = metrics_of(curve_of(merged, by), by).select(*by, "roc_auc")
    if by:
        joined = counts.join(ranks, by, "left")
    else:
        joined = counts.join(F.broadcast(ranks), F.lit(True), "left")
    return joined.select(
        *by,
        F.lit(at).alias("at"),
        "n",
        (F.col("tp") + F.col("fn")).alias("n_positives"),
        "tp",
        "fp",
        "fn",
        "tn",
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        ratio("tp", F.col("tp") + F.col("fn")).alias("recall"),
        "roc_auc",
    )


def fold_means(
    df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("model",)
) -> DataFrame:
    """Mean of each metric over the scorable folds, and their number."""
    return df.groupBy(*by).agg(
        *[F.avg(m).alias(m) for m in metrics], F.count("*").alias("scorable_folds")
    )


def class_weights(df: DataFrame, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Quiet-to-failure ratio, and balanced weights n / (2 n_class)."""
    pos, neg = F.sum((F.col(y) == 1).cast("long")), F.sum((F.col(y) == 0).cast("long"))
    counted = df.groupBy(*by).agg(pos.alias("_p"), neg.alias("_n"))
    total = F.col("_p") + F.col("_n")
    return counted.select(
        *by,
        (F.col("_n") / F.greatest(F.col("_p"), F.lit(1))).alias("pos_weight"),
        ratio(total, 2 * F.col("_p")).alias("weight_pos"),
        ratio(total, 2 * F.col("_n")).alias("weight_neg"),
    )
