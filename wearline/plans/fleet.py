"""Fleet risk: cohort, split, prior, forest, and what age and capacity add to the prior."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wearline.operators.lifetimes import (
    HORIZON_DAYS,
    REFERENCE_DATE,
    cohort_summary,
    risk_cohort,
    target_encode,
)
from wearline.operators.ranking import ranking_metrics
from wearline.operators.splits import stratified_split
from wearline.operators.supervised import fit_forest
from wearline.session import materialize


def fleet_risk(
    lifetimes: DataFrame,
    *,
    ident: str = "serial_number",
    reference: str = REFERENCE_DATE,
    horizon_days: int = HORIZON_DAYS,
    trees: int = 200,
    leaf: int = 20,
    depth: int = 30,
    seed: int = 42,
) -> DataFrame:
    """One row: cohort size and rate, and ranking metrics of the forest and of the prior."""
    cohort = risk_cohort(lifetimes, reference=reference, horizon_days=horizon_days)
    split = materialize(
        stratified_split(
            cohort.select(ident, "capacity_tb", "age_days", "model", "y"), "y", 0.3, ident, seed=seed
        )
    )
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    features = ["capacity_tb", "age_days", "prior_rate"]
    encoded_train = materialize(target_encode(train, train, "model", "y", name="prior_rate"))
    encoded_test = target_encode(train, test, "model", "y", name="prior_rate")
    score = fit_forest(encoded_train, features, "y", trees=trees, leaf=leaf, depth=depth, seed=seed)
    scored = materialize(score(encoded_test).select("y", "score", "prior_rate"))
    full = ranking_metrics(scored, "y", "score")
    alone = ranking_metrics(scored, "y", "prior_rate").select(
        F.col("roc_auc").alias("roc_auc_prior_only"), F.col("pr_auc").alias("pr_auc_prior_only")
    )
    # Single rows.
    return (
        cohort_summary(split)
        .join(F.broadcast(full), F.lit(True), "left")
        .join(F.broadcast(alone), F.lit(True), "left")
    )
