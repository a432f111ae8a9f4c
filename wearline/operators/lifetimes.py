"""Unit lifetimes: failure rates, censoring-safe cohorts, smoothed priors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wearline.functions.columns import whole_days
from wearline.session import broadcast_if_small, materialize

# Cohort date and horizon, pseudo-count of the prior.
REFERENCE_DATE = "2022-01-01"
HORIZON_DAYS = 365
SMOOTHING = 50.0


def afr(df: DataFrame, *, key: str = "model", min_units: int = 1000) -> DataFrame:
    """Failures per observed unit-year and model, for models with enough units, worst first."""
    years = F.greatest(whole_days("min_date", "max_date"), F.lit(1)) / 365.25
    rates = df.groupBy(key).agg(
        F.count("*").alias("units"),
        F.sum(F.col("failed").cast("long")).alias("failures"),
        F.sum(years).alias("unit_years"),
    )
    return (
        rates.where(F.col("units") >= min_units)
        .withColumn("afr", F.col("failures") / F.col("unit_years"))
        .orderBy(F.desc("afr"), key)
    )


def worst(rates: DataFrame, k: int = 3, key: str = "model") -> DataFrame:
    return rates.orderBy(F.desc("afr"), key).limit(k)


def best(rates: DataFrame, k: int = 3, key: str = "model") -> DataFrame:
    return rates.orderBy(F.asc("afr"), F.desc(key)).limit(k)


def risk_cohort(
    df: DataFrame, *, reference: str = REFERENCE_DATE, horizon_days: int = HORIZON_DAYS
) -> DataFrame:
    """Units alive at the reference, with y = 1 if they fail within the horizon.

    Units that leave unfailed inside the horizon are dropped; later failures stay as y = 0.
    Filters and projections only.
    """
    at = F.to_timestamp(F.lit(reference))
    until = at + F.make_dt_interval(days=F.lit(horizon_days))
    ended = F.col("max_date") <= until
    alive = df.where((F.col("min_date") <= at) & (F.col("max_date") >= at))
    kept = alive.where(~((F.col("failed") == 0) & ended))
    return kept.withColumn("age_days", whole_days("min_date", at)).withColumn(
        "y", ((F.col("failed") == 1) & ended).cast("int")
    )


def cohort_summary(cohort: DataFrame) -> DataFrame:
    return cohort.agg(
        F.count("*").alias("n_units"),
        F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0)).alias("n_failures"),
        F.avg("y").alias("failure_rate"),
    )


def fleet_totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("units"),
        F.sum(F.col("failed").cast("long")).alias("failures"),
        F.count_distinct("model").alias("models"),
    )


def rate_prior(
    train: DataFrame, key: str, y: str, *, smoothing: float = SMOOTHING
) -> tuple[DataFrame, float]:
    """Smoothed failure rate per key, and the overall rate (one number).

    The training rows are read once: the written per-key sums give both.
    """
    label = F.col(y).cast("double")
    sums = materialize(train.groupBy(key).agg(F.sum(label).alias("s"), F.count(y).alias("n")))
    overall = sums.agg(F.sum("s") / F.sum("n")).first()[0]
    rate = float(overall) if overall is not None else float("nan")
    prior = sums.select(
        key, ((F.col("s") + smoothing * F.lit(rate)) / (F.col("n") + smoothing)).alias("prior")
    )
    return prior, rate


def target_encode(
    train: DataFrame,
    apply: DataFrame,
    key: str,
    y: str,
    *,
    smoothing: float = SMOOTHING,
    name: str = "encoded",
) -> DataFrame:
    """Attach the prior learned on ``train`` only; unseen keys get the overall rate."""
    prior, overall = rate_prior(train, key, y, smoothing=smoothing)
    joined = apply.join(broadcast_if_small(prior), key, "left")
    return joined.select(*apply.columns, F.coalesce("prior", F.lit(overall)).alias(name))
