"""Small published tables: hourly timeline, failure rates, one nested summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wearline.operators.lifetimes import afr, fleet_totals, risk_cohort, worst
from wearline.operators.tiles import downsample


def timeline(scored: DataFrame, *, score: str = "score", ts: str = "window_start") -> DataFrame:
    return downsample(scored, score, ts=ts, width="1 hour").withColumnRenamed(ts, "ts").orderBy("ts")


def afr_mart(lifetimes: DataFrame, *, min_units: int = 5000, k: int = 8) -> DataFrame:
    return worst(afr(lifetimes, min_units=min_units), k).select("model", "afr", "units", "failures")


def summary_struct(
    tiles: DataFrame, events: DataFrame, lifetimes: DataFrame, threshold: float, **cohort
) -> DataFrame:
    """One nested record over both datasets."""
    n_tiles = tiles.agg(F.count("*").alias("windows"))
    n_events = events.agg(F.count("*").alias("failures"))
    at_risk = risk_cohort(lifetimes, **cohort).agg(
        F.count("*").alias("cohort_units"), F.sum(F.col("y").cast("long")).alias("cohort_failures")
    )
    one = fleet_totals(lifetimes).withColumnRenamed("failures", "unit_failures")
    for part in (n_tiles, n_events, at_risk):
        # Single rows.
        one = one.join(F.broadcast(part), F.lit(True), "left")
    return one.select(
        F.lit(float(threshold)).alias("anomaly_threshold"),
        F.struct("failures", "windows").alias("telemetry"),
        F.struct(
            F.col("units"), F.col("unit_failures").alias("failures"), "models", "cohort_units", "cohort_failures"
        ).alias("fleet"),
    )
