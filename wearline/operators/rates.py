"""Serving rates, score histograms, alert rules and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wearline.functions.columns import ratio
from wearline.operators.ordered import exact_quantiles

# Cumulative score bounds, alert rules, latency objective.
SCORE_BOUNDS = (-0.3, -0.2, -0.1, -0.05, 0.0, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
SURGE_FACTOR = 3.0
REJECTED_SHARE = 0.01
SLOW_P99_SECONDS = 0.5
LATENCY_OBJECTIVE_MS = 50.0


def score_histogram(
    df: DataFrame,
    score: str,
    by: Sequence[str] = (),
    *,
    bounds: Sequence[float] = SCORE_BOUNDS,
) -> DataFrame:
    """Rows at or below each bound (infinity last), with total count and sum.

    All bounds are counted in one aggregation.
    """
    limits = [*[float(b) for b in bounds], float("inf")]
    counts = [F.count_if(F.col(score) <= b).alias(f"_{i}") for i, b in enumerate(limits)]
    wide = df.groupBy(*by).agg(
        *counts, F.sum(score).alias("score_sum"), F.count(score).alias("score_count")
    )
    rows = [F.struct(F.lit(b).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(limits)]
    return wide.select(*by, "score_sum", "score_count", F.inline(F.array(*rows)))


def histogram_quantile(buckets: DataFrame, q: float, by: Sequence[str] = ()) -> DataFrame:
    """Quantile from cumulative (le, n) rows, linear inside the bucket that holds it.

    Above the last finite bound that bound is returned; the first bucket starts at 0, or is
    its own bound if that is not positive. A group has one row per bound.
    """
    window = Window.partitionBy(*(list(by) or [F.lit(0)])).orderBy("le")
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    infinite = F.col("le") == float("inf")
    near = buckets.select(
        *by,
        "le",
        F.col("n").cast("double").alias("n"),
        F.lag("le").over(window).alias("_low"),
        F.lag("n", 1, 0).over(window).cast("double").alias("_before"),
        (F.max("n").over(whole) * F.lit(float(q))).alias("_rank"),
    )
    first = F.col("_low").isNull()
    low = F.when(first, F.lit(0.0)).otherwise(F.col("_low"))
    inside = low + (F.col("le") - low) * (F.col("_rank") - F.col("_before")) / (
        F.col("n") - F.col("_before")
    )
    value = (
        F.when(infinite, F.col("_low"))
        .when(first & (F.col("le") <= 0), F.col("le"))
        .otherwise(inside)
    )
    holding = near.where((F.col("n") >= F.col("_rank")) & (F.col("n") > 0))
    return holding.groupBy(*by).agg(F.min_by(value, F.col("le")).alias("quantile"))


def prediction_rates(
    df: DataFrame,
    *,
    ts: str = "ts",
    alert: str = "alert",
    rejected: str | None = None,
    width: str = "5 minutes",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Predictions, alerts and rejections per tile, with predictions per second.

    ``rejected`` marks rows that failed the contract; they count as no prediction.
    """
    bad = F.coalesce(F.col(rejected), F.lit(False)) if rejected else F.lit(False)
    hit = F.coalesce(F.col(alert), F.lit(False))
    tiles = df.groupBy(*keys, F.window(ts, width).alias("_w")).agg(
        F.count_if(~bad).alias("predictions"),
        F.count_if(hit & ~bad).alias("alerts"),
        F.count_if(bad).alias("rejected"),
    )
    seconds = (F.unix_micros("_w.end") - F.unix_micros("_w.start")) / F.lit(1e6)
    return tiles.select(
        *keys,
        F.col("_w.start").alias("window_start"),
        "predictions",
        "alerts",
        "rejected",
        (F.col("predictions") / seconds).alias("predictions_per_second"),
        (F.col("alerts") / seconds).alias("alerts_per_second"),
        (F.col("rejected") / seconds).alias("rejected_per_second"),
    )


def alert_surge(
    rates: DataFrame,
    keys: Sequence[str] = (),
    *,
    p99: str | None = None,
    factor: float = SURGE_FACTOR,
) -> DataFrame:
    """Add rule flags to :func:`prediction_rates` rows.

    The baseline is the mean alert rate of the tiles in the 24 h before. Each tile is seen
    by its own day and the next one, so a day's tiles are all one task needs.
    """
    day = 86_400
    timed = rates.withColumn("_s", F.unix_timestamp("window_start")).withColumn(
        "_day", F.floor(F.col("_s") / day)
    )
    spread = timed.withColumn("_of", F.explode(F.array(F.col("_day"), F.col("_day") + 1)))
    window = Window.partitionBy(*keys, "_of").orderBy("_s").rangeBetween(-day, -1)
    based = spread.withColumn("baseline", F.avg("alerts_per_second").over(window))
    home = based.where(F.col("_of") == F.col("_day")).drop("_s", "_day", "_of")
    surge = F.col("alerts_per_second") > factor * F.col("baseline")
    share = ratio("rejected", F.col("predictions") + F.col("rejected"))
    out = home.withColumn("alert_surge", F.coalesce(surge, F.lit(False))).withColumn(
        "bad_input_surge", share > REJECTED_SHARE
    )
    return out.withColumn("slow", F.col(p99) > SLOW_P99_SECONDS) if p99 else out


def request_rollup(
    df: DataFrame,
    *,
    latency: str = "latency_ms",
    ok: str = "ok",
    started: str = "started",
    by: Sequence[str] = (),
    places: int | None = 2,
) -> DataFrame:
    """Requests, throughput, p50/p99/max latency, errors and the verdict of a request log.

    Percentiles are exact and interpolated; ``places`` rounds latencies (None: as they are).
    """

    def rounded(c) -> Column:
        return c if places is None else F.bround(c, places)

    micros = F.unix_micros(F.col(started).cast("timestamp"))
    finish = micros + F.col(latency) * 1000.0
    base = df.groupBy(*by).agg(
        F.count("*").alias("n_requests"),
        ((F.max(finish) - F.min(micros)) / 1e6).alias("duration_s"),
        rounded(F.max(latency)).alias("max_ms"),
        F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("errors"),
    )
    marks = exact_quantiles(df, latency, [0.5, 0.99], by)
    pair = marks.groupBy(*by).agg(
        rounded(F.max(F.when(F.col("prob") == 0.5, F.col("quantile")))).alias("p50_ms"),
        rounded(F.max(F.when(F.col("prob") == 0.99, F.col("quantile")))).alias("p99_ms"),
    )
    joined = base.join(pair, list(by), "left") if by else base.join(F.broadcast(pair))
    throughput = F.bround(ratio("n_requests", "duration_s"), 1)
    passed = (F.col("p99_ms") <= LATENCY_OBJECTIVE_MS) & (F.col("errors") == 0)
    return joined.select(
        *by,
        "n_requests",
        F.bround("duration_s", 3).alias("duration_s"),
        throughput.alias("throughput_rps"),
        "p50_ms",
        "p99_ms",
        "max_ms",
        "errors",
        passed.alias("passed"),
    )


def standardize(
    df: DataFrame, columns: Sequence[str], *, fit_on: DataFrame | None = None, suffix: str = ""
) -> DataFrame:
    """z-scores with fitted mean and population deviation; a constant column keeps scale 1.

    The fit is one row of numbers, two per column.
    """
    moments = scaling(df if fit_on is None else fit_on, columns)
    scaled = {
        f"{c}{suffix}": (F.col(c) - F.lit(mean)) / F.lit(scale) for c, (mean, scale) in moments.items()
    }
    return df.withColumns(scaled)


def scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and scale per column."""
    parts = [f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in _MOMENTS.items()]
    row = df.agg(*parts).first()
    out = {}
    for i, c in enumerate(columns):
        mean, deviation = row[f"mean_{i}"], row[f"std_{i}"]
        out[c] = (float(mean or 0.0), float(deviation) if deviation else 1.0)
    return out


_MOMENTS = {"mean": F.avg, "std": F.stddev_pop}
