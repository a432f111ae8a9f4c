"""Appends and small marts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def append_performance(records: DataFrame, path: str) -> None:
    """Append performance records to a JSON-lines history."""
    records.write.mode("append").json(path)


def write_mart(df: DataFrame, path: str, *, fmt: str = "parquet", files: int = 1) -> None:
    """Write an aggregated table; ``files`` is for results that are small by construction.

    The rows are gathered by a shuffle, so that the aggregation before it keeps its tasks.
    """
    writer = df.repartition(files).write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def run_log(
    metrics: DataFrame,
    names: Sequence[str],
    *,
    by: Sequence[str] = ("model",),
    step: str | None = None,
    params: Mapping[str, object] | None = None,
) -> DataFrame:
    """Metrics as (run, step, kind, name, value) rows; a run's parameters once, as text, without step."""
    run = F.concat_ws("/", *[F.col(c).cast("string") for c in by])
    steps = F.col(step).cast("long") if step else F.lit(None).cast("long")
    cells = [
        F.struct(
            F.lit("metric").alias("kind"), F.lit(n).alias("name"), F.col(n).cast("string").alias("value")
        )
        for n in names
    ]
    logged = metrics.select(run.alias("run"), steps.alias("step"), F.inline(F.array(*cells)))
    if not params:
        return logged
    given = [
        F.struct(F.lit("param").alias("kind"), F.lit(k).alias("name"), F.lit(str(v)).alias("value"))
        for k, v in params.items()
    ]
    runs = metrics.select(run.alias("run")).distinct()
    once = runs.select("run", F.lit(None).cast("long").alias("step"), F.inline(F.array(*given)))
    return logged.unionByName(once)


def log_run_metrics(metrics: DataFrame, path: str, names: Sequence[str], **options) -> None:
    run_log(metrics, names, **options).write.mode("append").parquet(path)


def log_means(log: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Mean of every logged metric over its steps."""
    metric = log.where((F.col("kind") == "metric") & F.col("step").isNotNull())
    return metric.groupBy(*by, "name").agg(
        F.avg(F.col("value").cast("double")).alias("mean"), F.count("*").alias("steps")
    )


def leaderboard(log: DataFrame, name: str = "roc_auc") -> DataFrame:
    """Runs by the mean of one metric, best first."""
    return log_means(log).where(F.col("name") == name).orderBy(F.desc("mean"), "run")
