"""From raw readings to daily alert quality and price, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wearline.functions.columns import alert
from wearline.operators.cost import DEFAULT_COST, confusion
from wearline.operators.labels import interval_labels, threshold_value
from wearline.plans import views
from wearline.session import materialize


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read three times below; the raw readings are scanned once.
    tiles = materialize(views.tiles(spark, sf_dir))
    reports = views.reports(spark)
    limit = threshold_value(tiles, reports, score="a1_max")
    labelled = interval_labels(tiles, reports).withColumn(
        "day", F.date_format("window_start", "yyyy-MM-dd")
    )
    daily = confusion(labelled, "label", alert("a1_max", limit), ["day"])
    return daily.withColumn("cost", DEFAULT_COST.price("tp", "fp", "fn")).withColumn(
        "threshold", F.lit(limit)
    )
