"""Hourly demand records from landed JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The fields of the feed's records, and the names and defaults of its request.
RECORD = "struct<period:string,respondent:string,type:string,value:string>"
PAYLOAD_SCHEMA = f"response struct<data:array<{RECORD}>>"


def unwrap(payloads: DataFrame, payload: str | Column = "response") -> DataFrame:
    """The records in ``response.data``; a payload without them gives no rows."""
    response = F.col(payload) if isinstance(payload, str) else payload
    return payloads.select(F.inline(response["data"]))


def parse_payloads(texts: DataFrame, column: str = "value") -> DataFrame:
    """Records from payload texts."""
    parsed = texts.select(F.from_json(column, PAYLOAD_SCHEMA).alias("p"))
    return unwrap(parsed.select("p.response"))


def demand(
    records: DataFrame,
    *,
    respondent: str = "PJM",
    start: str | None = None,
    end: str | None = None,
    length: int = 168,
) -> DataFrame:
    """Demand rows of one respondent, newest first, at most ``length``.

    ``start`` and ``end`` are inclusive hours written like ``2024-01-31T05``.
    """
    if length < 1:
        raise ValueError(f"a request needs at least one row, not {length}")
    kept = records.where((F.col("type") == "D") & (F.col("respondent") == respondent))
    if start:
        kept = kept.where(F.col("period") >= start)
    if end:
        kept = kept.where(F.col("period") <= end)
    # A top-n: each task keeps its own newest rows.
    return kept.orderBy(F.desc("period"), F.desc("value")).limit(length)


def read_demand_feed(spark: SparkSession, path: str, **request) -> DataFrame:
    return demand(unwrap(spark.read.schema(PAYLOAD_SCHEMA).json(path)), **request)


def non_null_values(records: DataFrame, value: str = "value") -> DataFrame:
    """Records with a value, as a number; what is not a number counts as missing."""
    numbers = records.withColumn(value, F.col(value).try_cast("double"))
    return numbers.where(F.col(value).isNotNull())
