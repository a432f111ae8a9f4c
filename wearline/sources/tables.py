"""Typed reads of telemetry, lifetimes and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wearline.functions.columns import clean_doubles
from wearline.operators.tiles import Signals


def telemetry_schema(signals: Signals, ts: str = "timestamp") -> T.StructType:
    fields = [T.StructField(ts, T.TimestampType())]
    return T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in signals.all])


LIFETIME_SCHEMA = T.StructType(
    [
        T.StructField("serial_number", T.StringType()),
        T.StructField("capacity_tb", T.DoubleType()),
        T.StructField("model", T.StringType()),
        T.StructField("min_date", T.TimestampType()),
        T.StructField("max_date", T.TimestampType()),
        T.StructField("failed", T.IntegerType()),
    ]
)


def _read(spark: SparkSession, path: str | Sequence[str], fmt: str, schema: T.StructType) -> DataFrame:
    if fmt == "csv":
        # Columns are matched to the header by name, in any order; others are ignored. Spark names
        # the columns of all files by one header, so files that differ from it must fail.
        header = spark.read.option("header", True).option("enforceSchema", False).csv(path)
        missing = [n for n in schema.fieldNames() if n not in header.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        out = header.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])
    elif fmt in ("parquet", "orc", "json"):
        raw = spark.read.format(fmt)
        # Columnar files carry their types; naming them here would refuse zone-less times.
        raw = raw.schema(schema).load(path) if fmt == "json" else raw.load(path)
        missing = [n for n in schema.fieldNames() if n not in raw.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        out = raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return clean_doubles(out)


def read_telemetry(
    spark: SparkSession,
    path: str | Sequence[str],
    signals: Signals,
    *,
    fmt: str = "parquet",
    ts: str = "timestamp",
    keys: Sequence[T.StructField] = (),
) -> DataFrame:
    """Sensor rows with parsed event time; NaN becomes null."""
    schema = telemetry_schema(signals, ts)
    for key in keys:
        schema = schema.add(key)
    return _read(spark, path, fmt, schema)


def read_lifetimes(
    spark: SparkSession, path: str | Sequence[str], *, fmt: str = "parquet"
) -> DataFrame:
    return _read(spark, path, fmt, LIFETIME_SCHEMA)


def read_metrics(spark: SparkSession, path: str, *, run: str = "run") -> DataFrame:
    """Stored metric records as (run, name, value) rows; non-numeric fields are left out."""
    wide = spark.read.json(path)
    if run not in wide.columns:
        wide = wide.withColumn(run, F.lit(""))
    names = [
        f.name
        for f in wide.schema.fields
        if f.name != run and isinstance(f.dataType, T.NumericType)
    ]
    if not names:
        raise ValueError("no numeric metrics in the file")
    typed = wide.select(run, *[F.col(n).cast("double").alias(n) for n in names])
    return typed.unpivot([run], names, "name", "value").where(F.col("value").isNotNull())
