"""The operators' inputs, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wearline.operators.labels import events_frame
from wearline.operators.tiles import Signals, window_features

SIGNALS = Signals(("a1", "a2"), ("d1", "d2"))
RANGES = {"a1": (0.0, 200.0), "a2": (0.0, 90.0)}
STATES = ("d1", "d2")

# Four site-wide failure reports inside the month of telemetry.
REPORTS = (
    ("2024-01-12 00:00:00", "2024-01-12 23:59:00"),
    ("2024-01-17 23:30:00", "2024-01-18 06:00:00"),
    ("2024-01-22 10:00:00", "2024-01-24 14:30:00"),
    ("2024-01-28 14:30:00", "2024-01-28 19:00:00"),
)
CURRENT_FROM = "2024-01-16 00:00:00"
ARRIVALS = ("2024-01-09 00:00:00", CURRENT_FROM, "2024-01-24 00:00:00")

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


# Declared, so that no read has to open files to learn its columns.
SCHEMAS = {
    "events": EVENT_SCHEMA,
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "part": (
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def as_telemetry(events: DataFrame) -> DataFrame:
    """Events as sensor rows: two analogs, two states, device, arrival number."""
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("device"),
        F.col("value").alias("a1"),
        F.regexp_extract("props", r'"k":\s*([0-9.]+)', 1).cast("double").alias("a2"),
        (F.col("event_type") == "error").cast("double").alias("d1"),
        (F.col("event_type") == "purchase").cast("double").alias("d2"),
    )


def tele(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_telemetry(table(spark, sf_dir, "events"))


def tele_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events*.parquet")
    return as_telemetry(files.parquet(sf_dir))


def arrivals(spark: SparkSession, sf_dir: str, borders: tuple[str, ...] = ARRIVALS, overlap: str = "0 minutes") -> list[DataFrame]:
    """Telemetry as it comes in, one table per arrival; each repeats the ``overlap`` before its border."""
    rows = tele(spark, sf_dir)
    since, until = [None, *borders], [*borders, None]
    slices = []
    for a, b in zip(since, until):
        part = rows if a is None else rows.where(F.col("ts") >= F.to_timestamp(F.lit(a)) - F.expr(f"INTERVAL {overlap}"))
        slices.append(part if b is None else part.where(F.col("ts") < F.to_timestamp(F.lit(b))))
    return slices


def tiles(spark: SparkSession, sf_dir: str, min_rows: int = 6) -> DataFrame:
    return window_features(tele(spark, sf_dir), SIGNALS, width="1 hour", min_rows=min_rows)


def reports(spark: SparkSession) -> DataFrame:
    return events_frame(spark, REPORTS)


def device_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure reports per device: high error readings, lasting ``a2`` minutes."""
    high = tele(spark, sf_dir).where((F.col("d1") == 1) & (F.col("a1") > 150))
    minutes = F.make_dt_interval(mins=F.col("a2").cast("int"))
    return high.select("device", F.col("ts").alias("start"), (F.col("ts") + minutes).alias("end"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and scores with many ties: y = error, score = reading."""
    return tele(spark, sf_dir).select(
        "seq", "ts", "device", F.col("d1").cast("int").alias("y"), F.col("a1").alias("score")
    )


def life_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit lifetimes from order to shipment, including impossible ones."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_suppkey", "l_extendedprice"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(
        parts, lines.l_partkey == parts.p_partkey
    )
    unit = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    return joined.select(
        unit.alias("serial_number"),
        F.col("p_size").cast("double").alias("capacity_tb"),
        F.col("p_brand").alias("model"),
        F.col("o_orderdate").cast("timestamp").alias("min_date"),
        F.col("l_shipdate").cast("timestamp").alias("max_date"),
        (F.col("l_returnflag") == "R").cast("int").alias("failed"),
    )


def life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return life_all(spark, sf_dir).where(F.col("max_date") >= F.col("min_date"))


def samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference and current halves of the month."""
    rows = tele(spark, sf_dir)
    cut = F.to_timestamp(F.lit(CURRENT_FROM))
    return rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut)


def requests(spark: SparkSession, sf_dir: str, size: int = 8) -> DataFrame:
    """Scoring requests of at most ``size`` consecutive readings each."""
    rows = tele(spark, sf_dir).withColumn("request", F.floor(F.col("seq") / size).cast("long"))
    reading = F.struct("seq", "a1", "a2", "d1", "d2")
    # A request number covers ``size`` arrival numbers, which bounds the list.
    return rows.groupBy("request").agg(F.sort_array(F.collect_list(reading)).alias("readings"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry log of 50 models from the orders."""
    status = F.col("o_orderstatus")
    action = F.when(status == "O", "register").when(status == "F", "promote").otherwise("rollback")
    retune = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("m"), F.pmod("o_custkey", F.lit(50))).alias("model"),
        F.col("o_orderkey").alias("seq"),
        F.when(retune, "set_threshold").otherwise(action).alias("action"),
        F.concat(F.lit("v"), F.pmod(F.floor("o_totalprice"), F.lit(40))).alias("version"),
        F.when(F.pmod("o_custkey", F.lit(3)) == 0, "candidate").otherwise("production").alias("stage"),
        F.when(retune, F.pmod(F.floor("o_totalprice"), F.lit(1000)) / 1000.0).alias("threshold"),
    )


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric rows per model and version, from order prices; some are missing."""
    names = ("roc_auc", "pr_auc", "recall")
    cells = F.array(
        *[
            F.when(
                F.pmod(F.col("version_no") + i, F.lit(11)) != 0,
                F.struct(
                    F.lit(n).alias("name"),
                    (F.lit(0.5) + 0.5 * F.col("level") * (1.0 - 0.1 * i)).alias("value"),
                ),
            )
            for i, n in enumerate(names)
        ]
    )
    number = F.pmod(F.floor("o_totalprice"), F.lit(40))
    best = table(spark, sf_dir, "orders").groupBy(
        F.concat(F.lit("m"), F.pmod("o_custkey", F.lit(50))).alias("model"), number.alias("version_no")
    ).agg((F.max("o_totalprice") / 500_000.0).alias("level"))
    return best.select(
        "model",
        F.concat(F.lit("v"), F.col("version_no")).alias("version"),
        F.inline(F.array_compact(cells)),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed payload texts, one per event, each with a demand and a forecast record."""
    def record(kind: str, value):
        return F.struct(
            F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH").alias("period"),
            F.concat(F.lit("R"), F.pmod("device", F.lit(5))).alias("respondent"),
            F.lit(kind).alias("type"),
            value.alias("value"),
        )

    # Some readings have no value, as in the real feed.
    demand = F.when(F.pmod("seq", F.lit(13)) != 0, F.format_string("%.2f", "a1"))
    forecast = F.format_string("%.2f", F.col("a2"))
    response = F.struct(F.struct(F.array(record("D", demand), record("DF", forecast)).alias("data")).alias("response"))
    return tele(spark, sf_dir).select(F.to_json(response).alias("value"))
