"""Served predictions, request logs, the demand feed, stored histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline.operators import rates as ops
from wearline.plans import views
from wearline.plans.catalogue.base import SCORED, TELE, clock, query, r6, sql_clock, with_
from wearline.session import scratch_path
from wearline.sources import feed, sinks, tables

_SERVED = """served AS (SELECT seq, ts, device, a1 / 200.0::DOUBLE - 0.3::DOUBLE AS score, a1 >= 150 AS alert, a2 > 90 AS rejected FROM tele)"""


def _served(spark, sf):
    return views.tele(spark, sf).select(
        "seq",
        "ts",
        "device",
        (F.col("a1") / 200.0 - 0.3).alias("score"),
        (F.col("a1") >= 150).alias("alert"),
        (F.col("a2") > 90).alias("rejected"),
    )


_BOUNDS = ", ".join(f"({b}::DOUBLE)" for b in ops.SCORE_BOUNDS) + ", ('inf'::DOUBLE)"
_BUCKETS = f"""bounds(le) AS (VALUES {_BOUNDS}),
buckets AS (SELECT le, sum(CASE WHEN score <= le THEN 1 ELSE 0 END)::BIGINT AS n FROM bounds, served GROUP BY 1)"""


@query(
    "score_histogram",
    with_(TELE, _SERVED, _BUCKETS)
    + """SELECT CASE WHEN isinf(le) THEN 'inf' ELSE printf('%.2f', le) END AS le, n, (SELECT count(*) FROM served) AS score_count,
  (SELECT round(sum(score), 6) FROM served) AS score_sum FROM buckets""",
)
def _score_histogram(spark, sf):
    out = ops.score_histogram(_served(spark, sf), "score")
    bound = F.when(F.col("le") == float("inf"), F.lit("inf")).otherwise(F.format_string("%.2f", "le"))
    return out.select(
        bound.alias("le"), "n", "score_count", r6("score_sum")
    )


_QUANTILE = """SELECT {q}::DOUBLE AS q, round(CASE WHEN isinf(le) THEN low WHEN low IS NULL AND le <= 0 THEN le
    ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * (rank - before) / (n - before) END, 6) AS quantile FROM (
  SELECT le, n, lag(le) OVER (ORDER BY le) AS low, lag(n, 1, 0) OVER (ORDER BY le) AS before,
    {q}::DOUBLE * (SELECT max(n) FROM buckets) AS rank FROM buckets) t
WHERE n >= rank QUALIFY row_number() OVER (ORDER BY le) = 1"""


@query(
    "histogram_quantile",
    with_(TELE, _SERVED, _BUCKETS)
    + " UNION ALL ".join(f"SELECT * FROM ({_QUANTILE.format(q=q)}) x{i}" for i, q in enumerate((0.5, 0.99))),
)
def _histogram_quantile(spark, sf):
    buckets = ops.score_histogram(_served(spark, sf), "score")
    parts = [
        ops.histogram_quantile(buckets, q).select(F.lit(q).alias("q"), r6("quantile"))
        for q in (0.5, 0.99)
    ]
    return parts[0].unionByName(parts[1])


_TILED = """rates AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, sum(CASE WHEN NOT rejected THEN 1 ELSE 0 END)::BIGINT AS predictions,
    sum(CASE WHEN alert AND NOT rejected THEN 1 ELSE 0 END)::BIGINT AS alerts,
    sum(CASE WHEN rejected THEN 1 ELSE 0 END)::BIGINT AS rejected FROM served GROUP BY 1)"""


@query(
    "prediction_rates",
    with_(TELE, _SERVED)
    + f"""SELECT {sql_clock('w')} AS window_start, predictions, alerts, rejected,
  round(predictions / 300.0::DOUBLE, 6) AS predictions_per_second FROM ({_TILED[len('rates AS ('):-1].replace('1 HOUR', '5 MINUTE')}) t""",
)
def _prediction_rates(spark, sf):
    out = ops.prediction_rates(_served(spark, sf), rejected="rejected")
    return out.select(
        clock("window_start", "window_start"), "predictions", "alerts", "rejected", r6("predictions_per_second")
    )


@query(
    "alert_surge",
    with_(TELE, _SERVED, _TILED)
    + f"""SELECT {sql_clock('w')} AS window_start, round(base, 8) AS baseline,
  coalesce(alerts / 3600.0::DOUBLE > 3 * base, false) AS alert_surge,
  rejected / (predictions + rejected)::DOUBLE > 0.01 AS bad_input_surge
FROM (SELECT *, avg(alerts / 3600.0::DOUBLE) OVER (ORDER BY w RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 SECOND PRECEDING) AS base FROM rates) t""",
)
def _alert_surge(spark, sf):
    rates = ops.prediction_rates(_served(spark, sf), rejected="rejected", width="1 hour")
    out = ops.alert_surge(rates)
    return out.select(
        clock("window_start", "window_start"),
        F.round("baseline", 8).alias("baseline"),
        "alert_surge",
        "bad_input_surge",
    )


@query(
    "request_rollup",
    """SELECT endpoint, n_requests, floor(duration_s)::BIGINT AS duration_s, round(p50, 6) AS p50_ms,
  round(p99, 6) AS p99_ms, max_ms, errors, p99 <= 50 AND errors = 0 AS passed FROM (
  SELECT event_type AS endpoint, count(*) AS n_requests,
    (max(epoch_us(ts) + value * 1000.0) - min(epoch_us(ts))) / 1e6::DOUBLE AS duration_s,
    quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99, max(value) AS max_ms,
    count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY 1) t""",
)
def _request_rollup(spark, sf):
    log = views.table(spark, sf, "events").select(
        F.col("event_type").alias("endpoint"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") != "error").alias("ok"),
        F.col("ts").cast("timestamp").alias("started"),
    )
    out = ops.request_rollup(log, by=["endpoint"], places=None)
    return out.select(
        "endpoint", "n_requests", F.floor("duration_s").alias("duration_s"), r6("p50_ms"), r6("p99_ms"), "max_ms", "errors", "passed"
    )


@query(
    "standardize",
    with_(TELE)
    + """SELECT seq, round((a1 - m1) / s1, 6) AS a1, round((a2 - m2) / s2, 6) AS a2 FROM tele,
  (SELECT avg(a1) AS m1, stddev_pop(a1) AS s1, avg(a2) AS m2, stddev_pop(a2) AS s2 FROM tele) f""",
)
def _standardize(spark, sf):
    out = ops.standardize(views.tele(spark, sf), ["a1", "a2"])
    return out.select("seq", r6("a1"), r6("a2"))


_FEED = """feed AS (SELECT strftime(ts, '%Y-%m-%dT%H') AS period, 'R' || (device % 5) AS respondent,
  CASE WHEN seq % 13 <> 0 THEN printf('%.2f', a1) END AS value FROM tele)"""


@query(
    "demand_feed",
    with_(TELE, _FEED)
    + """SELECT period, value FROM feed WHERE respondent = 'R3' AND period <= '2024-01-20T05'
ORDER BY period DESC, value DESC NULLS LAST LIMIT 168""",
)
def _demand_feed(spark, sf):
    records = feed.parse_payloads(views.payloads(spark, sf))
    return feed.demand(records, respondent="R3", end="2024-01-20T05").select("period", "value")


@query(
    "feed_values",
    with_(TELE, _FEED)
    + """SELECT respondent, count(*) AS n, round(sum(value::DOUBLE), 4) AS total FROM feed WHERE value IS NOT NULL GROUP BY 1""",
)
def _feed_values(spark, sf):
    records = feed.parse_payloads(views.payloads(spark, sf)).where(F.col("type") == "D")
    rows = feed.non_null_values(records)
    return rows.groupBy("respondent").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(
    "performance_history",
    with_(SCORED)
    + """SELECT part, n FROM (SELECT device % 4 AS part, count(*) AS n FROM scored GROUP BY 1) t""",
)
def _performance_history(spark, sf):
    """Appended in two writes as JSON lines, then read back."""
    path = scratch_path(spark, "history")
    rows = views.scored(spark, sf).withColumn("part", F.pmod("device", F.lit(4)))
    counted = rows.groupBy("part").agg(F.count("*").alias("n"))
    sinks.append_performance(counted.where(F.col("part") < 2), path)
    sinks.append_performance(counted.where(F.col("part") >= 2), path)
    return spark.read.schema("part long, n long").json(path)


@query(
    "read_metrics",
    with_(SCORED)
    + """SELECT run, name, round(value, 6) AS value FROM (
  SELECT (device % 4)::VARCHAR AS run, 'mean_score' AS name, avg(score) AS value FROM scored GROUP BY 1
  UNION ALL SELECT (device % 4)::VARCHAR, 'rate', avg(y)::DOUBLE FROM scored GROUP BY 1) t""",
)
def _read_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    rows = views.scored(spark, sf).groupBy(F.pmod("device", F.lit(4)).cast("string").alias("run"))
    sinks.append_performance(rows.agg(F.avg("score").alias("mean_score"), F.avg("y").alias("rate")), path)
    return tables.read_metrics(spark, path).select("run", "name", r6("value"))


@query(
    "read_telemetry",
    with_(TELE) + "SELECT count(*) AS rows, round(sum(a1), 3) AS a1, round(sum(a2), 3) AS a2, sum(d1)::BIGINT AS d1 FROM tele",
)
def _read_telemetry(spark, sf):
    """Written as header text and read by contract."""
    path = scratch_path(spark, "telemetry")
    rows = views.tele(spark, sf).withColumnRenamed("ts", "timestamp")
    rows.write.option("header", True).csv(path)
    back = tables.read_telemetry(spark, path, views.SIGNALS, fmt="csv")
    return back.agg(
        F.count("timestamp").alias("rows"),
        F.round(F.sum("a1"), 3).alias("a1"),
        F.round(F.sum("a2"), 3).alias("a2"),
        F.sum("d1").cast("long").alias("d1"),
    )


