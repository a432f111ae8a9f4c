"""Contracts and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from wearline.operators import contracts as ops, profile
from wearline.plans import views
from wearline.plans.catalogue.base import LIFE_ALL, TELE, big, query, r6, with_
from wearline.session import materialize

_BROKEN = """broken AS (
  SELECT seq, 'a1' AS "column", 'in_range' AS rule, a1 AS value FROM tele WHERE a1 NOT BETWEEN 0 AND 200
  UNION ALL SELECT seq, 'a2', 'in_range', a2 FROM tele WHERE a2 NOT BETWEEN 0 AND 90
  UNION ALL SELECT seq, 'a1', 'not_null', a1 FROM tele WHERE a1 IS NULL
  UNION ALL SELECT seq, 'a2', 'not_null', a2 FROM tele WHERE a2 IS NULL
  UNION ALL SELECT seq, 'd1', 'binary', d1 FROM tele WHERE d1 NOT IN (0, 1)
  UNION ALL SELECT seq, 'd2', 'binary', d2 FROM tele WHERE d2 NOT IN (0, 1))"""


def _contract():
    return ops.telemetry_contract(views.RANGES, views.STATES)


@query(
    "contract_violations",
    with_(TELE, _BROKEN) + 'SELECT seq, "column", rule, round(value, 6) AS value FROM broken',
)
def _contract_violations(spark, sf):
    out = ops.violations(views.tele(spark, sf), _contract(), ident=["seq"])
    return out.select("seq", "column", "rule", r6("value"))


@query(
    "contract_summary",
    with_(TELE, _BROKEN) + 'SELECT "column", rule, count(*) AS rows FROM broken GROUP BY 1, 2',
)
def _contract_summary(spark, sf):
    return ops.violation_counts(views.tele(spark, sf), _contract())


@query(
    "split_valid",
    with_(TELE)
    + """SELECT CASE WHEN a1 BETWEEN 0 AND 200 AND a2 BETWEEN 0 AND 90 THEN 'accepted' ELSE 'quarantined' END AS side,
  count(*) AS rows, sum(seq)::BIGINT AS seq_sum FROM tele GROUP BY 1""",
)
def _split_valid(spark, sf):
    good, bad = ops.split_valid(views.tele(spark, sf), _contract())
    both = good.withColumn("side", F.lit("accepted")).unionByName(
        bad.withColumn("side", F.lit("quarantined"))
    )
    return both.groupBy("side").agg(F.count("*").alias("rows"), F.sum("seq").alias("seq_sum"))


@query(
    "coerce",
    """SELECT o_orderkey, TRY_CAST(replace(o_orderpriority, '-', '.') AS DOUBLE) IS NULL AS bad_priority,
  TRY_CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS level FROM orders""",
)
def _coerce(spark, sf):
    raw = views.table(spark, sf, "orders").select(
        "o_orderkey",
        F.replace("o_orderpriority", F.lit("-"), F.lit(".")).alias("priority"),
        F.substring("o_orderpriority", 1, 1).alias("level"),
    )
    schema = T.StructType(
        [T.StructField("priority", T.DoubleType()), T.StructField("level", T.LongType())]
    )
    cast, checks = ops.coerce(raw, schema)
    failed = [c for c in checks if c.column == "_raw_priority"][0]
    return cast.select("o_orderkey", failed.bad.alias("bad_priority"), "level")


@query(
    "time_order",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(previous, '%Y-%m-%d') AS previous FROM (
  SELECT o_orderkey, o_orderdate, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS previous FROM orders) t
WHERE previous > o_orderdate""",
)
def _time_order(spark, sf):
    out = ops.time_order_violations(views.table(spark, sf, "orders"), "o_orderdate", "o_orderkey")
    return out.select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.date_format("previous", "yyyy-MM-dd").alias("previous"),
    )


@query(
    "time_order_fleet",
    """SELECT o_custkey, count(*) AS late FROM (
  SELECT o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous
  FROM orders) t WHERE previous > o_orderdate GROUP BY 1""",
)
def _time_order_fleet(spark, sf):
    out = ops.time_order_violations(
        views.table(spark, sf, "orders"), "o_orderdate", "o_orderkey", ["o_custkey"]
    )
    return out.groupBy("o_custkey").agg(F.count("*").alias("late"))


@query(
    "request_contract",
    with_(TELE)
    + """SELECT seq // 8 AS request, NOT bool_or(a1 NOT BETWEEN 0 AND 200 OR a2 NOT BETWEEN 0 AND 90) AS accepted,
  concat_ws(',', CASE WHEN bool_or(a1 NOT BETWEEN 0 AND 200) THEN 'a1:in_range' END,
                 CASE WHEN bool_or(a2 NOT BETWEEN 0 AND 90) THEN 'a2:in_range' END) AS reasons
FROM tele GROUP BY 1""",
)
def _request_contract(spark, sf):
    out = ops.request_contract(views.requests(spark, sf), views.RANGES, views.STATES)
    return out.select("request", "accepted", F.array_join("reasons", ",").alias("reasons"))


@query(
    "lifetime_contract",
    with_(LIFE_ALL)
    + """SELECT 'max_date' AS "column", 'not_before_min_date' AS rule, count(*) AS rows FROM life_all
WHERE max_date < min_date HAVING count(*) > 0
UNION ALL SELECT 'capacity_tb', 'not_negative', count(*) FROM life_all
WHERE capacity_tb < 0 OR capacity_tb IS NULL HAVING count(*) > 0
UNION ALL SELECT 'failed', 'binary', count(*) FROM life_all WHERE failed NOT IN (0, 1) HAVING count(*) > 0""",
)
def _lifetime_contract(spark, sf):
    return ops.violation_counts(views.life_all(spark, sf), ops.lifetime_contract())


def _profile_sql() -> str:
    rows = [
        "SELECT 'ts' AS \"column\", 'rows' AS metric, count(*)::DOUBLE AS value FROM tele",
        "SELECT 'ts', 'first', min(epoch_us(ts))::DOUBLE FROM tele",
        "SELECT 'ts', 'last', max(epoch_us(ts))::DOUBLE FROM tele",
        "SELECT 'ts', 'duplicate_timestamps', (count(ts) - count(DISTINCT ts))::DOUBLE FROM tele",
        "SELECT 'ts', 'monotonic', CASE WHEN count(*) = 0 THEN 1.0::DOUBLE ELSE 0.0 END FROM "
        "(SELECT ts, lag(ts) OVER (ORDER BY seq) AS p FROM tele) t WHERE p > ts",
    ]
    for c, (low, high) in views.RANGES.items():
        rows += [
            f"SELECT '{c}', 'min', round(min({c}), 6) FROM tele",
            f"SELECT '{c}', 'max', round(max({c}), 6) FROM tele",
            f"SELECT '{c}', 'out_of_bound_rows', count(*)::DOUBLE FROM tele WHERE {c} < {low} OR {c} > {high}",
            f"SELECT '{c}', 'bound_low', {low}::DOUBLE",
            f"SELECT '{c}', 'bound_high', {high}::DOUBLE",
        ]
        rows += [
            f"SELECT '{c}', '{n}', round(quantile_cont({c}, {p}), 6) FROM tele"
            for n, p in profile.PROFILE_QUANTILES.items()
        ]
    rows += [
        f"SELECT '{c}', 'rows_at_' || CASE {c} WHEN 0 THEN '0.0' ELSE '1.0' END, count(*)::DOUBLE FROM tele GROUP BY {c}"
        for c in views.STATES
    ]
    return with_(TELE) + "\nUNION ALL\n".join(rows)


@query("quality_profile", _profile_sql())
def _quality_profile(spark, sf):
    out = profile.quality_profile(
        views.tele(spark, sf), views.SIGNALS, views.RANGES, ts="ts", seq="seq"
    )
    return out.select("column", "metric", r6("value"))


@query(
    "quality_profile_fleet",
    with_(TELE)
    + """SELECT device, 'a1' AS "column", m.metric, round(CASE m.metric WHEN 'min' THEN min(a1) WHEN 'max' THEN max(a1)
    WHEN 'p50' THEN quantile_cont(a1, 0.5) ELSE count(CASE WHEN a1 < 0 OR a1 > 200 THEN 1 END) END::DOUBLE, 6) AS value
  FROM tele, (VALUES ('min'), ('max'), ('p50'), ('out_of_bound_rows')) m(metric) GROUP BY device, m.metric
UNION ALL SELECT device, 'ts', m.metric, CASE m.metric WHEN 'rows' THEN count(*) WHEN 'monotonic' THEN 1 - max(late)
    ELSE count(*) - count(DISTINCT ts) END::DOUBLE
  FROM (SELECT *, coalesce(lag(ts) OVER (PARTITION BY device ORDER BY seq) > ts, false)::INTEGER AS late FROM tele) t,
    (VALUES ('rows'), ('monotonic'), ('duplicate_timestamps')) m(metric) GROUP BY device, m.metric""",
)
def _quality_profile_fleet(spark, sf):
    out = profile.quality_profile(
        views.tele(spark, sf), views.SIGNALS, views.RANGES, ts="ts", seq="seq", keys=["device"]
    )
    wanted = {"a1": ["min", "max", "p50", "out_of_bound_rows"], "ts": ["rows", "monotonic", "duplicate_timestamps"]}
    chosen = F.lit(False)
    for column, metrics in wanted.items():
        chosen = chosen | ((F.col("column") == column) & F.col("metric").isin(metrics))
    return out.where(chosen).select("device", "column", "metric", r6("value"))


@query(
    "sketched_quantiles",
    with_(TELE)
    + """SELECT c.name AS "column", p.prob, count(CASE c.name WHEN 'a1' THEN a1 ELSE a2 END) AS n, true AS within
FROM tele, (VALUES ('a1'), ('a2')) c(name), (VALUES (0.01::DOUBLE), (0.5::DOUBLE), (0.99::DOUBLE)) p(prob) GROUP BY 1, 2""",
)
def _sketched_quantiles(spark, sf):
    """Sketches per device and day, stored and merged; their ranks are checked against all rows."""
    rows = views.tele(spark, sf)
    stored = materialize(profile.quantile_sketches(rows, ["a1", "a2"], keys=["device"]))
    # Six rows.
    found = F.broadcast(profile.sketched_quantiles(stored, [0.01, 0.5, 0.99]))
    cells = [F.struct(F.lit(c).alias("of"), F.col(c).alias("value")) for c in ("a1", "a2")]
    met = rows.select(F.inline(F.array(*cells))).join(found, F.col("of") == F.col("column"))
    ranks = met.groupBy("column", "prob", "n").agg(
        F.count_if(F.col("value") < F.col("quantile")).alias("below"),
        F.count_if(F.col("value") <= F.col("quantile")).alias("upto"),
    )
    # Three times the stated error, plus one row.
    slack = 3 * profile.SKETCH_RANK_ERROR * F.col("n") + 1
    rank = F.col("prob") * F.col("n")
    within = (F.col("below") <= rank + slack) & (F.col("upto") >= rank - slack)
    return ranks.select("column", "prob", "n", within.alias("within"))


@query(
    "quantiles",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS prob, round(quantile_cont({c}, {p}), 6) AS quantile FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
        for p in (0.01, 0.5, 0.99)
    ),
)
def _quantiles(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    out = profile.quantiles(views.table(spark, sf, "lineitem"), columns, [0.01, 0.5, 0.99])
    return out.select("column", "prob", r6("quantile"))


@query(
    "non_binary_values",
    """SELECT 'l_linenumber' AS "column", l_linenumber::DOUBLE AS value, count(*) AS rows FROM lineitem
WHERE l_linenumber NOT IN (0, 1) GROUP BY 2
UNION ALL SELECT 'l_discount', round(l_discount, 6), count(*) FROM lineitem
WHERE l_discount NOT IN (0, 1) GROUP BY 2""",
)
def _non_binary_values(spark, sf):
    out = profile.non_binary(views.table(spark, sf, "lineitem"), ["l_linenumber", "l_discount"])
    return out.select("column", r6("value"), big("rows"))


