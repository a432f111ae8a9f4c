"""Query registry and the shared SQL of the derived inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wearline.plans import views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def clock(c: str | Column, name: str) -> Column:
    """Time as text to the second, the same in every engine."""
    value = F.col(c) if isinstance(c, str) else c
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss").alias(name)


def r6(c: str | Column, name: str | None = None) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    rounded = F.round(value.cast("double"), 6)
    return rounded.alias(name or c) if (name or isinstance(c, str)) else rounded


def big(c: str | Column, name: str | None = None) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    return value.cast("long").alias(name or c)


def sql_clock(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


TELE = """tele AS (
  SELECT event_id AS seq, ts, user_id AS device, value AS a1,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS a2,
         CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS d1,
         CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS d2
  FROM events)"""

STATS = """avg(a1) AS a1_mean, coalesce(stddev_samp(a1), 0) AS a1_std, min(a1) AS a1_min, max(a1) AS a1_max,
         avg(a2) AS a2_mean, coalesce(stddev_samp(a2), 0) AS a2_std, min(a2) AS a2_min, max(a2) AS a2_max,
         avg(d1) AS d1_mean, avg(d2) AS d2_mean"""

FEATURES = [
    *[f"{a}_{s}" for a in ("a1", "a2") for s in ("mean", "std", "min", "max")],
    "d1_mean",
    "d2_mean",
]
ROUNDED = ", ".join(f"round({f}, 6) AS {f}" for f in FEATURES)

TILES = f"""tiles AS (
  SELECT date_trunc('hour', ts) AS ws, {STATS}
  FROM tele GROUP BY 1 HAVING count(*) >= 6)"""

REPORTS = "reports(s, e) AS (VALUES " + ", ".join(
    f"(TIMESTAMP '{s}', TIMESTAMP '{e}')" for s, e in views.REPORTS
) + ")"

DEVICE_REPORTS = """device_reports AS (
  SELECT device, ts AS s, ts + to_minutes(CAST(a2 AS INTEGER)) AS e
  FROM tele WHERE d1 = 1 AND a1 > 150)"""

SCORED = """scored AS (
  SELECT event_id AS seq, ts, user_id AS device, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
         value AS score
  FROM events)"""

LIFE_ALL = """life_all AS (
  SELECT CAST(p_size AS DOUBLE) AS capacity_tb, p_brand AS model, o_orderdate AS min_date,
         l_shipdate AS max_date, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS failed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
LIFE = LIFE_ALL + ",\nlife AS (SELECT * FROM life_all WHERE max_date >= min_date)"

AUDIT = """audit AS (
  SELECT 'm' || (o_custkey % 50) AS model, o_orderkey AS seq,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'set_threshold'
              WHEN o_orderstatus = 'O' THEN 'register' WHEN o_orderstatus = 'F' THEN 'promote'
              ELSE 'rollback' END AS action,
         'v' || (CAST(floor(o_totalprice) AS BIGINT) % 40) AS version,
         CASE WHEN o_custkey % 3 = 0 THEN 'candidate' ELSE 'production' END AS stage,
         CASE WHEN o_orderpriority = '1-URGENT'
              THEN (CAST(floor(o_totalprice) AS BIGINT) % 1000) / 1000.0::DOUBLE END AS threshold
  FROM orders)"""

# Micros keep interval arithmetic plain.
US = "epoch_us"
HOUR_US = 3_600_000_000


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
