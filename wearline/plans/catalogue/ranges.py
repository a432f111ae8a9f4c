"""Ordered operators again, on ranges far smaller than the tables, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline.operators import cost, governance
from wearline.operators.ordered import exact_quantiles, mean_rank, row_index
from wearline.plans import views
from wearline.plans.catalogue.base import ORACLES, query, r6

_SMALL = 500


@query("row_index_ranges", ORACLES["row_index"])
def _row_index_ranges(spark, sf):
    rows = views.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    out = row_index(rows, ["o_orderdate", "o_orderkey"], rows_per_bucket=_SMALL)
    return out.select("o_orderkey", "row_index")


@query("row_index_fleet_ranges", ORACLES["row_index_fleet"])
def _row_index_fleet_ranges(spark, sf):
    rows = views.table(spark, sf, "events").select("event_id", "user_id", "ts")
    out = row_index(rows, ["ts", "event_id"], ["user_id"], rows_per_bucket=_SMALL)
    return out.select("event_id", "row_index")


@query(
    "text_row_index_ranges",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey) - 1 AS row_index
FROM orders""",
)
def _text_row_index_ranges(spark, sf):
    rows = views.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    out = row_index(rows, ["o_orderpriority", "o_orderkey"], ["o_orderstatus"], rows_per_bucket=_SMALL)
    return out.select("o_orderkey", "row_index")


@query("cost_curve_ranges", ORACLES["cost_curve"])
def _cost_curve_ranges(spark, sf):
    from wearline.plans.catalogue.costs import _MODEL

    out = cost.cost_curve(views.scored(spark, sf), "y", "score", _MODEL, rows_per_bucket=_SMALL)
    return out.select(r6("threshold"), r6("cost"))


@query("audit_replay_ranges", ORACLES["audit_replay"])
def _audit_replay_ranges(spark, sf):
    return governance.replay_audit(views.audit(spark, sf), rows_per_bucket=_SMALL)


@query(
    "mean_rank_ranges",
    """SELECT value, count(*) AS n, round(avg(r), 6) AS mean_rank FROM (
  SELECT value, row_number() OVER (ORDER BY value) AS r FROM events WHERE value IS NOT NULL) t GROUP BY 1""",
)
def _mean_rank_ranges(spark, sf):
    rows = views.table(spark, sf, "events").where(F.col("value").isNotNull()).select("value")
    out = mean_rank(rows, "value", rows_per_bucket=_SMALL)
    return out.select("value", "n", r6("mean_rank"))


@query(
    "quantiles_ranges",
    "SELECT prob, round(quantile, 6) AS quantile FROM (VALUES "
    + ", ".join(f"({p}::DOUBLE, (SELECT quantile_cont(value, {p}) FROM events))" for p in (0.01, 0.5, 0.999))
    + ") q(prob, quantile)",
)
def _quantiles_ranges(spark, sf):
    rows = views.table(spark, sf, "events").select("value")
    out = exact_quantiles(rows, "value", [0.01, 0.5, 0.999], rows_per_bucket=_SMALL)
    return out.select("prob", r6("quantile"))
