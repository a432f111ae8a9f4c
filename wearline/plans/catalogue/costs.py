"""Costs, cutoffs, calendars and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline.functions.columns import alert
from wearline.operators import cost as ops, ranking
from wearline.operators.cost import DEFAULT_COST, CostModel
from wearline.operators.labels import interval_labels
from wearline.operators.ordered import ecdf, mean_rank
from wearline.plans import views
from wearline.plans.flagship import flagship
from wearline.plans.catalogue.base import (
    DEVICE_REPORTS,
    REPORTS,
    SCORED,
    TELE,
    TILES,
    big,
    query,
    r6,
    with_,
)

# Cheap alarms, so that cutoffs inside the score range can win.
_MODEL = CostModel(cost_fn=1000.0, cost_fp=250.0, cost_tp=10.0)

_COUNTS = """sum(CASE WHEN y = 1 AND score >= {t} THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y = 0 AND score >= {t} THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y = 1 AND NOT score >= {t} THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN y = 0 AND NOT score >= {t} THEN 1 ELSE 0 END) AS tn"""
_PRICE = "(fn * 1000.0::DOUBLE + fp * 250.0::DOUBLE + tp * 10.0::DOUBLE)"
_PR = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall"""
_BIGS = "tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn"


@query(
    "confusion",
    with_(SCORED)
    + f"""SELECT day, {_BIGS}, {_PR} FROM (
  SELECT strftime(ts, '%Y-%m-%d') AS day, {_COUNTS.format(t=60)} FROM scored GROUP BY 1) t""",
)
def _confusion(spark, sf):
    rows = views.scored(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = ops.confusion(rows, "y", alert("score", 60.0), ["day"])
    return out.select("day", "tp", "fp", "fn", "tn", r6("precision"), r6("recall"))


@query(
    "confusion_cost",
    with_(SCORED)
    + f"SELECT device, round({_PRICE}, 6) AS cost FROM (SELECT device, {_COUNTS.format(t=60)} FROM scored GROUP BY 1) t",
)
def _confusion_cost(spark, sf):
    out = ops.expected_cost(views.scored(spark, sf), "y", "score", 60.0, _MODEL, ["device"])
    return out.select("device", r6("cost"))


@query(
    "baseline_costs",
    with_(SCORED)
    + """SELECT round(sum(y) * 10.0 + sum(1 - y) * 250.0, 6)::DOUBLE AS always_cost,
  round(sum(y) * 1000.0, 6)::DOUBLE AS never_cost FROM scored""",
)
def _baseline_costs(spark, sf):
    out = ops.baseline_costs(views.scored(spark, sf), "y", _MODEL)
    return out.select(r6("always_cost"), r6("never_cost"))


_CURVE = f"""cutoffs AS (SELECT DISTINCT score AS t FROM scored UNION ALL SELECT max(score) + 1 FROM scored),
curve AS (SELECT t AS threshold, {_PRICE} AS cost FROM (
  SELECT t, {_COUNTS.format(t='t')} FROM cutoffs, scored GROUP BY t) c)"""


@query(
    "cost_curve",
    with_(SCORED, _CURVE) + "SELECT round(threshold, 6) AS threshold, round(cost, 6) AS cost FROM curve",
)
def _cost_curve(spark, sf):
    out = ops.cost_curve(views.scored(spark, sf), "y", "score", _MODEL)
    return out.select(r6("threshold"), r6("cost"))


@query(
    "optimal_threshold",
    with_(SCORED, _CURVE)
    + """SELECT round(threshold, 6) AS threshold, round(cost, 6) AS cost FROM curve
ORDER BY curve.cost, curve.threshold DESC LIMIT 1""",
)
def _optimal_threshold(spark, sf):
    out = ops.optimal_threshold(views.scored(spark, sf), "y", "score", _MODEL)
    return out.select(r6("threshold"), r6("cost"))


@query(
    "optimal_threshold_fleet",
    with_(
        SCORED,
        """cutoffs AS (SELECT DISTINCT device, score AS t FROM scored
  UNION ALL SELECT device, max(score) + 1 FROM scored GROUP BY device)""",
        f"""curve AS (SELECT device, t AS threshold, {_PRICE} AS cost FROM (
  SELECT s.device, t, {_COUNTS.format(t='t')} FROM cutoffs c JOIN scored s ON s.device = c.device GROUP BY s.device, t) c)""",
    )
    + """SELECT device, round(threshold, 6) AS threshold, round(cost, 6) AS cost FROM (
  SELECT *, row_number() OVER (PARTITION BY device ORDER BY cost, threshold DESC) AS i FROM curve) t WHERE i = 1""",
)
def _optimal_threshold_fleet(spark, sf):
    out = ops.optimal_threshold(views.scored(spark, sf), "y", "score", _MODEL, ["device"])
    return out.select("device", r6("threshold"), r6("cost"))


_TILE_LABELS = """labelled AS (
  SELECT ws, row_number() OVER (ORDER BY ws) - 1 AS i,
    CASE WHEN EXISTS (SELECT 1 FROM reports r WHERE ws >= r.s - INTERVAL 2 HOUR AND ws <= r.e) THEN 1 ELSE 0 END AS y
  FROM tiles)"""


def _labelled_tiles(spark, sf):
    out = interval_labels(views.tiles(spark, sf), views.reports(spark), name="y")
    return out.select("window_start", "a1_max", "y")


def _schedule_price(every: str) -> str:
    return (
        f"sum(CASE WHEN i % {every} = 0 THEN 200.0::DOUBLE WHEN y = 1 THEN 3000.0::DOUBLE ELSE 0 END)"
    )


@query(
    "schedule_cost",
    with_(TELE, TILES, REPORTS, _TILE_LABELS)
    + f"SELECT round({_schedule_price('24')}, 6) AS cost FROM labelled",
)
def _schedule_cost(spark, sf):
    out = ops.schedule_cost(_labelled_tiles(spark, sf), "y", 24, DEFAULT_COST, ["window_start"])
    return out.select(r6("cost"))


_PRICED = f"""priced AS (SELECT d.days, {_schedule_price('(d.days * 24)')} AS cost
  FROM labelled, (VALUES (1), (3), (7), (14)) d(days) GROUP BY d.days)"""


@query(
    "best_schedule",
    with_(TELE, TILES, REPORTS, _TILE_LABELS, _PRICED)
    + """SELECT round(cost, 6) AS schedule_cost, days::BIGINT AS schedule_days FROM priced
ORDER BY priced.cost, days LIMIT 1""",
)
def _best_schedule(spark, sf):
    out = ops.best_schedule(_labelled_tiles(spark, sf), "y", 24.0, DEFAULT_COST, ["window_start"])
    return out.select(r6("schedule_cost"), big("schedule_days"))


@query(
    "schedule_cost_fleet",
    with_(SCORED)
    + """SELECT device, round(sum(CASE WHEN i % 5 = 0 THEN 200.0::DOUBLE WHEN y = 1 THEN 3000.0::DOUBLE ELSE 0 END), 6) AS cost
FROM (SELECT device, y, row_number() OVER (PARTITION BY device ORDER BY ts, seq) - 1 AS i FROM scored) t GROUP BY 1""",
)
def _schedule_cost_fleet(spark, sf):
    out = ops.schedule_cost(
        views.scored(spark, sf), "y", 5, DEFAULT_COST, ["ts", "seq"], ["device"]
    )
    return out.select("device", r6("cost"))


@query(
    "roi",
    with_(TELE, TILES, REPORTS, _TILE_LABELS, _PRICED)
    + """SELECT round((s - m) / s, 6) AS roi FROM (SELECT (SELECT min(cost) FROM priced) AS s,
  (SELECT sum(CASE WHEN a1_max >= 200 THEN 200.0::DOUBLE WHEN y = 1 THEN 3000.0::DOUBLE ELSE 0 END)
   FROM labelled l JOIN tiles t ON t.ws = l.ws) AS m) x""",
)
def _roi(spark, sf):
    rows = _labelled_tiles(spark, sf)
    schedule = ops.best_schedule(rows, "y", 24.0, DEFAULT_COST, ["window_start"])
    model = ops.expected_cost(rows, "y", "a1_max", 200.0, DEFAULT_COST)
    # Two one-row results.
    both = schedule.join(F.broadcast(model), F.lit(True), "left")
    return both.select(r6(ops.roi("schedule_cost", "cost"), "roi"))


_AUC = """SELECT {by}round(sum(p.pos * n.neg * CASE WHEN p.score > n.score THEN 1.0::DOUBLE
    WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END) / (sum(p.pos * n.neg)), 6) AS roc_auc
FROM counted p JOIN counted n ON {match}{group}"""


@query(
    "roc_auc",
    with_(SCORED, "counted AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1)")
    + _AUC.format(by="", match="true", group=""),
)
def _roc_auc(spark, sf):
    return ranking.roc_auc(views.scored(spark, sf), "y", "score").select(r6("roc_auc"))


@query(
    "roc_auc_fleet",
    with_(
        SCORED,
        "counted AS (SELECT device, score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1, 2)",
    )
    + _AUC.format(by="p.device, ", match="p.device = n.device", group=" GROUP BY p.device").replace(
        "(sum(p.pos * n.neg))", "nullif(sum(p.pos * n.neg), 0)"
    ),
)
def _roc_auc_fleet(spark, sf):
    out = ranking.roc_auc(views.scored(spark, sf), "y", "score", ["device"])
    return out.select("device", r6("roc_auc"))


@query(
    "average_precision",
    with_(SCORED)
    + """SELECT round(sum(pos * prec) / sum(pos), 6) AS pr_auc FROM (
  SELECT score, pos, sum(pos) OVER w / (sum(n) OVER w)::DOUBLE AS prec FROM (
    SELECT score, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1) g WINDOW w AS (ORDER BY score DESC)) t""",
)
def _average_precision(spark, sf):
    return ranking.average_precision(views.scored(spark, sf), "y", "score").select(r6("pr_auc"))


@query(
    "mean_rank",
    """SELECT DISTINCT round(value, 6) AS score, count(*) OVER (PARTITION BY value) AS n,
  round(rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE, 6) AS mean_rank
FROM events""",
)
def _mean_rank(spark, sf):
    out = mean_rank(views.scored(spark, sf), "score")
    return out.select(r6("score"), "n", r6("mean_rank"))


@query(
    "ecdf",
    """SELECT DISTINCT event_type, round(value, 6) AS value,
  round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 6) AS ecdf FROM events""",
)
def _ecdf(spark, sf):
    out = ecdf(views.table(spark, sf, "events"), "value", ["event_type"])
    return out.select("event_type", r6("value"), r6("ecdf"))


@query(
    "class_weights",
    with_(SCORED)
    + """SELECT round(n / greatest(p, 1)::DOUBLE, 6) AS pos_weight, round((n + p) / (2.0::DOUBLE * p), 6) AS weight_pos,
  round((n + p) / (2.0::DOUBLE * n), 6) AS weight_neg FROM (SELECT sum(y) AS p, sum(1 - y) AS n FROM scored) t""",
)
def _class_weights(spark, sf):
    out = ranking.class_weights(views.scored(spark, sf), "y")
    return out.select(r6("pos_weight"), r6("weight_pos"), r6("weight_neg"))


@query(
    "backfill_performance",
    with_(
        TELE,
        DEVICE_REPORTS,
        """labelled AS (SELECT a1 AS score, CASE WHEN EXISTS (SELECT 1 FROM device_reports r WHERE r.device = t.device
    AND t.ts >= r.s - INTERVAL 2 HOUR AND t.ts <= r.e) THEN 1 ELSE 0 END AS y FROM tele t)""",
        "counted AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM labelled GROUP BY 1)",
    )
    + f"""SELECT n, (tp + fn)::BIGINT AS n_positives, {_BIGS}, {_PR},
  (SELECT roc_auc FROM ({_AUC.format(by='', match='true', group='')}) a) AS roc_auc
FROM (SELECT count(*) AS n, {_COUNTS.format(t=100)} FROM labelled) t""",
)
def _backfill_performance(spark, sf):
    out = ranking.backfill_performance(
        views.tele(spark, sf),
        views.device_reports(spark, sf),
        100.0,
        score="a1",
        keys=["device"],
    )
    return out.select(
        "n", "n_positives", "tp", "fp", "fn", "tn", r6("precision"), r6("recall"), r6("roc_auc")
    )


@query(
    "daily_alert_cost",
    with_(
        TELE,
        TILES,
        REPORTS,
        """limits AS (SELECT quantile_cont(a1_max, 0.99) AS t FROM tiles WHERE ws < (SELECT min(s) FROM reports))""",
        """judged AS (SELECT strftime(ws, '%Y-%m-%d') AS day, a1_max AS score, t,
  CASE WHEN EXISTS (SELECT 1 FROM reports r WHERE ws >= r.s - INTERVAL 2 HOUR AND ws <= r.e) THEN 1 ELSE 0 END AS y
  FROM tiles, limits)""",
    )
    + f"""SELECT day, {_BIGS}, {_PR}, (fn * 3000.0 + fp * 200.0 + tp * 200.0)::DOUBLE AS cost, round(t, 6) AS threshold
FROM (SELECT day, max(t) AS t, {_COUNTS.format(t='t')} FROM judged GROUP BY 1) x""",
)
def _daily_alert_cost(spark, sf):
    out = flagship(spark, sf)
    return out.select(
        "day", "tp", "fp", "fn", "tn", r6("precision"), r6("recall"), "cost", r6("threshold")
    )
