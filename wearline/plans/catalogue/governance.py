"""Gates, promotion, stages, audit replay, run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline.operators import governance as ops, ranking
from wearline.plans import views
from wearline.plans.catalogue.base import AUDIT, SCORED, TELE, query, r6, with_
from wearline.plans.catalogue.drift import verdict_sql
from wearline.plans.retrain import Registry, retrain_if_drift
from wearline.session import scratch_path
from wearline.sources import sinks

_METRICS = """best AS (SELECT 'm' || (o_custkey % 50) AS model, CAST(floor(o_totalprice) AS BIGINT) % 40 AS no,
    max(o_totalprice) / 500000.0::DOUBLE AS level FROM orders GROUP BY 1, 2),
metrics AS (SELECT model, 'v' || no AS version, n.name, 0.5::DOUBLE + 0.5::DOUBLE * level * (1.0::DOUBLE - 0.1::DOUBLE * n.i) AS value
  FROM best, (VALUES ('roc_auc', 0), ('pr_auc', 1), ('recall', 2)) n(name, i) WHERE (no + n.i) % 11 <> 0)"""

_GATES = """gates(name, low, pos) AS (VALUES ('roc_auc', 0.9::DOUBLE, 0), ('pr_auc', 0.3::DOUBLE, 1), ('recall', 0.75::DOUBLE, 2)),
missed AS (SELECT r.model, r.version, g.pos, CASE WHEN m.value IS NULL THEN g.name || ': missing from metrics'
    ELSE printf('%s=%.3f < required %s', g.name, m.value, g.low::VARCHAR) END AS text
  FROM (SELECT DISTINCT model, version FROM metrics) r CROSS JOIN gates g
  LEFT JOIN metrics m ON m.model = r.model AND m.version = r.version AND m.name = g.name
  WHERE m.value IS NULL OR m.value < g.low)"""


@query(
    "gates",
    with_(_METRICS, _GATES)
    + """SELECT r.model, r.version, count(m.text) = 0 AS passed, coalesce(string_agg(m.text, '; ' ORDER BY m.pos), '') AS failures
FROM (SELECT DISTINCT model, version FROM metrics) r LEFT JOIN missed m ON m.model = r.model AND m.version = r.version
GROUP BY 1, 2""",
)
def _gates(spark, sf):
    out = ops.check_gates(views.model_metrics(spark, sf), ["model", "version"])
    return out.withColumn("failures", F.array_join("failures", "; "))


_LIVE = """live AS (SELECT model, max(value) AS prod FROM metrics WHERE name = 'roc_auc' AND version = 'v7' GROUP BY 1),
present AS (SELECT DISTINCT model FROM metrics WHERE version = 'v7')"""


@query(
    "promotion",
    with_(_METRICS, _GATES, _LIVE)
    + """SELECT model, version, CASE WHEN gated THEN false WHEN no_prod THEN true WHEN cand IS NULL OR prod IS NULL THEN false
    ELSE cand >= prod - 0.01::DOUBLE END AS promote,
  CASE WHEN gated THEN 'a gate was missed' WHEN no_prod THEN 'no production version to compare with'
    WHEN cand IS NULL OR prod IS NULL THEN 'roc_auc is missing on one side'
    WHEN cand >= prod - 0.01::DOUBLE THEN printf('roc_auc %.3f holds against %.3f, 0.01 allowed', cand, prod)
    ELSE printf('roc_auc would regress from %.3f to %.3f', prod, cand) END AS reason
FROM (SELECT r.model, r.version, c.value AS cand, l.prod, p.model IS NULL AS no_prod,
    EXISTS (SELECT 1 FROM missed m WHERE m.model = r.model AND m.version = r.version) AS gated
  FROM (SELECT DISTINCT model, version FROM metrics) r
  LEFT JOIN metrics c ON c.model = r.model AND c.version = r.version AND c.name = 'roc_auc'
  LEFT JOIN live l ON l.model = r.model LEFT JOIN present p ON p.model = r.model) t""",
)
def _promotion(spark, sf):
    metrics = views.model_metrics(spark, sf)
    production = metrics.where(F.col("version") == "v7").drop("version")
    out = ops.promotion_decision(metrics, production)
    return out.select("model", "version", "promote", "reason")


# The log replayed one entry after another, with the history as a list.
_REPLAY = """numbered AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY seq) AS i FROM audit),
state AS (
  SELECT model, 0::BIGINT AS i, []::VARCHAR[] AS hist, []::VARCHAR[] AS known, NULL::VARCHAR AS candidate,
    0::BIGINT AS nv, 0::BIGINT AS np, 0::BIGINT AS nb, 0::BIGINT AS bad FROM (SELECT DISTINCT model FROM audit) m
  UNION ALL
  SELECT s.model, a.i,
    CASE WHEN a.action = 'promote' AND list_contains(known, a.version) THEN list_append(hist, a.version)
         WHEN a.action = 'rollback' AND len(hist) >= 2 THEN hist[1:len(hist) - 1] ELSE hist END,
    CASE WHEN a.action = 'register' AND NOT list_contains(known, a.version) THEN list_append(known, a.version) ELSE known END,
    CASE WHEN a.action = 'register' AND NOT list_contains(known, a.version) THEN a.version ELSE candidate END,
    nv + CASE WHEN a.action = 'register' AND NOT list_contains(known, a.version) THEN 1 ELSE 0 END,
    np + CASE WHEN a.action = 'promote' AND list_contains(known, a.version) THEN 1 ELSE 0 END,
    nb + CASE WHEN a.action = 'rollback' AND len(hist) >= 2 THEN 1 ELSE 0 END,
    bad + CASE WHEN (a.action = 'register' AND list_contains(known, a.version))
                 OR (a.action = 'promote' AND NOT list_contains(known, a.version))
                 OR (a.action = 'rollback' AND len(hist) < 2) THEN 1 ELSE 0 END
  FROM state s JOIN numbered a ON a.model = s.model AND a.i = s.i + 1),
final AS (SELECT s.model, hist[len(hist)] AS production, candidate, nv AS n_versions, np AS n_promotions,
    nb AS n_rollbacks, bad AS n_invalid
  FROM state s JOIN (SELECT model, max(i) AS i FROM numbered GROUP BY 1) l ON l.model = s.model AND l.i = s.i)"""
_RECURSIVE = with_(AUDIT, _REPLAY).replace("WITH", "WITH RECURSIVE", 1)
_OVERRIDES = """overrides AS (SELECT model, stage, arg_max(threshold, seq) AS override FROM audit
  WHERE action = 'set_threshold' GROUP BY 1, 2)"""


@query("audit_replay", _RECURSIVE + "SELECT * FROM final")
def _audit_replay(spark, sf):
    return ops.replay_audit(views.audit(spark, sf))


_STAGES = f"""{_OVERRIDES},
staged AS (SELECT f.model, s.stage, CASE s.stage WHEN 'production' THEN production ELSE candidate END AS version
  FROM final f, (VALUES ('production'), ('candidate')) s(stage))"""


@query(
    "stage_lookup",
    with_(AUDIT, _REPLAY, _STAGES, _METRICS).replace("WITH", "WITH RECURSIVE", 1)
    + """SELECT s.model, s.stage, s.version, round(max(CASE WHEN m.name = 'recall' THEN m.value END), 6) AS recall,
  round(max(o.override), 6) AS threshold_override
FROM staged s LEFT JOIN metrics m ON m.model = s.model AND m.version = s.version
LEFT JOIN overrides o ON o.model = s.model AND o.stage = s.stage GROUP BY 1, 2, 3""",
)
def _stage_lookup(spark, sf):
    audit = views.audit(spark, sf)
    out = ops.stage_lookup(
        ops.replay_audit(audit), views.model_metrics(spark, sf), ops.stage_overrides(audit)
    )
    return out.select(
        "model", "stage", "version", r6(F.col("metrics")["recall"], "recall"), r6("threshold_override")
    )


@query(
    "effective_threshold",
    with_(AUDIT, _REPLAY, _STAGES, _METRICS).replace("WITH", "WITH RECURSIVE", 1)
    + """SELECT s.model, s.version, round(coalesce(o.override, b.threshold), 6) AS threshold
FROM staged s JOIN (SELECT model, version, max(value) AS threshold FROM metrics GROUP BY 1, 2) b
  ON b.model = s.model AND b.version = s.version
LEFT JOIN overrides o ON o.model = s.model AND o.stage = s.stage WHERE s.stage = 'production'""",
)
def _effective_threshold(spark, sf):
    audit = views.audit(spark, sf)
    bundles = (
        views.model_metrics(spark, sf).groupBy("model", "version").agg(F.max("value").alias("threshold"))
    )
    out = ops.effective_threshold(ops.replay_audit(audit), bundles, ops.stage_overrides(audit))
    return out.select("model", "version", r6("threshold"))


@query(
    "status_report",
    with_(AUDIT, _REPLAY, _STAGES, _METRICS).replace("WITH", "WITH RECURSIVE", 1)
    + """SELECT f.model, f.production, f.candidate,
  round((SELECT max(value) FROM metrics m WHERE m.model = f.model AND m.version = f.production AND m.name = 'roc_auc'), 6) AS production_auc,
  round((SELECT max(override) FROM overrides o WHERE o.model = f.model AND o.stage = 'production'), 6) AS production_threshold,
  f.n_versions, f.n_promotions, f.n_rollbacks FROM final f""",
)
def _status_report(spark, sf):
    out = ops.status_report(views.audit(spark, sf), views.model_metrics(spark, sf))
    return out.select(
        "model",
        F.col("production.version").alias("production"),
        F.col("candidate.version").alias("candidate"),
        r6(F.col("production.metrics")["roc_auc"], "production_auc"),
        r6("production.threshold_override", "production_threshold"),
        "n_versions",
        "n_promotions",
        "n_rollbacks",
    )


@query(
    "status_recent",
    with_(AUDIT)
    + """SELECT model, seq, action, version FROM audit
QUALIFY row_number() OVER (PARTITION BY model ORDER BY seq DESC) <= 5""",
)
def _status_recent(spark, sf):
    out = ops.status_report(views.audit(spark, sf), views.model_metrics(spark, sf))
    return out.select("model", F.inline("recent"))


_MOVED = TELE.replace("value AS a1", f"CASE WHEN ts >= TIMESTAMP '{views.CURRENT_FROM}' THEN value + 60 ELSE value END AS a1")
_HALVES = f"""halves AS (SELECT ts < TIMESTAMP '{views.CURRENT_FROM}' AS early, score, sum(y) AS pos, sum(1 - y) AS neg
  FROM scored GROUP BY 1, 2),
aucs AS (SELECT p.early, sum(p.pos * n.neg * CASE WHEN p.score > n.score THEN 1.0::DOUBLE
    WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END) / nullif(sum(p.pos * n.neg), 0) AS auc
  FROM halves p JOIN halves n ON n.early = p.early GROUP BY 1),
found AS (SELECT (SELECT auc FROM aucs WHERE early) AS a, (SELECT auc FROM aucs WHERE NOT early) AS b,
  (SELECT drift_detected FROM ({verdict_sql("f.feature <> 'd1'", _MOVED)}) v) AS moved)"""


@query(
    "retrain_audit",
    with_(SCORED, _HALVES)
    + """SELECT row_number() OVER (ORDER BY i) - 1 AS seq, action, version, "at" FROM (
  SELECT 0 AS i, 'register' AS action, 'v1' AS version, 't1' AS "at" FROM found WHERE moved
  UNION ALL SELECT 1, 'promote', 'v1', 't1' FROM found WHERE moved AND a >= 0.4
  UNION ALL SELECT 2, 'register', 'v2', 't2' FROM found WHERE moved
  UNION ALL SELECT 3, 'promote', 'v2', 't2' FROM found WHERE moved AND b >= 0.4 AND (NOT a >= 0.4 OR b >= a - 0.01)) t""",
)
def _retrain_audit(spark, sf):
    """Without drift nothing is built; with drift a candidate of each half is judged and recorded."""
    registry = Registry(spark, scratch_path(spark, "registry"))
    registry.create()
    reference, current = views.samples(spark, sf)
    moved = current.withColumn("a1", F.col("a1") + 60)
    rows = views.scored(spark, sf)
    early = F.col("ts") < F.to_timestamp(F.lit(views.CURRENT_FROM))

    def candidate(version, side):
        return lambda: (version, {"roc_auc": ranking.roc_auc(rows.where(side), "y", "score").first()["roc_auc"]})

    loops = [(reference, "v0", early, "t0"), (moved, "v1", early, "t1"), (moved, "v2", ~early, "t2")]
    for sample, version, side, at in loops:
        retrain_if_drift(
            reference, sample, ["a1", "a2"], registry, "m", candidate(version, side), at, gates={"roc_auc": 0.4}
        )
    return registry.audit().select("seq", "action", "version", "at")


@query(
    "audit_counts",
    with_(AUDIT)
    + """SELECT model, count(DISTINCT CASE WHEN action = 'register' THEN version END) AS n_versions,
  count(CASE WHEN action = 'promote' THEN 1 END) AS n_promotions,
  count(CASE WHEN action = 'rollback' THEN 1 END) AS n_rollbacks FROM audit GROUP BY 1""",
)
def _audit_counts(spark, sf):
    return ops.audit_counts(views.audit(spark, sf))


@query(
    "latest_entries",
    with_(AUDIT) + "SELECT seq, model, action, version FROM audit ORDER BY seq DESC LIMIT 5",
)
def _latest_entries(spark, sf):
    return ops.latest_entries(views.audit(spark, sf), 5).select("seq", "model", "action", "version")


_LOGGED = """daily AS (SELECT device % 7 AS grp, strftime(ts, '%j')::BIGINT AS step,
    avg(score) AS mean_score, avg(y)::DOUBLE AS rate FROM scored GROUP BY 1, 2)"""


def _log(spark, sf):
    rows = views.scored(spark, sf).groupBy(
        F.pmod("device", F.lit(7)).alias("grp"), F.dayofyear("ts").cast("long").alias("step")
    )
    daily = rows.agg(F.avg("score").alias("mean_score"), F.avg("y").alias("rate"))
    return sinks.run_log(daily, ["mean_score", "rate"], by=["grp"], step="step", params={"freq": "1d"})


@query(
    "run_log_means",
    with_(SCORED, _LOGGED)
    + """SELECT grp::VARCHAR AS run, 'mean_score' AS name, round(avg(mean_score), 6) AS mean, count(*) AS steps FROM daily GROUP BY 1
UNION ALL SELECT grp::VARCHAR, 'rate', round(avg(rate), 6), count(*) FROM daily GROUP BY 1""",
)
def _run_log_means(spark, sf):
    """Written to the shared folder and read back."""
    path = scratch_path(spark, "runs")
    _log(spark, sf).write.mode("append").parquet(path)
    out = sinks.log_means(spark.read.parquet(path))
    return out.select("run", "name", r6("mean"), "steps")


@query(
    "leaderboard",
    with_(SCORED, _LOGGED)
    + """SELECT grp::VARCHAR AS run, round(avg(rate), 6) AS mean, row_number() OVER (ORDER BY round(avg(rate), 9) DESC, grp) AS place
FROM daily GROUP BY 1, grp""",
)
def _leaderboard(spark, sf):
    board = sinks.leaderboard(_log(spark, sf), "rate")
    # One row per run; ranks by joining nothing, from the ordered board.
    ranked = board.select("run", "mean").withColumn("_m", F.round("mean", 9))
    from wearline.operators.ordered import row_index

    down = ranked.withColumn("_down", -F.col("_m"))
    out = row_index(down, ["_down", "run"], name="_at")
    return out.select("run", r6("mean"), (F.col("_at") + 1).alias("place"))


@query(
    "fold_means",
    with_(SCORED, _LOGGED)
    + "SELECT grp AS model, round(avg(mean_score), 6) AS mean_score, round(avg(rate), 6) AS rate, count(*) AS scorable_folds FROM daily GROUP BY 1",
)
def _fold_means(spark, sf):
    rows = views.scored(spark, sf).groupBy(
        F.pmod("device", F.lit(7)).alias("model"), F.dayofyear("ts").alias("fold")
    )
    daily = rows.agg(F.avg("score").alias("mean_score"), F.avg("y").alias("rate"))
    out = ranking.fold_means(daily, ["mean_score", "rate"])
    return out.select("model", r6("mean_score"), r6("rate"), "scorable_folds")
