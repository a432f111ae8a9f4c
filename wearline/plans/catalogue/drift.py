"""Drift between the two halves of the month."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline.operators import drift as ops
from wearline.plans import views
from wearline.plans.catalogue.base import TELE, query, r6, with_

_FEATURES = ["a1", "a2", "d1"]


def _long(rows: str = "true") -> str:
    return f"""long AS (
  SELECT f.feature, CASE f.feature WHEN 'a1' THEN a1 WHEN 'a2' THEN a2 ELSE d1 END AS value,
         ts < TIMESTAMP '{views.CURRENT_FROM}' AS is_ref
  FROM tele, (VALUES ('a1'), ('a2'), ('d1')) f(feature) WHERE {rows})"""


_LONG = _long()
_SIZES = """sizes AS (SELECT feature, sum(CASE WHEN is_ref THEN 1 ELSE 0 END) AS n_ref,
  sum(CASE WHEN is_ref THEN 0 ELSE 1 END) AS n_cur FROM long GROUP BY 1)"""
_EDGES = "edges AS (" + "\nUNION ".join(
    f"SELECT feature, quantile_cont(value, {i / 10}) AS edge FROM long WHERE is_ref GROUP BY 1"
    for i in range(11)
) + ")"
_INNER = """inner_edges AS (SELECT e.feature, e.edge FROM edges e JOIN (
  SELECT feature, min(edge) AS lo, max(edge) AS hi FROM edges GROUP BY 1) b ON b.feature = e.feature
  WHERE e.edge > b.lo AND e.edge < b.hi)"""
_BINNED = """binned AS (SELECT feature, is_ref, bin, count(*) AS n FROM (
  SELECT l.feature, l.is_ref, (SELECT count(*) FROM inner_edges i WHERE i.feature = l.feature AND i.edge <= l.value) AS bin
  FROM long l) t GROUP BY 1, 2, 3)"""
_PSI = """psis AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM (
  SELECT g.feature, greatest(sum(CASE WHEN is_ref THEN n ELSE 0 END) / max(s.n_ref)::DOUBLE, 1e-6::DOUBLE) AS r,
         greatest(sum(CASE WHEN is_ref THEN 0 ELSE n END) / max(s.n_cur)::DOUBLE, 1e-6::DOUBLE) AS c
  FROM binned g JOIN sizes s ON s.feature = g.feature GROUP BY g.feature, g.bin) t GROUP BY feature)"""
_PSI_CTES = (_EDGES, _INNER, _BINNED, _PSI)
_KS = """dists AS (SELECT feature, max(abs(r - c)) AS d, max(n_ref) AS n, max(n_cur) AS m FROM (
  SELECT g.feature, s.n_ref, s.n_cur,
    sum(ref) OVER (PARTITION BY g.feature ORDER BY value) / s.n_ref::DOUBLE AS r,
    sum(cur) OVER (PARTITION BY g.feature ORDER BY value) / s.n_cur::DOUBLE AS c
  FROM (SELECT feature, value, sum(CASE WHEN is_ref THEN 1 ELSE 0 END) AS ref,
               sum(CASE WHEN is_ref THEN 0 ELSE 1 END) AS cur FROM long GROUP BY 1, 2) g
  JOIN sizes s ON s.feature = g.feature) t GROUP BY feature),
args AS (SELECT feature, d, sqrt(en) * d + 1 / (6 * sqrt(en)) + (sqrt(en) * d - 1) / (4 * en) AS x
  FROM (SELECT *, n * m::DOUBLE / (n + m) AS en FROM dists) t),
kss AS (SELECT feature, max(d) AS ks_distance, CASE WHEN max(x) < 0.2 THEN 1.0::DOUBLE ELSE
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, sum(CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END * exp(-2.0 * k * k * x * x)))) END AS ks_pvalue
  FROM args, range(1, 101) r(k) GROUP BY feature)"""
_VERDICT = """verdicts AS (SELECT p.feature, psi, ks_distance, ks_pvalue, psi > 0.2 OR ks_pvalue < 0.05 AS drifted
  FROM psis p JOIN kss k ON k.feature = p.feature)"""
_ALL = (TELE, _LONG, _SIZES, *_PSI_CTES, _KS, _VERDICT)


def _features(spark, sf):
    reference, current = views.samples(spark, sf)
    return ops.feature_drift(reference, current, _FEATURES, method="series")


@query("psi", with_(TELE, _LONG, _SIZES, *_PSI_CTES) + "SELECT feature, round(psi, 6) AS psi FROM psis")
def _psi(spark, sf):
    reference, current = views.samples(spark, sf)
    return ops.psi(reference, current, _FEATURES).select("feature", r6("psi"))


@query(
    "ks_2samp",
    with_(TELE, _LONG, _SIZES, _KS)
    + "SELECT feature, round(ks_distance, 6) AS ks_distance, round(ks_pvalue, 6) AS ks_pvalue FROM kss",
)
def _ks_2samp(spark, sf):
    reference, current = views.samples(spark, sf)
    out = ops.ks_2samp(reference, current, _FEATURES, method="series")
    return out.select("feature", r6("ks_distance"), r6("ks_pvalue"))


@query("ks_2samp_exact")
def _ks_2samp_exact(spark, sf):
    reference, current = views.samples(spark, sf)
    out = ops.ks_2samp(reference, current, _FEATURES, method="exact")
    return out.select("feature", r6("ks_distance"), r6("ks_pvalue"))


@query(
    "feature_drift",
    with_(*_ALL)
    + "SELECT feature, round(psi, 6) AS psi, round(ks_pvalue, 6) AS ks_pvalue, drifted FROM verdicts",
)
def _feature_drift(spark, sf):
    return _features(spark, sf).select("feature", r6("psi"), r6("ks_pvalue"), "drifted")


def verdict_sql(rows: str, tele: str = TELE) -> str:
    """The verdict over the long rows that meet a condition."""
    return with_(tele, _long(rows), _SIZES, *_PSI_CTES, _KS, _VERDICT, _ROLLED) + (
        "SELECT drift_detected, n_drifted FROM rolled"
    )


_ROLLED = """rolled AS (SELECT coalesce(bool_or(drifted), false) AS drift_detected,
  count(CASE WHEN drifted THEN 1 END) AS n_drifted,
  coalesce(string_agg(CASE WHEN drifted THEN feature END, ', ' ORDER BY feature), '') AS drifted_features FROM verdicts)"""


@query("drift_verdict", with_(*_ALL, _ROLLED) + "SELECT * FROM rolled")
def _drift_verdict(spark, sf):
    out = ops.drift_verdict(_features(spark, sf))
    return out.withColumn("drifted_features", F.array_join("drifted_features", ", "))


@query(
    "retrain_decision",
    with_(*_ALL, _ROLLED)
    + """SELECT drift_detected AS retrain, CASE WHEN drift_detected THEN 'moved: ' || drifted_features
  ELSE 'no drift found' END AS reason FROM rolled""",
)
def _retrain_decision(spark, sf):
    return ops.decide_retrain(ops.drift_verdict(_features(spark, sf)))


@query(
    "pair_by_feature",
    with_(TELE, _LONG)
    + "SELECT feature, is_ref, count(*) AS n, round(sum(value), 4) AS total FROM long GROUP BY 1, 2",
)
def _pair_by_feature(spark, sf):
    reference, current = views.samples(spark, sf)
    rows = ops.pair_by_feature(reference, current, _FEATURES)
    return rows.groupBy("feature", "is_ref").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")
    )
