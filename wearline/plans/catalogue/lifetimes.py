"""Unit lifetimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline.operators import lifetimes as ops
from wearline.plans import marts, views
from wearline.plans.catalogue.base import LIFE, REPORTS, TELE, TILES, big, query, r6, with_

_AT = "1998-01-01"

_RATES = """rates AS (
  SELECT model, count(*) AS units, sum(failed)::BIGINT AS failures,
    sum(greatest(floor((epoch_us(max_date) - epoch_us(min_date)) / 86400000000.0), 1) / 365.25::DOUBLE) AS unit_years
  FROM life GROUP BY 1 HAVING count(*) >= 100)"""
_RATE_COLUMNS = "model, units, failures, round(unit_years, 6) AS unit_years, round(failures / unit_years, 6) AS afr"

_COHORT = f"""cohort AS (
  SELECT capacity_tb, floor((epoch_us(TIMESTAMP '{_AT}') - epoch_us(min_date)) / 86400000000.0)::BIGINT AS age_days, model,
    CASE WHEN failed = 1 AND max_date <= TIMESTAMP '{_AT}' + INTERVAL 365 DAY THEN 1 ELSE 0 END AS y
  FROM life WHERE min_date <= TIMESTAMP '{_AT}' AND max_date >= TIMESTAMP '{_AT}'
    AND NOT (failed = 0 AND max_date <= TIMESTAMP '{_AT}' + INTERVAL 365 DAY))"""


def _rates(spark, sf):
    return ops.afr(views.life(spark, sf), min_units=100)


def _cohort(spark, sf):
    return ops.risk_cohort(views.life(spark, sf), reference=_AT)


def _shown(df):
    return df.select("model", "units", "failures", r6("unit_years"), r6("afr"))


@query("afr", with_(LIFE, _RATES) + f"SELECT {_RATE_COLUMNS} FROM rates")
def _afr(spark, sf):
    return _shown(_rates(spark, sf))


@query(
    "afr_worst",
    with_(LIFE, _RATES) + f"SELECT {_RATE_COLUMNS} FROM rates ORDER BY failures / unit_years DESC, model LIMIT 3",
)
def _afr_worst(spark, sf):
    return _shown(ops.worst(_rates(spark, sf), 3))


@query(
    "afr_best",
    with_(LIFE, _RATES) + f"SELECT {_RATE_COLUMNS} FROM rates ORDER BY failures / unit_years, model DESC LIMIT 3",
)
def _afr_best(spark, sf):
    return _shown(ops.best(_rates(spark, sf), 3))


@query("risk_cohort", with_(LIFE, _COHORT) + "SELECT capacity_tb, age_days, model, y::BIGINT AS y FROM cohort")
def _risk_cohort(spark, sf):
    return _cohort(spark, sf).select("capacity_tb", "age_days", "model", big("y"))


@query(
    "cohort_summary",
    with_(LIFE, _COHORT)
    + "SELECT count(*) AS n_units, sum(y)::BIGINT AS n_failures, round(avg(y), 6) AS failure_rate FROM cohort",
)
def _cohort_summary(spark, sf):
    return ops.cohort_summary(_cohort(spark, sf)).select("n_units", "n_failures", r6("failure_rate"))


_TRAIN = "age_days % 3 <> 0"
_PRIOR = f"""train AS (SELECT * FROM cohort WHERE {_TRAIN}),
overall AS (SELECT avg(y) AS rate FROM train),
prior AS (SELECT model, (sum(y) + 50.0::DOUBLE * (SELECT rate FROM overall)) / (count(*) + 50.0::DOUBLE) AS prior
  FROM train GROUP BY 1)"""


@query("rate_prior", with_(LIFE, _COHORT, _PRIOR) + "SELECT model, round(prior, 6) AS prior FROM prior")
def _rate_prior(spark, sf):
    train = _cohort(spark, sf).where(F.col("age_days") % 3 != 0)
    prior, _ = ops.rate_prior(train, "model", "y")
    return prior.select("model", r6("prior"))


@query(
    "target_encode",
    with_(LIFE, _COHORT, _PRIOR)
    + f"""SELECT c.model, c.age_days, c.capacity_tb,
  round(coalesce(p.prior, (SELECT rate FROM overall)), 6) AS encoded
FROM cohort c LEFT JOIN prior p ON p.model = c.model WHERE NOT ({_TRAIN})""",
)
def _target_encode(spark, sf):
    cohort = _cohort(spark, sf)
    train, test = cohort.where(F.col("age_days") % 3 != 0), cohort.where(F.col("age_days") % 3 == 0)
    out = ops.target_encode(train, test, "model", "y")
    return out.select("model", "age_days", "capacity_tb", r6("encoded"))


@query(
    "fleet_totals",
    with_(LIFE)
    + "SELECT count(*) AS units, sum(failed)::BIGINT AS failures, count(DISTINCT model) AS models FROM life",
)
def _fleet_totals(spark, sf):
    return ops.fleet_totals(views.life(spark, sf))


@query(
    "summary_struct",
    with_(TELE, TILES, REPORTS, LIFE, _COHORT)
    + """SELECT 0.25::DOUBLE AS anomaly_threshold, (SELECT count(*) FROM reports) AS failures,
  (SELECT count(*) FROM tiles) AS windows, (SELECT count(*) FROM life) AS units,
  (SELECT sum(failed)::BIGINT FROM life) AS unit_failures, (SELECT count(DISTINCT model) FROM life) AS models,
  (SELECT count(*) FROM cohort) AS cohort_units, (SELECT sum(y)::BIGINT FROM cohort) AS cohort_failures""",
)
def _summary_struct(spark, sf):
    out = marts.summary_struct(
        views.tiles(spark, sf), views.reports(spark), views.life(spark, sf), 0.25, reference=_AT
    )
    return out.select(
        "anomaly_threshold",
        "telemetry.failures",
        "telemetry.windows",
        "fleet.units",
        F.col("fleet.failures").alias("unit_failures"),
        "fleet.models",
        "fleet.cohort_units",
        "fleet.cohort_failures",
    )
