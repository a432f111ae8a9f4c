"""Fitted models. Forests are refitted in SQL; other fits have rows only, priced by SQL in tests."""

from __future__ import annotations

from functools import partial


from wearline.operators import splits
from wearline.operators.iforest import score_iforest
from wearline.operators.labels import interval_labels, mark_healthy
from wearline.operators.supervised import fit_forest, fit_gbt
from wearline.operators.tiles import window_features
from wearline.plans import crossval, detector, fleet, views
from wearline.plans.catalogue import forest_sql
from wearline.plans.catalogue.base import (
    DEVICE_REPORTS,
    FEATURES,
    ORACLES,
    REPORTS,
    STATS,
    TELE,
    TILES,
    clock,
    query,
    r6,
    sql_clock,
    with_,
)
from wearline.plans.catalogue.features import lead_sql
from wearline.plans.catalogue.streams import CLOSED, replay
from wearline.session import scratch_path
from wearline.sources.models import ModelStore
from wearline.streaming import jobs


_X = "[" + ", ".join(f"coalesce({f}, 0)::DOUBLE" for f in FEATURES) + "]"
_FIRST = "(SELECT min(s) FROM reports)"


def _label(rows: str, reports: str, hours: int, match: str = "true") -> str:
    return f"""(EXISTS (SELECT 1 FROM {reports} r WHERE {match} AND {rows} >= r.s - INTERVAL {hours} HOUR
    AND {rows} <= r.e AND r.e >= r.s OR {match} AND {rows} >= r.s - INTERVAL {hours} HOUR AND {rows} < r.s))::INTEGER"""


_MARKED = f"""marked AS MATERIALIZED (SELECT ws AS id, epoch_us(ws) AS ident, {_X} AS x, ws < {_FIRST} AS healthy,
  {_label('ws', 'reports', 2)} AS y FROM tiles)"""
_SITE = (TELE, TILES, REPORTS, _MARKED, *forest_sql.forest_ctes(len(FEATURES)), forest_sql.raw_scores(), forest_sql.OFFSET)
_LIMIT = "(SELECT quantile_cont(score, 0.99) FROM scored WHERE healthy)"
_EVAL = f"""SELECT (SELECT count(*) FROM scored WHERE healthy) AS train_windows, rows AS test_windows,
  coalesce(positives, 0)::BIGINT AS test_positives, roc_auc, pr_auc, round(coalesce(tp / nullif(positives, 0)::DOUBLE, 0), 6) AS recall,
  round(coalesce(tp / nullif(alerts, 0)::DOUBLE, 0), 6) AS precision, round({_LIMIT}, 6) AS threshold
FROM {forest_sql.metrics('scored WHERE NOT healthy', _LIMIT)} m"""


def _site(spark, sf):
    return detector.evaluate_detector(views.tiles(spark, sf), views.reports(spark), FEATURES)


def _evaluated(report):
    counts = ["train_windows", "test_windows", "test_positives"]
    return report.metrics.select(*counts, *map(r6, ("roc_auc", "pr_auc", "recall", "precision", "threshold")))


@query(
    "iforest_scores",
    with_(*_SITE) + f"SELECT {sql_clock('id')} AS window_start, healthy, round(score, 6) AS score FROM scored",
)
def _iforest_scores(spark, sf):
    return _site(spark, sf).scored.select(clock("window_start", "window_start"), "healthy", r6("score"))


@query("iforest_eval", with_(*_SITE) + _EVAL)
def _iforest_eval(spark, sf):
    return _evaluated(_site(spark, sf))


@query(
    "iforest_lead_times",
    with_(*_SITE, f"hits AS (SELECT id AS ts FROM scored WHERE score >= {_LIMIT})") + lead_sql("reports", "", "true"),
)
def _iforest_lead_times(spark, sf):
    found = _site(spark, sf).lead_times
    return found.select(clock("start", "start"), clock("end", "end"), r6("lead_hours"), "flagged_during")


_SIZES = (300, 100, 50)


def _sweep_sql(n: int) -> str:
    limit = f"(SELECT quantile_cont(score, 0.99) FROM raw{n} JOIN marked USING (id) WHERE healthy)"
    rows = f"(SELECT y, score FROM raw{n} JOIN marked USING (id) WHERE NOT healthy) z"
    return f"""SELECT {n}::BIGINT AS trees, roc_auc, pr_auc, round(coalesce(tp / nullif(positives, 0)::DOUBLE, 0), 6) AS recall
FROM {forest_sql.metrics(rows, limit)} m{n} WHERE rows > 0"""


@query(
    "ensemble_sweep",
    with_(*_SITE[:-2], *[forest_sql.raw_scores(f"raw{n}", n) for n in _SIZES])
    + "\nUNION ALL ".join(_sweep_sql(n) for n in _SIZES),
)
def _ensemble_sweep(spark, sf):
    found = detector.ensemble_sweep(views.tiles(spark, sf), views.reports(spark), FEATURES, sizes=_SIZES)
    return found.select("trees", *map(r6, ("roc_auc", "pr_auc", "recall")))


@query("fleet_risk")
def _fleet_risk(spark, sf):
    return fleet.fleet_risk(views.life(spark, sf), reference="1998-01-01")


def _cv_rows(spark, sf):
    tiles = views.tiles(spark, sf, min_rows=1)
    return interval_labels(tiles, views.reports(spark), name="y")


_CV = {"embargo": splits.embargo_rows(2.0, 1.0), "windows_per_day": 24.0}


@query("temporal_cv")
def _temporal_cv(spark, sf):
    fit = partial(fit_forest, features=FEATURES)
    return crossval.temporal_cv(
        _cv_rows(spark, sf), FEATURES, ["window_start"], fit, model="random_forest", **_CV
    )


@query("temporal_cv_boosted")
def _temporal_cv_boosted(spark, sf):
    """300 rounds of depth 6 per fold."""
    fit = partial(fit_gbt, features=FEATURES)
    return crossval.temporal_cv(
        _cv_rows(spark, sf), FEATURES, ["window_start"], fit, model="boosted", **_CV
    )


@query("temporal_cv_sequences")
def _temporal_cv_sequences(spark, sf):
    """Six windows stacked, layers of 64 and 32 units, stopped early on a tail of the training side."""
    return crossval.sequence_cv(_cv_rows(spark, sf), FEATURES, ["window_start"], k=6, **_CV)


@query("iforest_stored", ORACLES["iforest_scores"])
def _iforest_stored(spark, sf):
    """The detector saved as a version, loaded again and used on all tiles."""
    store = ModelStore(spark, scratch_path(spark, "models"))
    version = store.save(_site(spark, sf).forest)
    marked = mark_healthy(views.tiles(spark, sf), views.reports(spark))
    scored = score_iforest(marked, store.load(version))
    return scored.select(clock("window_start", "window_start"), "healthy", r6("score"))


@query(
    "stream_score",
    with_(*_SITE)
    + f"""SELECT {sql_clock('id')} AS window_start, round(score, 6) AS anomaly_score, score >= {_LIMIT} AS alert
FROM scored WHERE {CLOSED.replace('w +', 'id +')}""",
)
def _stream_score(spark, sf):
    """Closed tiles scored as they come, by a stored forest."""
    store = ModelStore(spark, scratch_path(spark, "models"))
    forest = store.load(store.save(_site(spark, sf).forest))
    base = scratch_path(spark, "scores")

    def run(stream):
        made = jobs.stream_score(jobs.stream_features(stream, views.SIGNALS, width="1 hour"), forest)
        jobs.run_available(made, f"{base}/out", f"{base}/checkpoint")

    replay(spark, views.arrivals(spark, sf), base, run)
    rows = spark.read.parquet(f"{base}/out")
    return rows.select(clock("window_start", "window_start"), r6("anomaly_score"), "alert")


_FLEET = (
    TELE,
    DEVICE_REPORTS,
    f"""days AS (SELECT device, date_trunc('day', ts) AS ws, {STATS} FROM tele GROUP BY 1, 2)""",
    f"""marked AS MATERIALIZED (SELECT device || ':' || epoch_us(ws) AS id, device || ':' || epoch_us(ws) AS ident, {_X} AS x,
  coalesce(ws < (SELECT min(s) FROM device_reports r WHERE r.device = days.device), true) AS healthy,
  {_label('days.ws', 'device_reports', 24, 'r.device = days.device')} AS y FROM days)""",
    *forest_sql.forest_ctes(len(FEATURES)),
    forest_sql.raw_scores(),
    forest_sql.OFFSET,
)


@query("iforest_fleet", with_(*_FLEET) + _EVAL)
def _iforest_fleet(spark, sf):
    """One detector for all devices, healthy until each device's own first report."""
    tiles = window_features(
        views.tele(spark, sf), views.SIGNALS, width="1 day", min_rows=1, keys=["device"]
    )
    return _evaluated(
        detector.evaluate_detector(
            tiles, views.device_reports(spark, sf), FEATURES, keys=["device"], warn_hours=24.0
        )
    )
