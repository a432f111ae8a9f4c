from datetime import datetime, timedelta

import numpy as np
import pytest

from wearline.functions.columns import alert
from wearline.operators import cost as c
from wearline.operators import ranking as r
from wearline.operators.labels import events_frame

MODEL = c.CostModel(1000, 10, 10)


def pairs(spark, y, score):
    rows = [(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, score))]
    return spark.createDataFrame(rows, "i long, y int, score double")


def test_cost_model_rules():
    with pytest.raises(ValueError):
        c.CostModel(10, -1)
    with pytest.raises(ValueError):
        c.CostModel(10, 10)


def test_confusion_cost(spark):
    df = pairs(spark, [1, 1, 0, 0], [1, 0, 1, 0])
    assert c.confusion_cost(df, "y", "score", MODEL).first()["cost"] == 1020
    assert c.confusion_cost(pairs(spark, [0, 0], [0, 0]), "y", "score", MODEL).first()["cost"] == 0


def test_sentinel_counts_as_failure_in_cost_only(spark):
    df = pairs(spark, [-1, 0], [0.9, 0.1])
    assert c.expected_cost(df, "y", "score", 0.95, MODEL).first()["cost"] == 1000
    assert c.confusion(df, "y", alert("score", 0.95)).first()["fn"] == 0


def test_expected_cost(spark):
    df = pairs(spark, [1, 0], [0.9, 0.4])
    assert c.expected_cost(df, "y", "score", 0.5, MODEL).first()["cost"] == 10
    assert c.expected_cost(df, "y", "score", 1.0, MODEL).first()["cost"] == 1000


def test_closed_threshold_and_nan(spark):
    df = pairs(spark, [1, 1], [0.5, float("nan")])
    row = c.confusion(df, "y", alert("score", 0.5)).first()
    assert (row["tp"], row["fn"]) == (1, 1)


def test_optimal_threshold(spark):
    df = pairs(spark, [1, 1, 0, 0, 0], [0.95, 0.8, 0.2, 0.1, 0.05])
    row = c.optimal_threshold(df, "y", "score", MODEL).first()
    assert (row["threshold"], row["cost"]) == (0.8, 20)
    with pytest.raises(ValueError):
        c.optimal_threshold(df.limit(0), "y", "score", MODEL)


def test_ties_prefer_the_highest_cutoff(spark):
    df = pairs(spark, [0, 0, 0], [0.3, 0.2, 0.1])
    assert c.optimal_threshold(df, "y", "score", MODEL).first()["threshold"] == 1.3


@pytest.mark.parametrize("size", (10**6, 13))
def test_curve_matches_the_direct_count(spark, size):
    rng = np.random.default_rng(3)
    score, y = np.round(rng.random(300), 2), rng.integers(0, 2, 300)
    df = pairs(spark, y, score)
    got = {x["threshold"]: x["cost"] for x in c.cost_curve(df, "y", "score", MODEL, rows_per_bucket=size).collect()}
    assert len(got) == len(set(score)) + 1
    for t, price in got.items():
        hit = score >= t
        want = 1000 * (~hit & (y == 1)).sum() + 10 * (hit & (y == 0)).sum() + 10 * (hit & (y == 1)).sum()
        assert price == want


def test_baselines(spark):
    row = c.baseline_costs(pairs(spark, [1, 0, 0], [0, 0, 0]), "y", MODEL).first()
    assert (row["always_cost"], row["never_cost"]) == (30, 1000)


def test_schedules(spark):
    df = pairs(spark, [1, 0, 1, 0], [0] * 4)
    assert c.schedule_cost(df, "y", 2, MODEL, ["i"]).first()["cost"] == 20
    assert c.schedule_cost(pairs(spark, [0, 1, 0], [0] * 3), "y", 2, MODEL, ["i"]).first()["cost"] == 1020
    with pytest.raises(ValueError):
        c.schedule_cost(df, "y", 0, MODEL, ["i"])
    # Without failures the longest calendar acts least; with equal prices the shortest wins.
    quiet = pairs(spark, [0] * 40, [0] * 40)
    best = c.best_schedule(quiet, "y", 2.0, MODEL, ["i"]).first()
    assert (best["schedule_cost"], best["schedule_days"]) == (20, 14)
    assert c.best_schedule(pairs(spark, [0], [0]), "y", 1.0, MODEL, ["i"]).first()["schedule_days"] == 1
    assert c.schedule_intervals(0.5, (1, 3, 5)) == {1: 1, 3: 2, 5: 2}


@pytest.mark.parametrize(
    "y,score,want",
    [([0, 0, 1, 1], [1, 2, 3, 4], 1.0), ([1, 1, 0, 0], [1, 2, 3, 4], 0.0), ([0, 1], [1, 1], 0.5), ([1, 1], [1, 2], None)],
)
def test_auc_known(spark, y, score, want):
    assert r.roc_auc(pairs(spark, y, score), "y", "score").first()["roc_auc"] == want


@pytest.mark.parametrize("size", (10**6, 11))
def test_auc_and_ap_by_brute_force(spark, size):
    rng = np.random.default_rng(5)
    y, score = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    row = r.ranking_metrics(pairs(spark, y, score), "y", "score", rows_per_bucket=size).first()
    p, n = score[y == 1], score[y == 0]
    auc = ((p[:, None] > n) + 0.5 * (p[:, None] == n)).mean()
    ap, seen = 0.0, 0
    for t in sorted(set(score), reverse=True):
        hit = score >= t
        ap += (y[hit].sum() - seen) / y.sum() * y[hit].mean()
        seen = y[hit].sum()
    assert np.isclose(row["roc_auc"], auc) and np.isclose(row["pr_auc"], ap)


def test_metrics_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(9)
    df = pairs(spark, rng.integers(0, 2, 500), np.round(rng.random(500), 2))
    rows = {tuple(r.ranking_metrics(df.repartition(n), "y", "score").first()) for n in (1, 4, 50)}
    assert np.ptp([x[0] for x in rows]) < 1e-12


def test_backfill(spark):
    start = datetime.fromisoformat("2024-03-01 12:00")
    events = events_frame(spark, [("2024-03-01 12:00:00", "2024-03-01 13:00:00")])
    times = [start - timedelta(hours=9), start - timedelta(hours=1), start]

    def run(scores):
        df = spark.createDataFrame(list(zip(times, map(float, scores))), "ts timestamp, score double")
        return r.backfill_performance(df, events, 0.5).first()

    good = run([0, 1, 1])
    assert (good["tp"], good["precision"], good["recall"], good["roc_auc"]) == (2, 1.0, 1.0, 1.0)
    bad = run([1, 0, 0])
    assert (bad["fp"], bad["fn"], bad["recall"], bad["n_positives"]) == (1, 2, 0.0, 2)
