"""One test for each answer that was once wrong."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.operators import cost, drift, supervised, tiles
from wearline.plans.retrain import Registry, heal
from wearline.sources import feed, sinks, tables


def test_csv_files_with_another_header_order_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,p,q\n2024-01-01 00:00:00,1,2\n")
    (tmp_path / "b.csv").write_text("timestamp,q,p\n2024-01-01 00:00:00,1,2\n")
    signals = tiles.Signals(analog=("p", "q"), digital=())
    one = tables.read_telemetry(spark, str(tmp_path / "b.csv"), signals, fmt="csv").first()
    assert (one["p"], one["q"]) == (2.0, 1.0)
    with pytest.raises(Exception, match="header"):
        tables.read_telemetry(spark, str(tmp_path), signals, fmt="csv").collect()


def test_a_group_without_scores_keeps_its_row(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, None), ("b", 0, None)], "g string, y int, s double")
    got = {r["g"]: r for r in cost.optimal_threshold(df, "y", "s", cost.DEFAULT_COST, ["g"]).collect()}
    assert got["a"]["threshold"] == 0.9
    never = cost.baseline_costs(df, "y", cost.DEFAULT_COST, ["g"]).where("g = 'b'").first()["never_cost"]
    assert got["b"]["threshold"] is None and got["b"]["cost"] == never


def test_a_known_version_is_refused_before_writing(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry"))
    registry.create()
    good = {"roc_auc": 0.97, "pr_auc": 0.5, "recall": 0.9}
    heal(registry, "m", "v1", good, "2024-01-01")
    with pytest.raises(ValueError, match="v1"):
        heal(registry, "m", "v1", {**good, "roc_auc": 0.99}, "2024-01-02")
    assert registry.production("m").count() == 3


def test_parameters_are_logged_once_per_run(spark):
    folds = spark.createDataFrame([("rf", 0, 0.9), ("rf", 1, 0.8)], "model string, fold int, auc double")
    log = sinks.run_log(folds, ["auc"], step="fold", params={"trees": 10})
    assert log.where("kind = 'param'").count() == 1 and log.where("kind = 'metric'").count() == 2


def test_a_mart_keeps_the_tasks_of_its_aggregation(spark, tmp_path):
    df = spark.range(100).repartition(4).groupBy((F.col("id") % 10).alias("k")).count()
    sinks.write_mart(df, str(tmp_path / "mart"))
    assert len(list((tmp_path / "mart").glob("part-*"))) == 1
    assert spark.read.parquet(str(tmp_path / "mart")).count() == 10


def test_a_malformed_feed_value_is_missing(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,)], "value string")
    assert [r["value"] for r in feed.non_null_values(df).collect()] == [1.5]


@pytest.mark.parametrize("n", (300, 11_000))
def test_ks_methods_are_the_same_at_any_size(spark, n):
    rng = np.random.default_rng(n)
    ref, cur = (spark.createDataFrame([(float(x),) for x in rng.normal(m, 1, n)], "f double") for m in (0, 0.02))
    series = drift.ks_2samp(ref, cur, ["f"]).first()
    exact = drift.ks_2samp(ref, cur, ["f"], method="exact").first()
    assert exact["ks_pvalue"] == pytest.approx(drift.exact_ks_tail(exact["ks_distance"], n, n), rel=1e-9)
    assert exact["ks_pvalue"] != series["ks_pvalue"]
    assert exact["ks_pvalue"] == pytest.approx(series["ks_pvalue"], abs=0.02)
    with pytest.raises(ValueError):
        drift.ks_2samp(ref, cur, ["f"], method="auto")


def test_exact_ks_tail_by_hand():
    """Of the 6 interleavings of two and two values, 2 reach a distance of 1."""
    assert drift.exact_ks_tail(1.0, 2, 2) == pytest.approx(2 / 6)
    assert drift.exact_ks_tail(0.5, 2, 2) == pytest.approx(1.0)
    assert drift.exact_ks_tail(1.0, 3, 1) == pytest.approx(2 / 4)


def test_exact_ks_tail_beside_the_closed_form(monkeypatch):
    """Equal sizes have a sum of binomial ratios; the wide way agrees with it as the narrow one does."""

    def closed(n, h):
        signed = [(-1) ** (k + 1) * math.comb(2 * n, n - k * h) for k in range(1, n // h + 1)]
        return float(Fraction(2 * sum(signed), math.comb(2 * n, n)))

    for band in (drift.WIDE_BAND, 60):
        monkeypatch.setattr(drift, "WIDE_BAND", band)
        for n, h in ((1500, 40), (1500, 400), (2000, 65)):
            assert drift.exact_ks_tail(h / n, n, n) == pytest.approx(closed(n, h), rel=1e-9)


def test_exact_ks_tail_convolves_a_wide_band(monkeypatch):
    """Between its borders a wide band is not walked step by step."""
    cells, walk = [], drift._walk

    def counted(mass, base, floor, *rest):
        cells.append(mass.shape[1] * len(floor))
        return walk(mass, base, floor, *rest)

    monkeypatch.setattr(drift, "_walk", counted)
    n, h = 60_000, 5_000
    assert 0 < drift.exact_ks_tail(h / n, n, n) < 1e-100
    assert sum(cells) < 0.2 * 2 * n * h


def test_exact_ks_walks_each_feature_in_its_own_task(spark):
    rows = [(float(i), float(i % 7), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "f double, g double, h double")
    found = drift.ks_2samp(df, df.where("f > 9"), ["f", "g", "h"], method="exact")
    assert found.groupBy(F.spark_partition_id().alias("task")).count().count() == 3


def test_a_forest_trains_on_spread_rows(spark, monkeypatch):
    """Rows of one large file keep more than one task busy; few rows stay where they are."""
    seen, fit = [], supervised.RandomForestClassifier.fit

    def counted(self, df):
        seen.append((df.rdd.getNumPartitions(), self.getCacheNodeIds()))
        return fit(self, df)

    monkeypatch.setattr(supervised.RandomForestClassifier, "fit", counted)
    df = spark.range(2000).selectExpr("CAST(id % 17 AS double) AS x", "CAST(id % 17 > 11 AS int) AS y").coalesce(1)
    supervised.fit_forest(df, ["x"], trees=2, depth=2)
    monkeypatch.setattr(supervised, "ROWS_PER_TASK", 300)
    supervised.fit_forest(df, ["x"], trees=2, depth=2)
    assert seen == [(1, True), (6, True)]
