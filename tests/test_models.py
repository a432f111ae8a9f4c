from dataclasses import replace
from datetime import datetime, timezone
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearline.operators import iforest as fo
from wearline.operators import supervised as sv
from wearline.operators.labels import events_frame
from wearline.operators.tiles import stack_sequences
from wearline.plans import crossval, detector, fleet, marts, retrain
from wearline.sources import models
from wearline.sources.claims import claim
from wearline.sources.models import ModelStore

FEATURES = ["a", "b", "c"]


def points(spark, n=600, planted=30, seed=0):
    """Hourly rows; the last ``planted`` ones lie far off."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[n - planted :] += 6
    data = pd.DataFrame(x, columns=FEATURES)
    data.insert(0, "window_start", pd.date_range("2024-01-01", periods=n, freq="1h"))
    return data, spark.createDataFrame(data)


@pytest.fixture(scope="module")
def fitted(spark):
    data, df = points(spark)
    calm = df.limit(500)
    return data, df, fo.fit_iforest(calm, FEATURES, ident=["window_start"], trees=60)


def test_tree_shape(fitted):
    _, _, forest = fitted
    nodes = forest.nodes
    assert forest.trees == 60 and len(nodes) <= 60 * 511
    inner = nodes[nodes["feature"] >= 0]
    assert (inner["right"] == inner["left"] + 1).all()
    # Every path ends within the depth limit, and adds its leaf's expected remainder.
    assert nodes["path"].max() <= 8 + float(fo.mean_path(256))


def test_outliers_score_higher(fitted):
    _, df, forest = fitted
    scored = fo.score_iforest(df, forest).orderBy("window_start").toPandas()["score"]
    assert scored[-30:].min() > scored[:500].median()
    assert np.isclose((scored[:500] > 0).mean(), 0.02, atol=0.005)


def test_same_seed_same_forest(spark, fitted):
    _, df, forest = fitted
    again = fo.fit_iforest(df.limit(500).repartition(9), FEATURES, ident=["window_start"], trees=60)
    pd.testing.assert_frame_equal(forest.nodes, again.nodes)


def test_large_draw_is_full_and_unbiased(spark):
    df = spark.range(20_000).select("id", (F.col("id") / 20_000).alias("a"))
    draw = fo.tree_samples(df, ["a"], ident=["id"], total=20_000, trees=50, sample=256, seed=1)
    sizes = draw.groupBy("tree").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    assert tuple(sizes) == (256, 256, 50)
    assert abs(draw.agg(F.avg(F.col("point")[0])).first()[0] - 0.5) < 0.02


@pytest.mark.parametrize("rows", (1_000, 1_100, 5_000))
def test_equal_rows_weigh_as_often_as_they_occur(spark, rows):
    """Trees are as full on both sides of four samples, and a common value is drawn more often."""
    df = spark.range(rows).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 40).cast("double").alias("a"))
    draw = fo.tree_samples(df, ["a"], ident=[], total=rows, trees=30, sample=256, seed=1)
    sizes = [r["count"] for r in draw.groupBy("tree").count().collect()]
    assert len(sizes) == 30 and min(sizes) == max(sizes) == 256
    common = draw.where(F.col("point")[0] == 0).count() / (30 * 256)
    assert abs(common - 0.5) < 0.05


def test_a_small_table_gives_every_row_to_every_tree(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("a"))
    for ident in ([], ["a"]):
        draw = fo.tree_samples(df, ["a"], ident=ident, total=200, trees=12, sample=200, seed=1)
        assert draw.count() == 12 * 200 and draw.distinct().count() == 12 * 200


def test_flat_rows_score_alike(spark):
    df = spark.range(50).select(F.lit(1.0).alias("a"))
    flat = fo.fit_iforest(df, ["a"], trees=8)
    assert fo.score_iforest(df, flat).select("score").distinct().count() == 1


def test_metrics_come_back_with_a_forest(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"))
    forest = fo.fit_iforest(df, ["a"], trees=4)
    fo.save_forest(forest, spark, str(tmp_path / "f"), {"roc_auc": 0.9})
    again = fo.load_forest(spark, str(tmp_path / "f"))
    assert again.metrics == {"roc_auc": 0.9}
    fo.save_forest(again, spark, str(tmp_path / "g"))
    assert fo.load_forest(spark, str(tmp_path / "g")).metrics == {"roc_auc": 0.9}


def test_prefix_scores(fitted):
    _, df, forest = fitted
    out = fo.score_with_prefixes(df.limit(20), forest, [20, 60]).orderBy("window_start").toPandas()
    whole = fo.score_iforest(df.limit(20), replace(forest, offset=0.0)).orderBy("window_start").toPandas()
    assert np.allclose(out["score_60"], whole["score"])
    part = replace(forest, nodes=forest.nodes[forest.nodes["tree"] < 20], offset=0.0)
    assert np.allclose(out["score_20"], fo.score_iforest(df.limit(20), part).orderBy("window_start").toPandas()["score"])


def test_missing_features_and_empty_fit(spark, fitted):
    _, df, forest = fitted
    with pytest.raises(ValueError, match="'b'"):
        fo.score_iforest(df.drop("b"), forest)
    with pytest.raises(ValueError):
        fo.fit_iforest(df.limit(0), FEATURES)


def test_save_and_load(spark, fitted, tmp_path):
    _, df, forest = fitted
    forest = replace(forest, threshold=0.1, version="v1")
    fo.save_forest(forest, spark, str(tmp_path / "f"), {"roc_auc": 0.9})
    back = fo.load_forest(spark, str(tmp_path / "f"))
    assert (back.threshold, back.version, back.features) == (0.1, "v1", forest.features)
    a = fo.predict(df.limit(10), forest).toPandas()
    b = fo.predict(df.limit(10), back).toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert set(a["model_version"]) == {"v1"} and (a["alert"] == (a["anomaly_score"] >= 0.1)).all()
    with pytest.raises(FileNotFoundError):
        fo.load_forest(spark, str(tmp_path / "none"))


def test_detector_finds_a_planted_failure(spark):
    data, df = points(spark)
    start, end = data["window_start"].iloc[-30], data["window_start"].iloc[-1]
    events = events_frame(spark, [(str(start), str(end))])
    report = detector.evaluate_detector(df, events, FEATURES, trees=50, warn_hours=0)
    row = report.metrics.first()
    assert row["train_windows"] == 570 and row["test_positives"] == 30
    # One class only after the start: ranking is undefined, recall is not.
    assert row["roc_auc"] is None and row["recall"] > 0.9
    assert report.lead_times.first()["flagged_during"]
    later = detector.evaluate_detector(
        df, events_frame(spark, [("2024-01-10 00:00:00", "2024-01-10 00:00:00"), (str(start), str(end))]),
        FEATURES, trees=50,
    ).metrics.first()
    assert later["roc_auc"] > 0.9


def test_ensemble_sweep(spark):
    data, df = points(spark)
    events = events_frame(
        spark, [("2024-01-10 00:00:00", "2024-01-10 00:00:00"), (str(data["window_start"].iloc[-30]), str(data["window_start"].iloc[-1]))]
    )
    rows = detector.ensemble_sweep(df, events, FEATURES, sizes=(40, 10)).orderBy("trees").collect()
    assert [r["trees"] for r in rows] == [10, 40] and all(r["roc_auc"] > 0.85 for r in rows)


def labelled(spark, n=360):
    rng = np.random.default_rng(3)
    y = (np.arange(n) % 9 == 0).astype(int)
    data = pd.DataFrame(rng.normal(size=(n, 3)), columns=FEATURES)
    data["a"] += 3 * y
    data["y"] = y
    data["t"] = range(n)
    return spark.createDataFrame(data)


@pytest.mark.parametrize(
    "fit",
    [
        partial(sv.fit_forest, trees=10, depth=5),
        partial(sv.fit_gbt, rounds=4, depth=3),
        partial(sv.fit_mlp, hidden=(8,), iterations=60),
    ],
)
def test_models_rank(spark, fit):
    df = labelled(spark)
    out = fit(df, FEATURES)(df).toPandas()
    assert out[out["y"] == 1]["score"].mean() > out[out["y"] == 0]["score"].mean() + 0.2


def test_sequences_feed_models(spark):
    stacked = stack_sequences(labelled(spark, 60), FEATURES, 3, ["t"])
    wide = sv.spread_sequence(stacked.select("t", "y", "sequence"), 9)
    assert wide.columns == ["t", "y", *[f"x{i}" for i in range(9)]] and wide.count() == 58


def test_temporal_cv(spark):
    out = crossval.temporal_cv(
        labelled(spark), FEATURES, ["t"], partial(sv.fit_forest, features=FEATURES, trees=8, depth=4),
        n_splits=3, embargo=4, windows_per_day=12.0,
    )
    rows = out.orderBy("fold").collect()
    assert [r["fold"] for r in rows] == [0, 1, 2]
    assert all(r["roc_auc"] > 0.8 and r["model_cost"] < r["run_to_failure_cost"] for r in rows)
    quiet = labelled(spark).withColumn("y", F.lit(0))
    with pytest.raises(ValueError, match="no scorable folds"):
        crossval.temporal_cv(quiet, FEATURES, ["t"], None)


PRICED = """
WITH cuts AS (SELECT fold, score AS t FROM train GROUP BY ALL UNION ALL SELECT fold, max(score) + 1 FROM train GROUP BY 1),
priced AS (SELECT c.fold, t, sum(CASE WHEN score >= t THEN 200 WHEN y = 1 THEN 3000 ELSE 0 END) AS cost
  FROM cuts c JOIN train s ON s.fold = c.fold GROUP BY 1, 2),
best AS (SELECT fold, t FROM priced QUALIFY row_number() OVER (PARTITION BY fold ORDER BY cost, t DESC) = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY row_index) - 1 AS i FROM test),
calendar AS (SELECT fold, d, sum(CASE WHEN i % (d * 12) = 0 THEN 200 WHEN y = 1 THEN 3000 ELSE 0 END) AS cost
  FROM numbered, (VALUES (1), (3), (7), (14)) v(d) GROUP BY 1, 2),
model AS (SELECT fold, t, sum(CASE WHEN score >= t THEN 200 WHEN y = 1 THEN 3000 ELSE 0 END) AS cost,
  sum((score >= t AND y = 1)::INTEGER) AS tp, sum((score >= t)::INTEGER) AS alerts, sum(y) AS positives
  FROM test JOIN best USING (fold) GROUP BY 1, 2),
pairs AS (SELECT a.fold, avg(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc
  FROM test a JOIN test b ON a.fold = b.fold AND a.y = 1 AND b.y = 0 GROUP BY 1)
SELECT fold, t AS threshold, auc AS roc_auc, m.cost AS model_cost, s.cost AS schedule_cost,
  (s.cost - m.cost) / s.cost AS roi_vs_schedule, coalesce(tp / nullif(alerts, 0), 0) AS precision, tp / positives AS recall
FROM model m JOIN pairs USING (fold) JOIN (SELECT fold, min(cost) AS cost FROM calendar GROUP BY 1) s USING (fold) ORDER BY fold"""


@pytest.mark.parametrize(
    "fit",
    [partial(sv.fit_gbt, features=FEATURES, rounds=3, depth=3), partial(sv.fit_mlp, features=FEATURES, hidden=(6,), order="row_index")],
)
def test_folds_priced_by_sql_on_stored_scores(spark, fit):
    import duckdb

    folds = crossval.scored_folds(labelled(spark), FEATURES, ["t"], fit, n_splits=3, embargo=4)
    con = duckdb.connect()
    for side in (1, 2):
        rows = pd.concat([f[side].toPandas().assign(fold=f[0]) for f in folds])
        con.register("train" if side == 1 else "test", rows)
    want = con.execute(PRICED).df()
    got = crossval.judge_folds(folds, windows_per_day=12.0).orderBy("fold").toPandas()
    for c in want.columns:
        assert np.allclose(got[c].astype(float), want[c].astype(float)), c


def test_sequence_cv(spark):
    out = crossval.sequence_cv(
        labelled(spark), FEATURES, ["t"], k=3, n_splits=3, embargo=4, windows_per_day=12.0,
        fit=partial(sv.fit_mlp, hidden=(8,)),
    ).orderBy("fold").collect()
    assert [r["fold"] for r in out] == [0, 1, 2] and {r["model"] for r in out} == {"network"}
    assert np.mean([r["roc_auc"] for r in out]) > 0.75


def test_network_stops_early(spark, monkeypatch):
    losses = iter([0.5, 0.4, 0.45, 0.44, 0.1])
    kept = []
    monkeypatch.setattr(sv, "_log_loss", lambda model, rows, y: kept.append((model, rows.count())) or next(losses))
    rows = labelled(spark).withColumn("row_index", F.col("t"))
    found = sv.fit_mlp(rows, FEATURES, hidden=(4,), every=5, order="row_index")
    assert len(kept) == 4 and found.model is kept[1][0]
    assert kept[0][1] == round(0.1 * rows.count())


@pytest.mark.parametrize(
    "fit",
    [partial(sv.fit_forest, trees=5, depth=3), partial(sv.fit_gbt, rounds=2, depth=2), partial(sv.fit_mlp, hidden=(4,), iterations=10)],
)
def test_stored_scorers_score_alike(spark, tmp_path, fit):
    df = labelled(spark)
    scorer = fit(df, FEATURES)
    store = ModelStore(spark, str(tmp_path / "store"))
    version = store.save(scorer, metrics={"roc_auc": 0.9}, at=datetime(2024, 5, 1, 12, 30, tzinfo=timezone.utc))
    assert version == f"{scorer.kind}-20240501-123000"
    back = store.load(version)
    a, b = (s(df).orderBy("t").toPandas()["score"] for s in (scorer, back))
    assert np.array_equal(a, b) and back.features == scorer.features
    with pytest.raises(ValueError, match="exists"):
        store.save(scorer, version)
    row = store.versions().first()
    assert (row["version"], row["metrics"]["roc_auc"], row["trained_at"][:10]) == (version, 0.9, "2024-05-01")


def test_missing_and_half_written_models(spark, tmp_path, fitted, monkeypatch):
    _, df, forest = fitted
    store = ModelStore(spark, str(tmp_path / "store"))
    assert store.versions().count() == 0
    with pytest.raises(FileNotFoundError, match="no committed"):
        store.load("v1")
    monkeypatch.setattr(models, "claim", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.save(forest, "v1")
    monkeypatch.undo()
    with pytest.raises(FileNotFoundError, match="no committed"):
        store.load("v1")
    store.save(forest, "v1")
    assert store.load("v1").version == "v1"
    monkeypatch.setattr(models, "exists", lambda *a: False)
    with pytest.raises(ValueError, match="another writer"):
        store.save(forest, "v1")
    monkeypatch.undo()
    scorer = sv.fit_forest(labelled(spark), FEATURES, trees=2, depth=2)
    store.save(scorer, "v2")
    for part in (tmp_path / "store" / "models").glob("v2-*"):
        (part / "metadata").rename(part / "gone")
    with pytest.raises(FileNotFoundError, match="not whole"):
        store.load("v2")


def fleet_table(spark, n=1500):
    rng = np.random.default_rng(6)
    model = rng.choice(["m1", "m2", "m3"], n)
    failed = (rng.random(n) < np.where(model == "m3", 0.5, 0.05)).astype("int32")
    start = pd.Timestamp("2019-01-01") + pd.to_timedelta(rng.integers(0, 900, n), "D")
    end = np.where(failed == 1, pd.Timestamp("2022-05-01"), pd.Timestamp("2024-01-01"))
    return spark.createDataFrame(
        pd.DataFrame(
            {
                "serial_number": [f"s{i}" for i in range(n)],
                "capacity_tb": rng.choice([4.0, 8.0], n),
                "model": model,
                "min_date": start,
                "max_date": pd.to_datetime(end),
                "failed": failed,
            }
        )
    )


def test_fleet_risk(spark):
    row = fleet.fleet_risk(fleet_table(spark), trees=10, depth=5).first()
    assert row["n_units"] == 1500
    assert row["roc_auc_prior_only"] > 0.75 and row["roc_auc"] > 0.7


def test_marts(spark, tmp_path):
    from wearline.sources import sinks

    units = fleet_table(spark)
    mart = marts.afr_mart(units, min_units=100, k=2)
    assert [r["model"] for r in mart.collect()][0] == "m3" and mart.count() == 2
    sinks.write_mart(mart, str(tmp_path / "afr"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "afr")).columns == ["model", "afr", "units", "failures"]
    _, tiles = points(spark)
    events = events_frame(spark, [("2024-01-02 00:00:00", "2024-01-02 01:00:00")])
    one = marts.summary_struct(tiles, events, units, 0.1).first()
    assert one["fleet"]["units"] == 1500 and one["telemetry"]["windows"] == 600
    assert marts.timeline(tiles.withColumnRenamed("a", "score")).count() == 600


def test_retrain_loop(spark, tmp_path):
    registry = retrain.Registry(spark, str(tmp_path / "registry"))
    registry.create()
    rng = np.random.default_rng(8)
    ref = spark.createDataFrame(pd.DataFrame({"x": rng.normal(size=300)}))
    cur = spark.createDataFrame(pd.DataFrame({"x": rng.normal(3, 1, 300)}))
    good = {"roc_auc": 0.95, "pr_auc": 0.4, "recall": 0.8}
    calls = []

    def build(version, **changes):
        def run():
            calls.append(version)
            return version, {**good, **changes}

        return run

    idle = retrain.retrain_if_drift(ref, ref, ["x"], registry, "m", build("v0"), "t0")
    assert not idle["retrain"] and idle["healed"] is None and calls == []
    first = retrain.retrain_if_drift(ref, cur, ["x"], registry, "m", build("v1"), "t1")
    assert first["healed"]["promote"] and first["healed"]["reason"] .startswith("no production")
    worse = retrain.retrain_if_drift(ref, cur, ["x"], registry, "m", build("v2", roc_auc=0.91), "t2")
    assert not worse["healed"]["promote"]
    better = retrain.retrain_if_drift(ref, cur, ["x"], registry, "m", build("v3", roc_auc=0.96), "t3")
    assert better["healed"]["promote"]
    actions = [(r["seq"], r["action"], r["version"]) for r in registry.audit().orderBy("seq").collect()]
    assert actions == [
        (0, "register", "v1"), (1, "promote", "v1"), (2, "register", "v2"), (3, "register", "v3"), (4, "promote", "v3"),
    ]


def test_a_second_writer_is_refused(spark, tmp_path):
    registry = retrain.Registry(spark, str(tmp_path / "registry"))
    registry.create()
    entry = [{"action": "register", "version": "v1", "at": "t"}]
    seen = registry.next_seq("m")
    registry.append("m", entry, seen)
    with pytest.raises(retrain.Refused):
        registry.append("m", [{"action": "register", "version": "v2"}], seen)
    registry.append("other/model", entry, 0)
    # A writer that claimed its number and died holds it until it is released.
    claim(spark, registry._claim("m", 1))
    with pytest.raises(retrain.Refused):
        registry.append("m", entry)
    registry.release("m")
    registry.append("m", entry)
    rows = registry.audit().where("model = 'm'").orderBy("seq").collect()
    assert [(r["seq"], r["version"]) for r in rows] == [(0, "v1"), (1, "v1")]


def test_a_claim_is_made_once(spark, tmp_path):
    path = str(tmp_path / "claims" / "one")
    assert claim(spark, path, "first") and not claim(spark, path, "second")
    assert (tmp_path / "claims" / "one").read_text() == "first"


def test_a_candidate_judged_on_an_old_state_is_refused(spark, tmp_path, monkeypatch):
    registry = retrain.Registry(spark, str(tmp_path / "registry"))
    registry.create()
    good = {"roc_auc": 0.95, "pr_auc": 0.4, "recall": 0.8}
    decide = retrain.promotion_decision

    def meanwhile(*args, **options):
        monkeypatch.setattr(retrain, "promotion_decision", decide)
        retrain.heal(registry, "m", "v1", good, "t1")
        return decide(*args, **options)

    monkeypatch.setattr(retrain, "promotion_decision", meanwhile)
    with pytest.raises(retrain.Refused):
        retrain.heal(registry, "m", "v2", good, "t2")
    assert {r["version"] for r in registry.metrics().collect()} == {"v1"}
    assert [r["version"] for r in registry.audit().orderBy("seq").collect()] == ["v1", "v1"]
