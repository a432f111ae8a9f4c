from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearline.operators import labels as lb
from wearline.operators import splits, tiles
from wearline.operators.tiles import Signals

SIGNALS = Signals(("p", "q"), ("on",))


def readings(spark, n, step=10, start="2024-01-01"):
    times = pd.date_range(start, periods=n, freq=f"{step}s")
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"ts": times, "p": rng.normal(size=n), "q": np.arange(n) * 1.0, "on": 1.0})
    return data, spark.createDataFrame(data)


def test_tiles_match_pandas(spark):
    data, df = readings(spark, 123)
    got = tiles.window_features(df, SIGNALS).orderBy("window_start").toPandas()
    assert got.columns.tolist() == ["window_start", *tiles.feature_names(SIGNALS)]
    g = data.groupby(pd.Grouper(key="ts", freq="10min"))
    kept = g.size() >= 6
    assert len(got) == kept.sum() == 2
    for stat in ("mean", "std", "min", "max"):
        assert np.allclose(got[f"p_{stat}"], g["p"].agg(stat)[kept].fillna(0))
    assert (got["on_mean"] == 1.0).all()


def test_short_tail_and_single_rows(spark):
    _, df = readings(spark, 63)
    assert tiles.window_features(df, SIGNALS).count() == 1
    one = tiles.window_features(df.limit(1), SIGNALS, min_rows=1).first()
    assert one["p_std"] == 0.0


def test_missing_values_become_zero(spark):
    _, df = readings(spark, 60)
    gone = df.withColumn("p", F.lit(None).cast("double"))
    assert tiles.window_features(gone, SIGNALS).first()["p_mean"] == 0.0


def test_bad_arguments(spark):
    _, df = readings(spark, 6)
    with pytest.raises(ValueError, match="'p', 'q'"):
        tiles.window_features(df.drop("p", "q"), SIGNALS)
    with pytest.raises(ValueError, match="divide"):
        tiles.window_features(df, SIGNALS, width="7 minutes")
    with pytest.raises(ValueError):
        tiles.window_features(df, SIGNALS, min_rows=0)


def test_request_equals_tile(spark):
    _, df = readings(spark, 60)
    cells = F.collect_list(F.struct("p", "q", "on")).alias("readings")
    one = tiles.aggregate_request(df.groupBy(F.lit(1).alias("id")).agg(cells), SIGNALS).first()
    tile = tiles.window_features(df, SIGNALS).first()
    for name in tiles.feature_names(SIGNALS):
        assert np.isclose(one[name], tile[name])
    assert one["n_samples"] == 60


@pytest.mark.parametrize("block", (10**6, 4))
def test_sequences(spark, block):
    rows = [(i, float(2 * i), float(2 * i + 1)) for i in range(10)]
    df = spark.createDataFrame(rows, "i long, a double, b double")

    def stack(k, data=df, **kw):
        return tiles.stack_sequences(data, ["a", "b"], k, ["i"], block_rows=block, **kw).orderBy("i").collect()

    got = stack(3)
    assert len(got) == 8 and all(len(r["sequence"]) == 6 for r in got)
    assert stack(2)[0]["sequence"] == [0, 1, 2, 3]
    assert [r["sequence"] for r in stack(1)] == [[a, b] for _, a, b in rows]
    assert stack(4, df.limit(3)) == []
    nested = stack(4, nested=True)
    assert len(nested) == 7 and len(nested[0]["sequence"]) == 4
    assert nested[0]["i"] == 3
    with pytest.raises(ValueError):
        stack(0)


@pytest.mark.parametrize("block", (10**6, 17))
@pytest.mark.parametrize("size", (12, 5))
def test_centered_mean(spark, block, size):
    rng = np.random.default_rng(2)
    v = rng.normal(size=100)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double")
    got = tiles.centered_mean(df, "v", size, ["i"], block_rows=block).orderBy("i").toPandas()
    want = pd.Series(v).rolling(size, center=True, min_periods=1).mean()
    assert np.allclose(got["smoothed"], want)


EVENT = [("2024-05-10 12:00:00", "2024-05-10 18:00:00")]


def label(spark, times, **options):
    df = spark.createDataFrame([(datetime.fromisoformat(t),) for t in times], "window_start timestamp")
    out = lb.interval_labels(df, lb.events_frame(spark, EVENT), **options).orderBy("window_start")
    return [r["label"] for r in out.collect()]


def test_label_rules(spark):
    assert label(spark, ["2024-05-01 00:00", "2024-05-10 10:00"], warn_hours=24) == [0, 1]
    assert label(spark, ["2024-05-10 02:00"], warn_hours=4) == [0]
    assert label(spark, ["2024-05-10 02:00"], warn_hours=24) == [1]
    times = ["2024-05-01 00:00", "2024-05-10 11:00", "2024-05-10 15:00"]
    assert label(spark, times, active=False) == [0, 1, -1]
    assert label(spark, times, active=True) == [0, 1, 1]
    # The end is inclusive, the lead-in starts inclusive.
    assert label(spark, ["2024-05-10 10:00", "2024-05-10 18:00", "2024-05-10 18:01"], active=False) == [1, -1, 0]


@pytest.mark.parametrize("active", (True, False))
def test_labels_by_brute_force(spark, active):
    rng = np.random.default_rng(4)
    base = datetime.fromisoformat("2024-01-01")
    # One key has most of the events, many of them overlapping; one ends before it starts.
    events = pd.DataFrame(
        {
            "k": rng.choice([1, 1, 1, 2], 60),
            "start": base + pd.to_timedelta(rng.integers(0, 50_000, 60), "min"),
        }
    )
    events["end"] = events["start"] + pd.to_timedelta(rng.integers(-30, 900, 60), "min")
    rows = pd.DataFrame(
        {
            "k": rng.choice([1, 2, 3], 2000),
            "window_start": base + pd.to_timedelta(rng.integers(-500, 51_000, 2000), "min"),
            "i": range(2000),
        }
    )
    out = lb.interval_labels(
        spark.createDataFrame(rows), spark.createDataFrame(events), warn_hours=3, active=active, keys=["k"]
    )
    got = out.orderBy("i").toPandas()["label"].to_numpy()
    want = np.zeros(2000, int)
    for e in events.itertuples():
        t = rows["window_start"]
        want[(rows["k"] == e.k) & (t >= e.start - timedelta(hours=3)) & (t < e.start)] = 1
    for e in events.itertuples():
        t = rows["window_start"]
        want[(rows["k"] == e.k) & (t >= e.start) & (t <= e.end)] = 1 if active else -1
    assert (got == want).all()


def test_many_events_use_no_broadcast(spark, monkeypatch, plan):
    monkeypatch.setattr(lb, "MAX_BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(datetime.fromisoformat("2024-05-10 11:00"),)], "window_start timestamp")
        out = lb.interval_labels(df, lb.events_frame(spark, EVENT))
        assert "Broadcast" not in plan(out)
        assert out.first()["label"] == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lead_times(spark):
    start = datetime.fromisoformat(EVENT[0][0])
    rows = [(start - timedelta(hours=h), s) for h, s in ((60, 9.0), (5, 0.0), (1, 9.0), (-1, 9.0))]
    df = spark.createDataFrame(rows, "window_start timestamp, score double")
    events = lb.events_frame(spark, EVENT)
    hit = lb.lead_times(df, events, 5.0).first()
    assert (hit["lead_hours"], hit["flagged_during"]) == (1.0, True)
    none = lb.lead_times(df, events, 50.0).first()
    assert (none["lead_hours"], none["flagged_during"]) == (None, False)


def test_healthy_period(spark):
    start = datetime.fromisoformat(EVENT[0][0])
    rows = [(start + timedelta(hours=h), float(h)) for h in range(-10, 10)]
    df = spark.createDataFrame(rows, "window_start timestamp, score double")
    events = lb.events_frame(spark, EVENT)
    assert lb.healthy_period(df, events).count() == 10
    assert np.isclose(lb.threshold_value(df, events, q=0.5), np.quantile(np.arange(-10, 0), 0.5))


def test_folds():
    for fold in splits.fold_bounds(100, n_splits=5):
        assert fold.train_end == fold.test_start < fold.test_end
    assert all(f.test_start - f.train_end == 7 for f in splits.fold_bounds(200, n_splits=5, embargo=7))
    assert splits.fold_bounds(100, n_splits=5)[-1].test_end == 100
    assert [f.number for f in splits.fold_bounds(60, n_splits=5, embargo=15)] == [0, 1, 2, 3]
    for bad in ({"n_splits": 0}, {"embargo": -1}):
        with pytest.raises(ValueError):
            splits.fold_bounds(100, **bad)
    with pytest.raises(ValueError):
        splits.fold_bounds(2, n_splits=5)


def test_folds_as_rows(spark):
    df = spark.range(60).withColumnRenamed("id", "t")
    rows = splits.assign_folds(df, ["t"], n_splits=5, embargo=3, rows_per_bucket=7).toPandas()
    for f, g in rows.groupby("fold"):
        train, test = g[g["role"] == "train"]["t"], g[g["role"] == "test"]["t"]
        assert test.min() - train.max() == 4
    assert rows[rows["role"] == "test"]["t"].nunique() == 50


def test_stratified_split_is_exact_and_stable(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    first = splits.stratified_split(df, "y", 0.3, "id", rows_per_bucket=50)
    sizes = {r["y"]: r["n"] for r in first.where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 270, 1: 30}
    second = splits.stratified_split(df.repartition(9), "y", 0.3, "id")
    assert set(r["id"] for r in first.where("is_test").collect()) == set(
        r["id"] for r in second.where("is_test").collect()
    )


def test_swept_labels_equal_the_slot_join(spark, monkeypatch):
    """Small ranges, overlapping reports, rows at borders, without time or key, and repeated rows."""
    rng = np.random.default_rng(5)
    start = pd.Timestamp("2024-01-01")
    n = 600
    rows = pd.DataFrame(
        {
            "dev": rng.choice(["a", "b", None], n),
            "window_start": [start + pd.Timedelta(minutes=int(m)) for m in rng.integers(0, 400, n)],
            "tags": [["x"]] * n,
        }
    )
    begins = [start + pd.Timedelta(minutes=int(m)) for m in rng.integers(0, 400, 25)]
    spans = [b + pd.Timedelta(minutes=int(m)) for b, m in zip(begins, rng.integers(-5, 30, 25))]
    events = spark.createDataFrame(
        pd.DataFrame({"dev": rng.choice(["a", "b", None], 25), "start": begins, "end": spans})
    )
    df = spark.createDataFrame(rows).unionByName(
        spark.sql("select 'a' dev, cast(null as timestamp) window_start, array('y') tags")
    )
    for keys in ([], ["dev"]):
        for active in (True, False):
            options = dict(warn_hours=0.1, active=active, keys=keys)
            one, two = (
                lb.interval_labels(df, events, sweep=s, rows_per_bucket=20, **options)
                .groupBy("dev", "window_start", "label").count().toPandas()
                .sort_values(["dev", "window_start", "label"], ignore_index=True)
                for s in (True, False)
            )
            pd.testing.assert_frame_equal(one, two)
    assert lb.interval_labels(df, events.limit(0), sweep=True).where("label <> 0").count() == 0


def test_sweep_spreads_one_instant_over_ranges(spark, monkeypatch):
    laid = []
    arrange = lb.arrange
    monkeypatch.setattr(lb, "arrange", lambda *a, **k: laid.append(arrange(*a, **k)) or laid[-1])
    rows = spark.range(20_000).selectExpr("id", "timestamp'2024-01-01 00:05:00' window_start")
    out = lb.interval_labels(rows, lb.events_frame(spark, EVENT), sweep=True, rows_per_bucket=2000)
    assert out.count() == 20_000
    sizes = sorted(r["count"] for r in laid[-1].frame.groupBy("_range").count().collect())
    assert len(sizes) >= 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
