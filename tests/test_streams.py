"""Streaming answers equal batch answers, over several files and batches."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearline.operators import contracts, drift, iforest, rates, ranking, tiles
from wearline.operators.tiles import Signals
from wearline.session import materialize
from wearline.sources import feed, sinks, tables
from wearline.streaming import jobs, stores

SIGNALS = Signals(("p",), ("on",))
SCHEMA = "seq long, ts timestamp, dev string, p double, on double"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    """Four files, each one micro-batch, oldest first; one device has most rows."""
    path = str(tmp_path_factory.mktemp("source"))
    rng = np.random.default_rng(0)
    n = 800
    data = pd.DataFrame(
        {
            "seq": range(n),
            "ts": pd.date_range("2024-01-01", periods=n, freq="30s"),
            "dev": np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b"], n)),
            "p": rng.normal(size=n),
            "on": rng.integers(0, 2, n).astype(float),
        }
    )
    for part in np.array_split(np.arange(n), 4):
        spark.createDataFrame(data.iloc[part], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def batch(spark, path):
    return spark.read.schema(SCHEMA).parquet(path)


def same(a, b):
    order = a.columns
    x, y = (d.select(order).toPandas().sort_values(order, ignore_index=True) for d in (a, b))
    pd.testing.assert_frame_equal(x, y)


def test_features(spark, source, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    made = jobs.stream_features(stream(spark, source), SIGNALS, lateness="10 minutes", keys=["dev"])
    jobs.run_available(made, out, check)
    want = tiles.window_features(batch(spark, source), SIGNALS, keys=["dev"])
    last = batch(spark, source).agg(F.max("ts")).first()[0]
    closed = F.col("window_start") + F.expr("INTERVAL 20 MINUTES") <= F.lit(last)
    same(spark.read.parquet(out), want.where(closed))


def test_rates_and_histogram(spark, source, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    served = stream(spark, source).withColumn("alert", F.col("p") > 1)
    jobs.run_available(jobs.stream_rates(served, lateness="1 minute"), out, check)
    want = rates.prediction_rates(batch(spark, source).withColumn("alert", F.col("p") > 1))
    got = spark.read.parquet(out)
    assert got.count() >= want.count() - 2
    same(got, want.join(got.select("window_start"), "window_start", "left_semi"))
    out2, check2 = str(tmp_path / "out2"), str(tmp_path / "check2")
    jobs.run_available(jobs.stream_histogram(stream(spark, source), "p", lateness="1 minute"), out2, check2)
    tiled = rates.score_histogram(batch(spark, source).withColumn("tile", F.window("ts", "5 minutes")), "p", ["tile"])
    n = {(r["tile"]["start"], r["le"]): r["n"] for r in tiled.collect()}
    rows = spark.read.parquet(out2).collect()
    assert rows and all(n[(r["tile"]["start"], r["le"])] == r["n"] for r in rows)


def test_validate(spark, source, tmp_path):
    contract = contracts.telemetry_contract({"p": (-1.0, 1.0)}, ("on",))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    jobs.run_batches(stream(spark, source), jobs.validate_batches(contract, good, bad), str(tmp_path / "check"))
    accepted, refused = contracts.split_valid(batch(spark, source), contract)
    same(spark.read.parquet(good).drop("batch_id"), accepted)
    same(spark.read.parquet(bad).drop("batch_id"), refused)


def test_score(spark, source, tmp_path):
    calm = tiles.window_features(batch(spark, source), SIGNALS)
    forest = iforest.fit_iforest(calm, tiles.feature_names(SIGNALS), ident=["window_start"], trees=10)
    made = jobs.stream_features(stream(spark, source), SIGNALS, lateness="1 minute")
    out = str(tmp_path / "out")
    jobs.run_available(jobs.stream_score(made, forest), out, str(tmp_path / "check"))
    want = iforest.predict(calm, forest)
    got = spark.read.parquet(out)
    assert got.count() >= want.count() - 2
    same(got, want.join(got.select("window_start"), "window_start", "left_semi"))


@pytest.mark.parametrize("k", (1, 3))
def test_sequences(spark, source, tmp_path, k):
    out, tails = str(tmp_path / "out"), str(tmp_path / "tails")
    sink = jobs.sequence_batches(["p", "on"], k, ["ts", "seq"], ["dev"], out, tails)
    jobs.run_batches(stream(spark, source), sink, str(tmp_path / "check"))
    want = tiles.stack_sequences(batch(spark, source), ["p", "on"], k, ["ts", "seq"], ["dev"])
    got = spark.read.parquet(out).drop("batch_id")
    as_text = F.array_join(F.transform("sequence", lambda v: v.cast("string")), ",").alias("s")
    same(got.select("dev", "seq", as_text), want.select("dev", "seq", as_text))


def test_dedupe(spark, tmp_path):
    src = str(tmp_path / "src")
    times = list(pd.date_range("2024-01-01", periods=20, freq="1min"))
    data = pd.DataFrame({"seq": range(40), "ts": times + times, "dev": "a", "p": 0.0, "on": 1.0})
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(src)
    out = str(tmp_path / "out")
    jobs.run_available(jobs.stream_dedupe(stream(spark, src), ["dev"]), out, str(tmp_path / "check"))
    assert spark.read.parquet(out).count() == 20


def test_open_tiles_in_update_mode(spark, source, tmp_path):
    """Every batch replaces the tiles it touches; the last, open ones are there as well."""
    served = stream(spark, source).withColumn("alert", F.col("p") > 1)
    rates_ = jobs.stream_rates(served, lateness="1 minute", keys=["dev"])
    for every in (2, 100):
        sink = stores.KeyedSink(
            str(tmp_path / f"tiles{every}"), rates_.schema, ["dev", "window_start"], every
        )
        jobs.run_batches(rates_, sink.write, str(tmp_path / f"check{every}"), mode="update")
        want = rates.prediction_rates(batch(spark, source).withColumn("alert", F.col("p") > 1), keys=["dev"])
        same(sink.read(spark), want)
        merged = (tmp_path / f"tiles{every}" / "merged").exists()
        assert merged == (every == 2)
    sink.write(sink.read(spark).limit(0), 7)
    assert sink.read(spark).count() == want.count()


def test_repeated_batch_replaces_itself(spark, tmp_path):
    sink = stores.KeyedSink(str(tmp_path / "t"), spark.range(0).selectExpr("id k", "id v").schema, ["k"], merge_every=2)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v long")
    assert sink.read(spark).count() == 0
    sink.write(rows((1, 1), (2, 1)), 0)
    sink.write(rows((2, 2)), 1)
    sink.write(rows((2, 2)), 1)
    sink.write(rows((3, 3)), 2)
    assert sorted(map(tuple, sink.read(spark).collect())) == [(1, 1), (2, 2), (3, 3)]


REPORTS = [
    ("2024-01-01 01:00:00", "2024-01-01 01:20:00"),
    ("2024-01-01 05:00:00", "2024-01-01 05:10:00"),
    ("2024-01-01 01:10:00", "2024-01-01 01:40:00"),
    ("2024-01-01 03:00:00", "2024-01-01 02:59:00"),
]


def report(spark, a, b, dev="hot"):
    frame = pd.DataFrame({"dev": [dev], "start": [pd.Timestamp(a)], "end": [pd.Timestamp(b)]})
    return spark.createDataFrame(frame, "dev string, start timestamp, end timestamp")


@pytest.mark.parametrize("keys, types", [((), ()), (("dev",), ("string",))])
def test_truth_follows_reports(spark, source, tmp_path, keys, types):
    """Overlapping reports in several batches; after each the counts equal a full recount."""
    stored = batch(spark, source).withColumnRenamed("p", "score")
    store = stores.TruthStore(str(tmp_path / "truth"), keys, 0.5, key_types=types)
    store.add_predictions(stored.where("seq < 700"), 0)
    seen = None
    for i, span in enumerate(REPORTS):
        one = report(spark, *span)
        store.write(one, i)
        store.write(one, i)  # a repeated batch changes nothing
        if i == 2:
            store.add_predictions(stored.where("seq >= 700"), 1)
        seen = one if seen is None else seen.unionByName(one)
        rows = stored if i >= 2 else stored.where("seq < 700")
        want = ranking.backfill_performance(rows, seen, 0.5, warn_hours=0.5, keys=list(keys))
        same(store.performance(spark, 0.5), want.drop("at"))


def test_truth_without_reports_or_predictions(spark, source, tmp_path):
    store = stores.TruthStore(str(tmp_path / "truth"), warn_hours=0.5)
    store.write(report(spark, *REPORTS[0]), 0)
    assert store.performance(spark, 0.5).first()["n"] == 0
    store.add_predictions(batch(spark, source).withColumnRenamed("p", "score"), 0)
    assert store.performance(spark, 0.5).first()["n_positives"] > 0


def test_reports_read_only_their_days(spark, tmp_path, plan):
    times = pd.date_range("2024-01-01", periods=400, freq="1h")
    rows = spark.createDataFrame(pd.DataFrame({"ts": times, "score": np.arange(400.0)}))
    store = stores.TruthStore(str(tmp_path / "truth"))
    store.add_predictions(rows, 0)
    store.write(report(spark, "2024-01-03 05:00:00", "2024-01-03 06:00:00"), 0)
    assert store.performance(spark, 0.0).first()["n_positives"] == 4
    days = spark.range(1).selectExpr("date'2024-01-03' day").where("day > date'2024-01-01'")
    touched = store._predictions(spark).join(F.broadcast(days), "day", "left_semi")
    assert "dynamicpruning" in plan(touched) or "PartitionFilters: [isnotnull(day" in plan(touched)


def test_sequences_in_state(spark, source, tmp_path):
    """Rows equal the batch form over four batches, and state outlives a restart."""
    made = jobs.state_sequences(stream(spark, source), ["p", "on"], 3, keys=["dev"])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    jobs.run_available(made, out, check)
    jobs.run_available(made, out, check)
    want = tiles.stack_sequences(batch(spark, source), ["p", "on"], 3, ["ts", "seq"], ["dev"])
    got = spark.read.parquet(out)
    assert got.where("late").count() == 0
    as_text = F.array_join(F.transform("sequence", lambda v: v.cast("string")), ",").alias("s")
    same(got.select("dev", "seq", as_text), want.select("dev", "seq", as_text))


def test_late_and_expired_rows_in_state(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))

    def arrive(*rows):
        data = [(s, pd.Timestamp(t), d, float(s), 0.0) for s, t, d in rows]
        spark.createDataFrame(pd.DataFrame(data, columns=["seq", "ts", "dev", "p", "on"]), SCHEMA).coalesce(1).write.mode("append").parquet(src)
        made = jobs.state_sequences(stream(spark, src), ["p"], 2, keys=["dev"], expiry_hours=2.0)
        jobs.run_available(made, out, check)

    arrive((1, "2024-01-01 00:00", "a"), (2, "2024-01-01 00:10", "a"), (1, "2024-01-01 00:10", "b"))
    arrive((3, "2024-01-01 00:05", "a"), (4, "2024-01-01 00:20", "a"))
    arrive((5, "2024-01-01 05:00", "b"))
    arrive((6, "2024-01-01 09:00", "b"))
    arrive((7, "2024-01-01 09:10", "a"), (8, "2024-01-01 09:20", "a"))
    rows = {(r["dev"], r["seq"]): (r["sequence"], r["late"]) for r in spark.read.parquet(out).collect()}
    assert rows["a", 2] == ([1.0, 2.0], False) and rows["a", 3] == (None, True) and rows["a", 4] == ([2.0, 4.0], False)
    assert ("a", 7) not in rows and rows["a", 8] == ([7.0, 8.0], False)
    with pytest.raises(ValueError):
        jobs.state_sequences(stream(spark, src), ["p"], 2, keys=[])


def test_state_of_many_keys_lies_in_buckets(spark, tmp_path):
    """Calls and state rows are bounded by the buckets, not by the keys; null keys stay apart."""
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    rows = spark.range(1200).selectExpr(
        "id AS seq",
        "timestamp_seconds(1704067200 + id) AS ts",
        "CASE WHEN id % 300 > 0 THEN 9007199254740992 + id % 300 END AS dev",
        "id / 2D AS p",
    )
    for low, high in ((0, 700), (700, 1200)):
        rows.where(f"seq >= {low} AND seq < {high}").write.mode("append").parquet(src)
        made = jobs.state_sequences(spark.readStream.schema(rows.schema).parquet(src), ["p"], 3, keys=["dev"], buckets=4)
        jobs.run_available(made, out, check)
    want = rows.selectExpr(
        "seq", "dev", "lag(p, 2) OVER (PARTITION BY dev ORDER BY seq) AS a", "lag(p) OVER (PARTITION BY dev ORDER BY seq) AS b", "p AS c"
    ).where("a IS NOT NULL")
    got = spark.read.parquet(out).selectExpr("seq", "dev", "sequence[0] AS a", "sequence[1] AS b", "sequence[2] AS c")
    same(got, want)
    assert spark.read.format("statestore").load(check).count() <= 5


def test_drift(spark, source, tmp_path):
    whole = batch(spark, source)
    counts = materialize(drift.sample_counts(whole, ["p"]))
    edges = drift.edges_of_counts(counts, ["p"])
    assert edges == drift.reference_edges(whole, ["p"])
    halves = [drift.sample_counts(whole.where(f"seq % 2 = {i}"), ["p"]) for i in (0, 1)]
    same(drift.merge_counts(*halves), counts)
    out = str(tmp_path / "out")
    shifted = stream(spark, source).withColumn("p", F.when(F.col("seq") < 600, F.col("p")).otherwise(F.col("p") + 5))
    jobs.run_batches(shifted, jobs.drift_batches(counts, ["p"], edges, out), str(tmp_path / "check"))
    flags = {r["batch_id"]: r["drift_detected"] for r in spark.read.parquet(out).collect()}
    assert flags[3] and not all(flags.values())


def payload(*records):
    return json.dumps({"response": {"data": list(records)}})


def test_demand_feed(spark, tmp_path):
    def rec(period, value, respondent="PJM", kind="D"):
        return {"period": period, "respondent": respondent, "type": kind, "value": value}

    texts = [
        payload(rec("2024-01-01T00", "5"), rec("2024-01-01T01", None), rec("2024-01-01T02", "7")),
        payload(rec("2024-01-01T03", "9", kind="DF"), rec("2024-01-01T03", "8", respondent="X")),
        json.dumps({"response": {}}),
        json.dumps({"other": 1}),
    ]
    for i, text in enumerate(texts):
        (tmp_path / f"p{i}.json").write_text(text)
    path = str(tmp_path)
    got = feed.read_demand_feed(spark, path)
    assert [r["period"][-2:] for r in got.collect()] == ["02", "01", "00"]
    assert [r["value"] for r in feed.non_null_values(got).collect()] == [7.0, 5.0]
    assert feed.read_demand_feed(spark, path, length=1).first()["period"] == "2024-01-01T02"
    limited = feed.read_demand_feed(spark, path, start="2024-01-01T01", end="2024-01-01T01")
    assert limited.count() == 1
    with pytest.raises(ValueError):
        feed.read_demand_feed(spark, path, length=0)


def test_reads_and_appends(spark, tmp_path):
    csv = tmp_path / "t.csv"
    csv.write_text("extra,timestamp,on,p\nx,2020-02-01 00:00:00,1.0,2.5\ny,2020-02-01 00:00:10,0.0,\n")
    df = tables.read_telemetry(spark, str(csv), SIGNALS, fmt="csv")
    assert df.columns == ["timestamp", "p", "on"] and [r["p"] for r in df.collect()] == [2.5, None]
    (tmp_path / "bad.csv").write_text("timestamp,p\n2020-02-01 00:00:00,1\n")
    with pytest.raises(ValueError, match="on"):
        tables.read_telemetry(spark, str(tmp_path / "bad.csv"), SIGNALS, fmt="csv")
    nan = spark.createDataFrame([(float("nan"),)], "p double").select(
        F.current_timestamp().alias("timestamp"), "p", F.lit(1.0).alias("on")
    )
    nan.write.parquet(str(tmp_path / "n"))
    assert tables.read_telemetry(spark, str(tmp_path / "n"), SIGNALS).first()["p"] is None
    life = tmp_path / "life.csv"
    life.write_text("model,serial_number,capacity_tb,min_date,max_date,failed\nm,s,4,2020-01-01,2021-01-01,1\n")
    row = tables.read_lifetimes(spark, str(life), fmt="csv").first()
    assert (row["failed"], row["max_date"].year) == (1, 2021)

    history = str(tmp_path / "history")
    record = spark.createDataFrame([("r1", 0.9, "x")], "run string, recall double, at string")
    sinks.append_performance(record, history)
    sinks.append_performance(record.withColumn("run", F.lit("r2")), history)
    got = tables.read_metrics(spark, history)
    assert {(r["run"], r["name"]) for r in got.collect()} == {("r1", "recall"), ("r2", "recall")}

    folds = spark.createDataFrame([("m", 0, 0.8), ("m", 1, 0.6)], "model string, fold int, roc_auc double")
    log = str(tmp_path / "log")
    sinks.log_run_metrics(folds, log, ["roc_auc"], step="fold", params={"freq": "10min"})
    back = spark.read.parquet(log)
    assert [(r["run"], r["step"], r["value"]) for r in back.where("kind = 'param'").collect()] == [("m", None, "10min")]
    best = sinks.leaderboard(back).first()
    assert best["run"] == "m" and np.isclose(best["mean"], 0.7) and best["steps"] == 2
