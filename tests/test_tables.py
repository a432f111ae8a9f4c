from datetime import datetime
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from wearline.operators import contracts as ct
from wearline.operators import drift as dr
from wearline.operators import governance as gv
from wearline.operators import lifetimes as lt
from wearline.operators import profile, rates
from wearline.operators.tiles import Signals

SIGNALS = ct.COMPRESSOR_SIGNALS


def sensor(spark, n=20, **changes):
    data = pd.DataFrame({c: 5.0 for c in SIGNALS.all}, index=range(n))
    data[list(ct.COMPRESSOR_STATES)] = 1.0
    data.insert(0, "ts", pd.date_range("2024-01-01", periods=n, freq="10s"))
    data.insert(0, "seq", range(n))
    for column, (row, value) in changes.items():
        data.loc[row, column] = value
    return spark.createDataFrame(data)


def broken(df):
    rows = ct.violations(df, ct.telemetry_contract(), ident=["seq"]).collect()
    return [(r["column"], r["rule"]) for r in rows]


def test_clean_rows_pass(spark):
    assert broken(sensor(spark)) == []


@pytest.mark.parametrize(
    "column,value,rule",
    [
        ("TP2", 99.0, "in_range"),
        ("COMP", 0.5, "binary"),
        ("H1", float("nan"), "not_null"),
        ("ts", pd.NaT, "not_null"),
    ],
)
def test_each_rule(spark, column, value, rule):
    df = sensor(spark, **{column: (3, value)})
    assert broken(df) == [(column, rule)]
    good, bad = ct.split_valid(df, ct.telemetry_contract())
    assert (good.count(), bad.count()) == (19, 1)
    counted = ct.violation_counts(df, ct.telemetry_contract()).collect()
    assert [(r["column"], r["rows"]) for r in counted] == [(column, 1)]


def test_all_failures_or_the_first(spark):
    df = sensor(spark, TP2=(1, 99.0), COMP=(2, 3.0))
    assert len(broken(df)) == 2
    assert ct.violations(df, ct.telemetry_contract(), lazy=False).count() == 1


def test_missing_columns_are_all_named(spark):
    with pytest.raises(ValueError, match="'COMP', 'TP2'"):
        ct.violations(sensor(spark).drop("TP2", "COMP"), ct.telemetry_contract())
    assert broken(sensor(spark).withColumn("more", F.lit("x"))) == []


@pytest.mark.parametrize("size", (10**6, 3))
def test_time_order(spark, size):
    df = sensor(spark)
    assert ct.time_order_violations(df, "ts", "seq", rows_per_bucket=size).count() == 0
    late = df.withColumn("ts", F.when(F.col("seq") == 6, F.to_timestamp(F.lit("2023-01-01"))).otherwise(F.col("ts")))
    assert [r["seq"] for r in ct.time_order_violations(late, "ts", "seq", rows_per_bucket=size).collect()] == [6]
    # Equal times are in order.
    same = df.withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    assert ct.time_order_violations(same, "ts", "seq", rows_per_bucket=size).count() == 0


def test_coerce(spark):
    raw = spark.createDataFrame([("1.5", "a"), ("oops", "b"), (None, "c")], "x string, other string")
    cast, checks = ct.coerce(raw, T.StructType([T.StructField("x", T.DoubleType())]))
    assert [r["x"] for r in cast.orderBy("other").collect()] == [1.5, None, None]
    rows = ct.violations(cast, checks, ident=["other"]).collect()
    assert [(r["other"], r["value"]) for r in rows] == [("b", "oops")]
    with pytest.raises(ValueError, match="missing"):
        ct.coerce(raw, T.StructType([T.StructField("y", T.DoubleType())]))


def test_request_contract(spark):
    def request(df):
        cells = F.collect_list(F.struct(*SIGNALS.all)).alias("readings")
        return ct.request_contract(df.agg(cells)).first()

    assert request(sensor(spark))["accepted"]
    bad = request(sensor(spark, TP2=(3, 99.0), COMP=(4, 0.5)))
    assert not bad["accepted"] and bad["reasons"] == ["TP2:in_range", "COMP:binary"]
    assert request(sensor(spark).limit(0))["reasons"] == ["readings:not_empty"]


def lifetimes(spark, rows):
    schema = "serial_number string, capacity_tb double, model string, min_date timestamp, max_date timestamp, failed int"
    made = [(f"s{i}", 4.0, m, datetime.fromisoformat(a), datetime.fromisoformat(b), f) for i, (m, a, b, f) in enumerate(rows)]
    return spark.createDataFrame(made, schema)


UNITS = [
    ("m1", "2021-06-01", "2022-06-01", 1),  # fails inside the horizon
    ("m1", "2021-06-01", "2024-01-01", 0),  # outlives it
    ("m1", "2021-06-01", "2022-03-01", 0),  # leaves unfailed: censored
    ("m1", "2022-02-01", "2023-01-01", 0),  # starts later
    ("m1", "2020-01-01", "2021-01-01", 1),  # failed before
]


def test_cohort(spark):
    rows = lt.risk_cohort(lifetimes(spark, UNITS)).collect()
    assert sorted(r["y"] for r in rows) == [0, 1]
    assert {r["age_days"] for r in rows} == {214}
    summary = lt.cohort_summary(lt.risk_cohort(lifetimes(spark, UNITS))).first()
    assert (summary["n_units"], summary["n_failures"], summary["failure_rate"]) == (2, 1, 0.5)


def test_afr(spark):
    df = lifetimes(spark, [*UNITS, ("m2", "2020-01-01", "2020-01-01", 1)])
    rates = {r["model"]: r for r in lt.afr(df, min_units=1).collect()}
    assert rates["m1"]["failures"] == 2 and rates["m1"]["afr"] > 0
    # A lifetime of no days counts as one day.
    assert np.isclose(rates["m2"]["afr"], 365.25)
    assert [r["model"] for r in lt.afr(df, min_units=2).collect()] == ["m1"]


def test_lifetime_contract(spark):
    bad = lifetimes(spark, [("m", "2022-01-02", "2022-01-01", 0)])
    found = ct.violations(bad, ct.lifetime_contract()).collect()
    assert [r["rule"] for r in found] == ["not_before_min_date"]
    zero = lifetimes(spark, UNITS).withColumn("capacity_tb", F.lit(0.0))
    assert ct.violations(zero, ct.lifetime_contract()).count() == 0


def test_target_encode(spark):
    train = spark.createDataFrame([("m1", 1), ("m1", 0), ("m2", 0)], "model string, y int")
    other = spark.createDataFrame([("new",), ("m1",)], "model string")
    got = {r["model"]: r["encoded"] for r in lt.target_encode(train, other, "model", "y").collect()}
    assert np.isclose(got["new"], 1 / 3)
    assert np.isclose(got["m1"], (1 + 50 / 3) / 52)


def numpy_psi(ref, cur, bins=10):
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, bins + 1)))
    if len(edges) < 2:
        return 0.0
    inner = edges[1:-1]
    shares = [
        np.maximum(np.bincount(np.searchsorted(inner, x, side="right"), minlength=len(inner) + 1) / len(x), 1e-6)
        for x in (ref, cur)
    ]
    return float(((shares[1] - shares[0]) * np.log(shares[1] / shares[0])).sum())


def sample(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


@pytest.mark.parametrize("size", (10**6, 29))
def test_psi_matches_numpy(spark, size):
    rng = np.random.default_rng(0)
    a, b = np.round(rng.normal(size=400), 1), np.round(rng.normal(0.3, 1, 300), 1)
    shifted = rng.normal(3, 1, 300)
    got = dr.psi(sample(spark, x=a, y=a), sample(spark, x=b, y=shifted), ["x", "y"], rows_per_bucket=size)
    got = {r["feature"]: r["psi"] for r in got.collect()}
    assert np.isclose(got["x"], numpy_psi(a, b)) and np.isclose(got["y"], numpy_psi(a, shifted))
    assert got["y"] > 0.2


def test_psi_edges(spark):
    flat = sample(spark, x=np.ones(50))
    other = sample(spark, x=np.arange(50.0))
    assert dr.psi(flat, other, ["x"]).first()["psi"] == 0.0
    with pytest.raises(ValueError):
        dr.psi(flat.limit(0), other, ["x"])
    with pytest.raises(Exception, match="no current values"):
        dr.psi(other, flat.limit(0), ["x"]).collect()


def test_exact_ks_by_enumeration():
    n, m = 4, 5
    values = np.arange(n + m)
    gaps = []
    for chosen in combinations(range(n + m), n):
        x = np.isin(values, chosen)
        gaps.append(np.abs(np.cumsum(x) / n - np.cumsum(~x) / m).max())
    for d in sorted(set(np.round(gaps, 9))):
        want = np.mean(np.array(gaps) >= d - 1e-9)
        assert np.isclose(dr.exact_ks_tail(d, n, m), want)


def test_exact_and_series_agree_on_large_samples():
    from math import exp, sqrt

    d, n = 0.04, 4000
    en = n / 2
    x = sqrt(en) * d + 1 / (6 * sqrt(en)) + (sqrt(en) * d - 1) / (4 * en)
    series = sum((2 if k % 2 else -2) * exp(-2 * k * k * x * x) for k in range(1, 101))
    assert abs(dr.exact_ks_tail(d, n, n) - series) < 2e-3 * series + 1e-4


@pytest.mark.parametrize("size", (10**6, 29))
def test_ks_distance(spark, size):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(size=300), 1), np.round(rng.normal(0.5, 1, 200), 1)
    row = dr.ks_2samp(sample(spark, x=a), sample(spark, x=b), ["x"], rows_per_bucket=size).first()
    grid = np.union1d(a, b)
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert np.isclose(row["ks_distance"], want)
    assert np.isclose(row["ks_pvalue"], dr.exact_ks_tail(want, 300, 200))


def test_drift_verdict_and_decision(spark):
    rng = np.random.default_rng(2)
    ref = sample(spark, a=rng.normal(size=500), b=rng.normal(size=500))
    cur = sample(spark, a=rng.normal(size=500), b=rng.normal(4, 1, 500))
    verdict = dr.drift_verdict(dr.feature_drift(ref, cur, ["a", "b"]))
    row = verdict.first()
    assert (row["drift_detected"], row["n_drifted"], row["drifted_features"]) == (True, 1, ["b"])
    go = dr.decide_retrain(verdict).first()
    assert go["retrain"] and "b" in go["reason"]
    empty = spark.createDataFrame([(1,)], "other int")
    assert not dr.decide_retrain(empty).first()["retrain"]


def metric_rows(spark, **runs):
    rows = [(run, "v", k, v) for run, m in runs.items() for k, v in m.items()]
    return spark.createDataFrame(rows, "model string, version string, name string, value double")


def test_gates(spark):
    runs = metric_rows(
        spark,
        at={"roc_auc": 0.90, "pr_auc": 0.30, "recall": 0.75},
        below={"roc_auc": 0.80, "pr_auc": 0.30, "recall": 0.75},
        missing={"roc_auc": 0.95, "pr_auc": 0.40},
        nan={"roc_auc": float("nan"), "pr_auc": 0.40, "recall": 0.8},
    )
    got = {r["model"]: r for r in gv.check_gates(runs, ["model"]).collect()}
    assert got["at"]["passed"] and got["nan"]["passed"]
    assert got["below"]["failures"] == ["roc_auc=0.800 < required 0.9"]
    assert got["missing"]["failures"] == ["recall: missing from metrics"]


def test_promotion_rules(spark):
    good = {"roc_auc": 0.95, "pr_auc": 0.4, "recall": 0.8}
    candidates = metric_rows(
        spark,
        first=good,
        gated={**good, "recall": 0.1},
        better={**good, "roc_auc": 0.97},
        worse={**good, "roc_auc": 0.91},
        near={**good, "roc_auc": 0.945},
        keyless=good,
    )
    production = metric_rows(
        spark, **{m: {"roc_auc": 0.95} for m in ("gated", "better", "worse", "near")}, keyless={"recall": 0.9}
    ).drop("version")
    got = {r["model"]: r["promote"] for r in gv.promotion_decision(candidates, production).collect()}
    want = {"first": True, "gated": False, "better": True, "worse": False, "near": True, "keyless": False}
    assert got == want


def log(spark, actions, model="m"):
    rows = [(model, i, a, v) for i, (a, v) in enumerate(actions)]
    return spark.createDataFrame(rows, "model string, seq long, action string, version string")


def test_replay_known(spark):
    actions = [("register", "v1"), ("promote", "v1"), ("register", "v2"), ("promote", "v2"), ("rollback", None)]
    row = gv.replay_audit(log(spark, actions)).first()
    assert (row["production"], row["candidate"], row["n_promotions"], row["n_rollbacks"]) == ("v1", "v2", 2, 1)
    for bad in (
        [("register", "v1"), ("register", "v1")],
        [("promote", "v9")],
        [("register", "v1"), ("promote", "v1"), ("rollback", None)],
    ):
        assert gv.replay_audit(log(spark, bad)).first()["n_invalid"] == 1
        assert gv.invalid_actions(log(spark, bad)).count() == 1


def replay_by_hand(actions):
    known, history, candidate, invalid = set(), [], None, 0
    for action, version in actions:
        if action == "register" and version not in known:
            known.add(version)
            candidate = version
        elif action == "promote" and version in known:
            history.append(version)
        elif action == "rollback" and len(history) > 1:
            history.pop()
        else:
            invalid += 1
    return (history[-1] if history else None), candidate, invalid


@pytest.mark.parametrize("size", (10**6, 23))
def test_replay_random_logs(spark, size):
    rng = np.random.default_rng(11)
    logs, frames = {}, None
    for model, n in (("hot", 400), ("a", 60), ("b", 60)):
        actions = [
            (str(rng.choice(["register", "promote", "rollback", "rollback"])), f"v{rng.integers(0, 9)}")
            for _ in range(n)
        ]
        logs[model] = actions
        part = log(spark, actions, model)
        frames = part if frames is None else frames.unionByName(part)
    for row in gv.replay_audit(frames, rows_per_bucket=size).collect():
        assert (row["production"], row["candidate"], row["n_invalid"]) == replay_by_hand(logs[row["model"]])


def test_thresholds_and_status(spark):
    rows = [("m", 0, "register", "v1", None, None), ("m", 1, "promote", "v1", None, None), ("m", 2, "set_threshold", "v1", "production", 0.4)]
    audit = spark.createDataFrame(rows, "model string, seq long, action string, version string, stage string, threshold double")
    bundles = spark.createDataFrame([("m", "v1", 0.9)], "model string, version string, threshold double")
    state, over = gv.replay_audit(audit), gv.stage_overrides(audit)
    assert gv.effective_threshold(state, bundles, over).first()["threshold"] == 0.4
    assert gv.effective_threshold(state, bundles, over, stage="candidate").first()["threshold"] == 0.9
    metrics = spark.createDataFrame([("m", "v1", "roc_auc", 0.95)], "model string, version string, name string, value double")
    report = gv.status_report(audit, metrics).first()
    assert report["production"]["metrics"] == {"roc_auc": 0.95}
    assert report["production"]["threshold_override"] == 0.4
    assert [r["seq"] for r in gv.latest_entries(audit, 2).collect()] == [1, 2]


def test_profile(spark):
    def metric(df, column, name):
        out = profile.quality_profile(df, SIGNALS, ct.COMPRESSOR_RANGES, seq="seq")
        found = [r["value"] for r in out.collect() if (r["column"], r["metric"]) == (column, name)]
        return found[0] if found else None

    clean = sensor(spark)
    assert metric(clean, "TP2", "out_of_bound_rows") == 0
    assert metric(clean, "TP2", "null_count") is None
    assert metric(clean, "ts", "monotonic") == 1
    assert metric(sensor(spark, TP2=(2, 99.0)), "TP2", "out_of_bound_rows") == 1
    again = clean.withColumn("ts", F.when(F.col("seq") == 5, F.lit(datetime(2024, 1, 1))).otherwise(F.col("ts")))
    assert metric(again, "ts", "duplicate_timestamps") == 1
    assert metric(again, "ts", "monotonic") == 0


def test_profile_by_key_from_one_scan(spark, tmp_path, plan, monkeypatch):
    rows = sensor(spark).crossJoin(spark.range(3).select((F.col("id") * 1000).alias("dev")))
    rows = rows.withColumn("TP2", F.when(F.rand(1) < 0.1, None).otherwise(F.col("TP2") + F.col("dev")))
    rows.write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    written = []
    keep = profile.materialize
    monkeypatch.setattr(profile, "materialize", lambda df: written.append(plan(df)) or keep(df))
    both = [
        profile.quality_profile(raw, SIGNALS, ct.COMPRESSOR_RANGES, seq="seq", keys=["dev"], rows_per_bucket=n).collect()
        for n in (1_000_000, 40)
    ]
    assert sorted(map(tuple, both[0])) == sorted(map(tuple, both[1]))
    assert len(written) == 2 and written[0].count("FileScan") == 1
    for dev in (0, 1000, 2000):
        alone = raw.where(F.col("dev") == dev).drop("dev")
        one = profile.quality_profile(alone, SIGNALS, ct.COMPRESSOR_RANGES, seq="seq")
        mine = sorted((r["column"], r["metric"], r["value"]) for r in both[0] if r["dev"] == dev)
        assert mine == sorted(map(tuple, one.collect()))
    profile_ = profile.quality_profile(raw, SIGNALS, ct.COMPRESSOR_RANGES, seq="seq", keys=["dev"])
    assert str(tmp_path / "raw") not in plan(profile_)
    empty = {(r["column"], r["metric"]): r["value"] for r in profile.quality_profile(
        raw.limit(0), SIGNALS, ct.COMPRESSOR_RANGES, seq="seq").collect()}
    assert empty["ts", "rows"] == 0 and empty["TP2", "out_of_bound_rows"] == 0


def test_stored_sketches_merge_within_their_rank_error(spark):
    df = spark.range(60_000).selectExpr(
        "id % 7 dev", "timestamp'2024-01-01' + make_dt_interval(cast(id % 5 as int)) ts",
        "case when id % 11 = 0 then null when id % 13 = 0 then double('NaN') else double(id * 7919 % 60000) end v",
    )
    stored = profile.quantile_sketches(df, ["v"], keys=["dev"])
    assert stored.count() == 35
    values = np.sort([r["v"] for r in df.where("v is not null and not isnan(v)").select("v").collect()])
    for r in profile.sketched_quantiles(stored, [0.0, 0.1, 0.5, 0.999, 1.0]).collect():
        assert r["n"] == len(values)
        rank = np.searchsorted(values, r["quantile"]) / len(values)
        assert abs(rank - r["prob"]) <= 3 * profile.SKETCH_RANK_ERROR
    per_day = profile.sketched_quantiles(stored, [0.5], ["day", "column"])
    assert per_day.count() == 5 and per_day.agg(F.sum("n")).first()[0] == len(values)


def test_sketched_quantiles(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    got = profile.quantiles(df, ["v"], [0.5], exact=False).first()["quantile"]
    assert abs(got - 5000) <= 2


def test_histogram_and_its_quantile(spark):
    df = spark.createDataFrame([(float(x),) for x in (-0.4, 0.01, 0.03, 0.3, 5.0)], "s double")
    buckets = rates.score_histogram(df, "s")
    counts = {r["le"]: r["n"] for r in buckets.collect()}
    assert counts[-0.3] == 1 and counts[0.02] == 2 and counts[1.0] == 4 and counts[float("inf")] == 5
    # Rank 2.5 lies in (0.02, 0.05], half way.
    assert np.isclose(rates.histogram_quantile(buckets, 0.5).first()["quantile"], 0.035)
    assert rates.histogram_quantile(buckets, 1.0).first()["quantile"] == 1.0
    assert rates.histogram_quantile(buckets, 0.1).first()["quantile"] == -0.3


def test_alert_surge(spark):
    times = pd.date_range("2024-01-01", periods=60, freq="1h")
    data = pd.DataFrame({"ts": np.repeat(times, 20), "alert": False})
    data.loc[data.index % 20 == 0, "alert"] = True
    data.loc[data["ts"] == times[50], "alert"] = True
    out = rates.alert_surge(rates.prediction_rates(spark.createDataFrame(data), width="1 hour"))
    assert [r["window_start"] for r in out.where("alert_surge").collect()] == [times[50].to_pydatetime()]


def test_request_rollup(spark):
    rows = [(datetime(2024, 1, 1), float(i), True) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "started timestamp, latency_ms double, ok boolean")
    row = rates.request_rollup(df).first()
    assert (row["n_requests"], row["p50_ms"], row["p99_ms"], row["max_ms"]) == (100, 50.5, 99.01, 100.0)
    assert not row["passed"] and row["errors"] == 0


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double")
    assert [tuple(r) for r in rates.standardize(df, ["a", "b"]).orderBy("a").collect()] == [(-1, 0), (1, 0)]


def test_signals_are_ordered():
    assert Signals(("a",), ("b",)).all == ("a", "b")
