import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wearline.operators import ordered as o

SIZES = (10**6, 97)


@pytest.fixture(scope="module")
def frame(spark):
    """3,000 rows: one key and one timestamp hold over a third each, with many ties."""
    rng = np.random.default_rng(7)
    n = 3000
    data = pd.DataFrame(
        {
            "id": rng.permutation(n),
            "key": np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcde"), n)),
            "ts": np.where(rng.random(n) < 0.4, 500, rng.integers(0, 1000, n)),
            "v": np.round(rng.normal(size=n), 1),
        }
    )
    return data, spark.createDataFrame(data).repartition(7).cache()


@pytest.mark.parametrize("size", SIZES)
def test_row_index(frame, size):
    data, df = frame
    got = o.row_index(df, ["ts", "id"], rows_per_bucket=size).toPandas().sort_values("row_index")
    want = data.sort_values(["ts", "id"])
    assert got["id"].tolist() == want["id"].tolist()
    assert got["row_index"].tolist() == list(range(len(data)))


@pytest.mark.parametrize("size", SIZES)
def test_row_index_per_key(frame, size):
    data, df = frame
    got = o.row_index(df, ["ts", "id"], ["key"], rows_per_bucket=size).toPandas().set_index("id")
    want = data.sort_values(["ts", "id"]).set_index("id").groupby("key").cumcount()
    assert (got["row_index"].loc[want.index] == want).all()


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("keys", ([], ["key"]))
def test_running_sum_min_and_grand_total(frame, size, keys):
    data, df = frame
    got = o.running(
        df,
        ["ts", "id"],
        {"total": ("sum", "v"), "low": ("min", "v"), "top": ("max", "v")},
        keys,
        grand={"whole": "v"},
        rows_per_bucket=size,
    )
    got = got.toPandas().set_index("id")
    s = data.sort_values(["ts", "id"]).set_index("id")
    g = s.groupby(keys[0]) if keys else s.assign(k=0).groupby("k")
    for name, want in (("total", g["v"].cumsum()), ("low", g["v"].cummin()), ("top", g["v"].cummax())):
        assert np.allclose(got[name].loc[s.index], want)
    assert np.allclose(got["whole"].loc[s.index], g["v"].transform("sum"))


def test_nulls_and_nan_in_the_order(spark):
    df = spark.createDataFrame([(None, 1), (float("nan"), 2), (1.0, 4), (-1.0, 8), (3.0, 16)] , "x double, n int")
    for size in (100, 1):
        got = {r["n"]: r["s"] for r in o.running(df, ["x"], {"s": ("sum", "n")}, rows_per_bucket=size).collect()}
        assert got == {1: 1, 8: 9, 4: 13, 16: 29, 2: 31}


def test_plan_has_one_shuffle_after_the_layout(frame, plan):
    _, df = frame
    text = plan(o.row_index(df, ["ts", "id"], ["key"], rows_per_bucket=97))
    # The layout is written; what is left is one shuffle for the windows and a small broadcast.
    assert len(re.findall(r"(?<!Broadcast)Exchange hash", text)) <= 2
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    for spec in re.findall(r"Window \[.*", text):
        assert "_range" in spec


def odd_orders():
    import decimal

    n = 900
    rng = np.random.default_rng(5)
    big = 2**60
    return {
        "text": ("string", [f"é{i % 7}x{i:04d}" for i in rng.permutation(n)]),
        "decimal": ("decimal(38,10)", [decimal.Decimal(int(i)) / 8 for i in rng.permutation(n)]),
        "long": ("long", [big + int(i) for i in rng.permutation(n)]),
        "infinite": ("double", [(float("-inf"), float("inf"), 1.5)[i % 3] for i in range(n)]),
        "missing": ("double", [(None, float("nan"), 0.0, -1.0)[i % 4] for i in range(n)]),
    }


@pytest.mark.parametrize("kind", ("text", "decimal", "long", "infinite", "missing"))
@pytest.mark.parametrize("keys", ([], ["key"]))
def test_ranges_equal_a_plain_window_for_every_type(spark, kind, keys):
    dtype, values = odd_orders()[kind]
    rows = [(i, "hot" if i % 3 else f"k{i % 9}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"id long, key string, x {dtype}").repartition(6)
    cut, plain = (
        {r["id"]: r["row_index"] for r in o.row_index(df, ["x", "id"], keys, rows_per_bucket=size).collect()}
        for size in (70, 10**6)
    )
    assert cut == plain and len(cut) == len(rows)


def test_a_hot_value_with_an_outlier_is_spread(spark):
    rows = [(500, i) for i in range(3999)] + [(500, 10**15)]
    ranged = o.arrange(spark.createDataFrame(rows, "ts long, id long"), ["ts", "id"], rows_per_bucket=400)
    sizes = [r["count"] for r in ranged.frame.groupBy("_range").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 800


def test_a_hot_key_is_spread_and_offsets_stay_few(frame):
    _, df = frame
    ranged = o.arrange(df, ["ts", "id"], ["key"], rows_per_bucket=100)
    sizes = [r["count"] for r in ranged.frame.groupBy("_range").count().collect()]
    assert max(sizes) <= 200
    borders = ranged.frame.groupBy("key").agg(F.count_distinct("_range").alias("n")).where("n > 1")
    assert borders.agg(F.sum("n")).first()[0] <= 2 * len(sizes)


def test_layouts_are_kept_between_passes(frame):
    data, df = frame
    ranged = o.arrange(df, ["ts", "id"], ["key"], rows_per_bucket=97)
    twice = o.add_running(o.add_running(ranged, {"a": ("sum", "v")}), {"b": ("max", "a")})
    got = twice.plain().toPandas().set_index("id")
    s = data.sort_values(["ts", "id"]).set_index("id")
    want = s.groupby("key")["v"].cumsum().groupby(s["key"]).cummax()
    assert np.allclose(got["b"].loc[s.index], want)


@pytest.mark.parametrize("size", SIZES)
def test_quantiles_match_numpy(frame, size):
    data, df = frame
    probs = [0.0, 0.0001, 0.01, 0.37, 0.5, 0.99, 1.0]
    got = {r["prob"]: r["quantile"] for r in o.exact_quantiles(df, "v", probs, rows_per_bucket=size).collect()}
    assert np.allclose([got[p] for p in probs], np.quantile(data["v"], probs))
    per_key = o.exact_quantiles(df, "v", [0.3], ["key"], rows_per_bucket=size).toPandas()
    want = data.groupby("key")["v"].quantile(0.3)
    assert np.allclose(per_key.set_index("key")["quantile"].loc[want.index], want)


@pytest.mark.parametrize("block", (10**6, 11))
def test_frames_cross_blocks(frame, block):
    data, df = frame
    indexed = o.row_index(df, ["ts", "id"], ["key"], name="at")
    got = o.with_frames(
        indexed,
        "at",
        {"m": lambda w: F.sum("v").over(w.rowsBetween(-3, 2))},
        ["key"],
        before=3,
        after=2,
        block_rows=block,
    )
    got = got.toPandas().set_index("id")
    s = data.sort_values(["ts", "id"])
    want = {}
    for _, g in s.groupby("key"):
        v = g["v"].to_numpy()
        for i, ident in enumerate(g["id"]):
            want[ident] = v[max(0, i - 3) : i + 3].sum()
    assert len(got) == len(data)
    assert np.allclose(got["m"], [want[i] for i in got.index])


@pytest.mark.parametrize("size", SIZES)
def test_shifted_neighbours(frame, size):
    data, df = frame
    got = o.shifted(df, ["ts", "id"], {"p": ("v", -1), "q": ("v", 2)}, ["key"], rows_per_bucket=size)
    got = got.toPandas().set_index("id").sort_index()
    s = data.sort_values(["ts", "id"]).set_index("id")
    g = s.groupby("key")["v"]
    pd.testing.assert_series_equal(got["p"], g.shift(1).sort_index(), check_names=False)
    pd.testing.assert_series_equal(got["q"], g.shift(-2).sort_index(), check_names=False)


@pytest.mark.parametrize("size", SIZES)
def test_mean_rank_and_ecdf(frame, size):
    data, df = frame
    ranks = o.mean_rank(df, "v", rows_per_bucket=size).toPandas().set_index("v")["mean_rank"]
    want = data["v"].rank().groupby(data["v"]).first()
    assert np.allclose(ranks.loc[want.index], want)
    shares = o.ecdf(df, "v", rows_per_bucket=size).toPandas().set_index("v")["ecdf"]
    assert np.isclose(shares.max(), 1.0)
    assert np.isclose(shares.loc[0.0], (data["v"] <= 0).mean())


def test_narrowing_keeps_few_values_and_is_exact(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=40_000)
    df = spark.createDataFrame(pd.DataFrame({"_value": v, "k": np.where(v > 2, "x", "y")}))
    probs = [0.0, 0.25, 0.99, 1.0]
    cells = o._count_cells(o._narrow(df, probs, []), [])
    assert cells.count() < 300
    got = o.exact_quantiles(df, "_value", probs, rows_per_bucket=1000).orderBy("prob").toPandas()
    assert np.allclose(got["quantile"], np.quantile(v, probs))
    per_key = o.exact_quantiles(df, "_value", [0.5], ["k"], rows_per_bucket=1000).toPandas().set_index("k")
    assert np.isclose(per_key["quantile"]["x"], np.median(v[v > 2]))
    assert np.isclose(per_key["quantile"]["y"], np.median(v[v <= 2]))


def test_a_missed_bracket_falls_back(spark, monkeypatch):
    """Brackets in the wrong place leave the ranks in gaps; the plain way answers."""
    v = np.arange(5_000.0)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    narrow = o._narrow
    monkeypatch.setattr(o, "_narrow", lambda d, probs, keys: narrow(d, [0.9], keys))
    got = o.exact_quantiles(df, "v", [0.5], rows_per_bucket=100).first()["quantile"]
    assert got == 2499.5


def test_one_type_rule_for_quantiles(spark, monkeypatch):
    """Longs and decimals count as doubles, narrowed or not."""
    df = spark.createDataFrame([(2**53 + i,) for i in range(2000)], "v long")
    want = o.exact_quantiles(df, "v", [0.25, 0.5]).collect()
    monkeypatch.setattr(o, "NARROW_BUCKETS", 1)
    assert o.exact_quantiles(df, "v", [0.25, 0.5], rows_per_bucket=100).collect() == want


def _ranges(df):
    return df.select("_range").distinct().count()


def test_small_ranges_stay_few(spark):
    """More rows make the ranges larger, not more."""
    rows = spark.range(4000).select((F.col("id") * 7919 % 4000).alias("x"))
    ranged = o.arrange(rows, ["x"], rows_per_bucket=5)
    assert ranged.cut and 100 < _ranges(ranged.frame) <= o.MAX_SMALL_RANGES
    indexed = o.row_index(rows, ["x"], rows_per_bucket=5)
    assert indexed.count() == 4000 and indexed.where("x <> row_index").count() == 0


def test_a_long_audit_is_replayed_in_few_ranges(spark):
    """Promotions and rollbacks take turns; files of the steps tell the tasks that walked them."""
    audit = spark.range(3000).selectExpr(
        "'m' || (id % 3) AS model",
        "id AS seq",
        "CASE WHEN id < 30 THEN 'register' WHEN id % 2 = 0 THEN 'promote' ELSE 'rollback' END AS action",
        "'v' || (id % 10) AS version",
    )
    from wearline.operators import governance

    cut, plain = (
        sorted(tuple(r) for r in governance.replay_audit(audit, rows_per_bucket=size).collect())
        for size in (5, 10_000)
    )
    assert cut == plain and len(cut) == 3
    staged = o.arrange(audit, ["seq"], ["model"], rows_per_bucket=5).frame
    assert len(staged.inputFiles()) <= o.MAX_SMALL_RANGES


def test_text_keys_send_few_rows_to_the_driver(spark):
    """The sample for the borders grows with the ranges, so they are few for text as well."""
    rows = spark.range(4000).selectExpr("id", "'s' || (id % 3) AS k", "'priority-' || (id % 5) AS p")
    ranged = o.arrange(rows, ["p", "id"], ["k"], rows_per_bucket=5)
    assert _ranges(ranged.frame) <= o.MAX_SMALL_RANGES
    want = {r["id"]: r["i"] for r in rows.selectExpr("id", "row_number() OVER (PARTITION BY k ORDER BY p, id) - 1 AS i").collect()}
    got = o.row_index(rows, ["p", "id"], ["k"], rows_per_bucket=5)
    assert {r["id"]: r["row_index"] for r in got.collect()} == want
