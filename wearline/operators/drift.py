"""Distribution drift between a reference and a current sample."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wearline.operators.ordered import (
    ROWS_PER_BUCKET,
    count_values,
    exact_quantiles,
    quantiles_of_counts,
    running,
)
from wearline.session import materialize

# Verdict limits, floor of a bin's share.
PSI_LIMIT = 0.2
KS_LIMIT = 0.05
SHARE_FLOOR = 1e-6


def pair_by_feature(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Both samples as (feature, value, is_ref) rows, missing values left out."""

    def long(df: DataFrame, is_ref: bool) -> DataFrame:
        wide = df.select(*[F.col(f).cast("double").alias(f) for f in features])
        rows = wide.unpivot([], list(features), "feature", "value")
        return rows.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn(
            "is_ref", F.lit(is_ref)
        )

    return long(reference, True).unionByName(long(current, False))


def reference_edges(
    reference: DataFrame,
    features: Sequence[str],
    bins: int = 10,
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> dict[str, list[float]]:
    """Distinct reference quantiles per feature: at most ``bins + 1`` numbers each."""
    probs = [float(p) for p in np.linspace(0, 1, bins + 1)]
    values = pair_by_feature(reference, reference.limit(0), features)
    rows = exact_quantiles(values, "value", probs, ["feature"], rows_per_bucket=rows_per_bucket)
    return _edges(rows, features)


def _edges(quantiles: DataFrame, features: Sequence[str]) -> dict[str, list[float]]:
    """Distinct quantiles per feature, a few numbers each."""
    edges: dict[str, set[float]] = {f: set() for f in features}
    for r in quantiles.collect():
        edges[r["feature"]].add(r["quantile"])
    empty = [f for f, e in edges.items() if not e]
    if empty:
        raise ValueError(f"no reference values for {empty}")
    return {f: sorted(e) for f, e in edges.items()}


def _bin(value: Column, edges: Sequence[float]) -> Column:
    """Number of inner edges at or below the value: left-closed bins, open at both ends."""
    out = F.lit(0)
    for edge in edges[1:-1]:
        out = out + (value >= F.lit(edge)).cast("int")
    return out


def psi(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    *,
    bins: int = 10,
    edges: dict[str, list[float]] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Population stability index per feature, on bins of equal reference shares.

    Each row becomes its bin numbers by comparison with literals; the counts are partial
    sums, so only (feature, bin) rows are shuffled. Pass ``edges`` to reuse stored ones.
    """
    edges = edges or reference_edges(reference, features, bins, rows_per_bucket=rows_per_bucket)

    def binned(df: DataFrame, is_ref: bool) -> DataFrame:
        cells = []
        for f in features:
            value = F.col(f).cast("double")
            present = value.isNotNull() & ~F.isnan(value)
            cells.append(F.when(present, _bin(value, edges[f])).alias(f))
        rows = df.select(*cells).unpivot([], list(features), "feature", "bin")
        return (
            rows.where(F.col("bin").isNotNull())
            .groupBy("feature", "bin")
            .agg(F.count("*").alias("n"))
            .withColumn("is_ref", F.lit(is_ref))
        )

    both = binned(reference, True).unionByName(binned(current, False))
    mine, theirs = F.when(F.col("is_ref"), F.col("n")), F.when(~F.col("is_ref"), F.col("n"))
    per_bin = both.groupBy("feature", "bin").agg(
        F.coalesce(F.sum(mine), F.lit(0)).alias("ref"),
        F.coalesce(F.sum(theirs), F.lit(0)).alias("cur"),
    )
    return _index(per_bin, features, edges)


def _index(per_bin: DataFrame, features: Sequence[str], edges: dict[str, list[float]]) -> DataFrame:
    """The index from (feature, bin, ref, cur); a feature has at most as many rows as bins."""
    totals = per_bin.groupBy("feature").agg(
        F.sum("ref").alias("n_ref"),
        F.sum("cur").alias("n_cur"),
        F.collect_list(F.struct("ref", "cur")).alias("cells"),
    )

    def term(c: Column) -> Column:
        r = F.greatest(c["ref"] / F.col("n_ref"), F.lit(SHARE_FLOOR))
        k = F.greatest(c["cur"] / F.col("n_cur"), F.lit(SHARE_FLOOR))
        return (k - r) * F.ln(k / r)

    # Bins empty on both sides add nothing, so they need no rows.
    index = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + term(c))
    flat = [f for f in features if len(edges[f]) < 2]
    checked = F.when(
        F.col("n_cur") == 0,
        F.raise_error(F.concat(F.lit("no current values for "), F.col("feature"))).cast("double"),
    )
    return totals.select(
        "feature", checked.when(F.col("feature").isin(flat), F.lit(0.0)).otherwise(index).alias("psi")
    )


def ks_series(distance: Column, n: Column, m: Column) -> Column:
    """Large-sample p-value of the two-sided two-sample statistic.

    Kolmogorov's series at the effective size n m / (n + m), with the usual second-order
    shift of its argument.
    """
    size = (n.cast("double") * m) / (n + m)
    root = F.sqrt(size)
    x = root * distance + 1.0 / (6.0 * root) + (root * distance - 1.0) / (4.0 * size)
    signs = F.sequence(F.lit(1), F.lit(100))
    total = F.aggregate(
        signs,
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x),
    )
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


# A band of more cells is walked in blocks of steps: step by step at its borders, by convolution between.
WIDE_BAND = 4096


def _walk(mass, base: int, floor, ceiling, rise):
    """Walk rows of ``mass``, whose first cell is position ``base``, a step per entry of the bounds.

    A step stays or goes up by one. Gives the mass after it and what left below and above at each step.
    """
    width = mass.shape[1] + len(floor)
    now, then = np.zeros((2, len(mass), width))
    now[:, : mass.shape[1]] = mass
    moved, stay = np.empty((len(mass), width - 1)), 1.0 - rise
    below, above = np.zeros((2, len(mass), len(floor)))
    for k, (low, high) in enumerate(zip((floor - 1 - base).tolist(), (ceiling + 1 - base).tolist())):
        np.multiply(now[:, :-1], rise, out=moved)
        np.multiply(now, stay, out=then)
        then[:, 1:] += moved
        if 0 <= low < width:
            below[:, k] = then[:, low]
            then[:, low] = 0.0
        if 0 <= high < width:
            above[:, k] = then[:, high]
            then[:, high] = 0.0
        now, then = then, now
    return now, below, above


def _jump(mass, rise, steps: int):
    """Rows of mass after ``steps`` steps, a power of two, without bounds."""
    size = 1 << (mass.shape[1] + steps - 1).bit_length()
    moves = np.stack([1.0 - rise[:, 0], rise[:, 0]], axis=1)
    while moves.shape[1] <= steps:
        moves = np.stack([np.convolve(row, row) for row in moves])
    spread = np.fft.irfft(np.fft.rfft(mass, size) * np.fft.rfft(moves, size), size)
    return spread[:, : mass.shape[1] + steps]


def _weights(cells, step: int, first: float, n: int, m: int, rise: float):
    """Log of each cell's share of full interleavings over the walk's own probability.

    ``cells`` are the cell at ``step``, whose log is ``first``, and those after it, which get theirs.
    """
    at, left = cells[:-1], n + m - step - np.arange(len(cells) - 1)
    up = np.maximum(n - at, 0) / (left * rise)
    stay = np.maximum(left - n + at, 0) / (left * (1.0 - rise))
    with np.errstate(divide="ignore"):
        return first + np.cumsum(np.log(np.where(np.diff(cells) > 0, up, stay)))


def exact_ks_tail(distance: float, n: int, m: int) -> float:
    """Probability that a random interleaving of n and m values reaches ``distance``.

    Walks the interleaving over the splits of each step between both samples, within the band in
    which the distance is not reached, and sums what leaves it. Two walks of independent steps go
    side by side, each drawn to one border, so that rare ways out keep their digits; an exit counts
    by its share of full interleavings. Time grows as n + m times the root of the band's width.
    """
    reach = round(distance * n * m)
    if reach <= 0:
        return 1.0
    total = n + m
    share, pull = n / total, 2.0 * reach / total**2
    rise = np.array([[min(share + pull, (1.0 + share) / 2)], [max(share - pull, share / 2)]])
    up, down = float(rise[0, 0]), float(1.0 - rise[1, 0])

    # After ``t`` values, i of them from the first sample: |i total - t n| < reach.
    def bounds(t):
        return (t * n - reach) // total + 1, -((-t * n - reach) // total) - 1

    low, high = bounds(0)
    wide = high - low >= WIDE_BAND
    steps = 1 << max(4, round(math.log2(8 * (high - low)) / 2)) if wide else 512
    mass = np.zeros((2, high - low + 1))
    mass[:, -low] = 1.0

    def start(cell: int, n: int, m: int, p: float) -> float:
        k = np.arange(cell)
        with np.errstate(divide="ignore"):
            return float(np.log(np.maximum(n - k, 0) / (m + k + 1) * ((1.0 - p) / p)).sum())

    log_up, log_down, lost = start(high + 1, n, m, up), start(1 - low, m, n, down), 0.0
    for step in range(0, total, steps):
        t = np.arange(step, min(step + steps, total) + 1)
        lows, highs = bounds(t)
        low, high, later, top = (int(x) for x in (lows[0], highs[0], lows[-1], highs[-1]))
        k = len(t) - 1
        if wide and k == steps and high - later >= 2 * steps:
            after = np.zeros((2, top - later + 1))
            cut = later - low
            # Up to ``high`` the border above is out of reach; from below ``later`` the one below is not.
            after[:, : high - later + 1] = _jump(mass[:, cut:], rise, k)[:, : high - later + 1]
            ends, _, above = _walk(mass[:, -k:], high - k + 1, lows[1:], highs[1:], rise)
            after[:, high - later + 1 :] = ends[:, k : k + top - high]
            ends, below, _ = _walk(mass[:, :cut], low, lows[1:], highs[1:], rise)
            after[:, :k] += ends[:, cut : cut + k]
            mass = after
        else:
            ends, below, above = _walk(mass, low, lows[1:], highs[1:], rise)
            mass = ends[:, later - low : top - low + 1]
        ups = _weights(highs + 1, step, log_up, n, m, up)
        downs = _weights(t - lows + 1, step, log_down, m, n, down)
        with np.errstate(divide="ignore"):
            out = np.log(np.maximum([above[0], below[1]], 0.0)) + [ups, downs]
        lost += float(np.exp(out).sum())
        log_up, log_down = float(ups[-1]), float(downs[-1])
    return min(1.0, lost)


@F.pandas_udf(T.DoubleType())
def _exact_p(distance: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series(
        [
            exact_ks_tail(d, int(a), int(b))
            for d, a, b in zip(distance, n, m)
        ],
        dtype="float64",
    )


def ks_2samp(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    *,
    method: str = "series",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Two-sample distance and p-value per feature.

    ``series`` is the large-sample p-value, ``exact`` the exact one, each at any size, with a task
    per feature.
    """
    if method not in ("exact", "series"):
        raise ValueError(f"unknown method {method!r}")
    ref, cur = F.col("is_ref").cast("long"), (~F.col("is_ref")).cast("long")
    pairs = pair_by_feature(reference, current, features)
    counts = count_values(pairs, "value", ["feature"], ref=ref, cur=cur)
    return _distance(counts, method, rows_per_bucket)


def _distance(counts: DataFrame, method: str, rows_per_bucket: int) -> DataFrame:
    """Distance and p-value from (feature, value, ref, cur)."""
    steps = running(
        counts,
        ["value"],
        {"_ref": ("sum", "ref"), "_cur": ("sum", "cur")},
        ["feature"],
        grand={"n_ref": "ref", "n_cur": "cur"},
        rows_per_bucket=rows_per_bucket,
    )
    gap = F.abs(F.col("_ref") / F.col("n_ref") - F.col("_cur") / F.col("n_cur"))
    found = steps.groupBy("feature").agg(
        F.max(gap).alias("ks_distance"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur")
    )
    if method == "exact":
        # One row per feature, each in a task of its own for its walk.
        found = materialize(found)
        found = found.repartitionByRange(max(found.count(), 1), "feature")
        p = _exact_p("ks_distance", "n_ref", "n_cur")
    else:
        p = ks_series(F.col("ks_distance"), F.col("n_ref"), F.col("n_cur"))
    return found.select("feature", "ks_distance", p.alias("ks_pvalue"))


def sample_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """A sample as (feature, value, n): one scan, and mergeable by adding ``n`` (:func:`merge_counts`)."""
    pairs = pair_by_feature(df, df.limit(0), features)
    return count_values(pairs, "value", ["feature"])


def merge_counts(*counts: DataFrame) -> DataFrame:
    """The counts of all samples together."""
    rows = reduce(DataFrame.unionByName, counts)
    return rows.groupBy("feature", "value").agg(F.sum("n").alias("n"))


def edges_of_counts(
    counts: DataFrame, features: Sequence[str], bins: int = 10, *, rows_per_bucket: int = ROWS_PER_BUCKET
) -> dict[str, list[float]]:
    """:func:`reference_edges` of a counted sample."""
    probs = [float(p) for p in np.linspace(0, 1, bins + 1)]
    wanted = counts.where(F.col("feature").isin(list(features)))
    rows = quantiles_of_counts(wanted, "value", probs, ["feature"], rows_per_bucket=rows_per_bucket)
    return _edges(rows, features)


def drift_of_counts(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    *,
    method: str = "series",
    bins: int = 10,
    edges: dict[str, list[float]] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """:func:`feature_drift` of two counted samples.

    Both counts are merged and written once; edges, index and distance are read off that table.
    """
    if method not in ("exact", "series"):
        raise ValueError(f"unknown method {method!r}")
    none = F.lit(0).cast("long")
    both = reference.select("feature", "value", F.col("n").alias("ref"), none.alias("cur")).unionByName(
        current.select("feature", "value", none.alias("ref"), F.col("n").alias("cur"))
    )
    both = both.where(F.col("feature").isin(list(features)))
    counts = materialize(
        both.groupBy("feature", "value").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
    )
    if edges is None:
        seen = counts.where(F.col("ref") > 0).select("feature", "value", F.col("ref").alias("n"))
        edges = edges_of_counts(seen, features, bins, rows_per_bucket=rows_per_bucket)
    number = F.lit(None).cast("int")
    for f in features:
        number = F.when(F.col("feature") == f, _bin(F.col("value"), edges[f])).otherwise(number)
    per_bin = counts.groupBy("feature", number.alias("bin")).agg(
        F.sum("ref").alias("ref"), F.sum("cur").alias("cur")
    )
    index = _index(per_bin, features, edges)
    test = _distance(counts, method, rows_per_bucket)
    verdict = (F.col("psi") > PSI_LIMIT) | (F.col("ks_pvalue") < KS_LIMIT)
    return index.join(F.broadcast(test), "feature").select(
        "feature", "psi", "ks_distance", "ks_pvalue", verdict.alias("drifted")
    )


def feature_drift(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    *,
    method: str = "series",
    bins: int = 10,
    edges: dict[str, list[float]] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Index, p-value and verdict per feature, from one count of each sample."""
    return drift_of_counts(
        sample_counts(reference, features),
        sample_counts(current, features),
        features,
        method=method,
        bins=bins,
        edges=edges,
        rows_per_bucket=rows_per_bucket,
    )


def drift_verdict(per_feature: DataFrame) -> DataFrame:
    """One row: whether anything drifted, how many features and which."""
    names = F.sort_array(F.collect_list(F.when(F.col("drifted"), F.col("feature"))))
    return per_feature.agg(
        F.coalesce(F.bool_or("drifted"), F.lit(False)).alias("drift_detected"),
        F.count_if("drifted").alias("n_drifted"),
        names.alias("drifted_features"),
    )


def decide_retrain(verdict: DataFrame) -> DataFrame:
    """Retrain if drift is flagged; a missing flag means no."""
    flag = F.lit(None).cast("boolean")
    if "drift_detected" in verdict.columns:
        flag = F.col("drift_detected")
    names = F.lit("")
    if "drifted_features" in verdict.columns:
        names = F.coalesce(F.array_join("drifted_features", ", "), F.lit(""))
    go = F.coalesce(flag, F.lit(False))
    reason = F.when(go, F.concat(F.lit("moved: "), names)).otherwise(F.lit("no drift found"))
    return verdict.select(go.alias("retrain"), reason.alias("reason"))
