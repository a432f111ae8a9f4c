"""Failure intervals against time: labels, lead times, healthy periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wearline.functions.columns import MICROS_PER_HOUR, alert, hours_between
from wearline.operators.ordered import ROWS_PER_BUCKET, add_running, add_shifted, arrange, exact_quantiles
from wearline.session import MAX_BROADCAST_ROWS, broadcast_if_small

DROP = -1


def events_frame(spark: SparkSession, rows: Sequence[tuple[str, str]]) -> DataFrame:
    """Failure intervals from (start, end) texts."""
    raw = spark.createDataFrame([tuple(r[:2]) for r in rows], "start string, end string")
    return raw.select(F.to_timestamp("start").alias("start"), F.to_timestamp("end").alias("end"))


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _slots(low: Column, high: Column, width: int) -> Column:
    """Every time slot of ``width`` µs touched by the closed interval [low, high]."""
    first, last = F.floor(low / width).cast("long"), F.floor(high / width).cast("long")
    return F.explode(F.sequence(first, last))


def _extent(events: DataFrame, low: Column, high: Column, width: int) -> tuple[int, int]:
    """Number of events, and of the time slots they can touch in all."""
    slots = F.greatest(F.floor((high - low) / width), F.lit(0)) + 2
    row = events.agg(F.count("*"), F.sum(slots)).first()
    return row[0], row[1] or 0


def _small(df: DataFrame, rows_at_most: int) -> DataFrame:
    """Broadcast only what the bound proves small."""
    return F.broadcast(df) if rows_at_most <= MAX_BROADCAST_ROWS else df


def label_segments(
    events: DataFrame,
    *,
    warn_hours: float,
    active: bool,
    keys: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Disjoint labelled time segments [from, to) in µs, per key.

    Overlapping intervals are swept once, so each instant falls in one segment at most and
    labelling needs neither row ids nor a second aggregation. A failure outranks a warning.
    """
    keys = list(keys)
    warn = int(round(warn_hours * MICROS_PER_HOUR))
    start, end = _micros("start"), _micros("end")
    holds = end >= start
    steps = F.array(
        F.struct((start - warn).alias("at"), F.lit(1).alias("w"), F.lit(0).alias("f")),
        F.struct(
            start.alias("at"), F.lit(-1).alias("w"), F.when(holds, 1).otherwise(0).alias("f")
        ),
        # The end is inclusive, and time has µs steps.
        F.when(holds, F.struct((end + 1).alias("at"), F.lit(0).alias("w"), F.lit(-1).alias("f"))),
    )
    points = (
        events.select(*keys, F.inline(F.array_compact(steps)))
        .groupBy(*keys, "at")
        .agg(F.sum("w").alias("w"), F.sum("f").alias("f"))
    )
    laid = arrange(points, ["at"], keys, rows_per_bucket=rows_per_bucket)
    swept = add_running(laid, {"warnings": ("sum", "w"), "failures": ("sum", "f")})
    spans = add_shifted(swept, {"until": ("at", 1)}, rows_per_bucket=rows_per_bucket)
    label = (
        F.when(F.col("failures") > 0, F.lit(1 if active else DROP))
        .when(F.col("warnings") > 0, F.lit(1))
        .otherwise(F.lit(0))
    )
    labelled = spans.select(
        *keys, F.col("at").alias("from"), F.col("until").alias("to"), label.alias("label")
    )
    return labelled.where((F.col("label") != 0) & F.col("to").isNotNull())


def interval_labels(
    df: DataFrame,
    events: DataFrame,
    *,
    ts: str = "window_start",
    warn_hours: float = 2.0,
    active: bool = True,
    keys: Sequence[str] = (),
    name: str = "label",
    slot_hours: float = 24.0,
    sweep: bool | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """1 in the lead-in ``[start - warn, start)``; inside a failure 1, or -1 unless ``active``.

    With segments few enough to broadcast (or ``sweep`` False), an equi join on (keys, time slot) with the
    segment bounds as residual condition, a hash lookup per row. Otherwise (or ``sweep`` True) rows and segment borders
    are laid out together by time, and the label in force is carried from border to row and over
    ranges, so that neither a key nor a day with most of the rows meets in one task.
    """
    keys = list(keys)
    width = int(slot_hours * MICROS_PER_HOUR)
    warn = int(round(warn_hours * MICROS_PER_HOUR))
    segments = label_segments(
        events,
        warn_hours=warn_hours,
        active=active,
        keys=keys,
    )
    small = False
    if sweep is None:
        n, slots = _extent(events, _micros("start") - warn, _micros("end"), width)
        # An event adds at most three segment borders, each of which repeats one slot.
        small = slots + 3 * n <= MAX_BROADCAST_ROWS
        sweep = not small
    if sweep:
        return _swept_labels(df, segments, ts, keys, name, rows_per_bucket)
    slotted = segments.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("from").alias("_from"),
        F.col("to").alias("_to"),
        F.col("label").alias("_label"),
        _slots(F.col("from"), F.col("to") - 1, width).alias("_slot"),
    )
    timed = df.withColumn("_at", _micros(ts)).withColumn(
        "_here", F.floor(F.col("_at") / width).cast("long")
    )
    match = (
        (F.col("_here") == F.col("_slot"))
        & (F.col("_at") >= F.col("_from"))
        & (F.col("_at") < F.col("_to"))
    )
    for k in keys:
        match = match & (F.col(k) == F.col(f"_k_{k}"))
    joined = timed.join(F.broadcast(slotted) if small else slotted, match, "left")
    return joined.select(*df.columns, F.coalesce("_label", F.lit(0)).cast("int").alias(name))


def _swept_labels(
    df: DataFrame, segments: DataFrame, ts: str, keys: Sequence[str], name: str, rows_per_bucket: int
) -> DataFrame:
    """Labels as the running sum of the steps at segment borders, which come before rows of their time.

    Segments are disjoint per key, so the sum is the label in force. Equal times are spread by a hash of
    the row; rows without time or key have label 0.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    plain = [c for c, t in df.dtypes if not t.startswith(("map", "array", "struct"))]
    timed = df.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        _micros(ts).alias("_at"),
        F.lit(1).alias("_kind"),
        F.xxhash64(*plain).alias("_tie"),
        F.lit(0).alias("_step"),
        row.alias("_row"),
    )
    steps = F.array(
        F.struct(F.col("from").alias("_at"), F.col("label").alias("_step")),
        F.struct(F.col("to").alias("_at"), (-F.col("label")).alias("_step")),
    )
    borders = segments.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.inline(steps))
    for k in keys:
        borders = borders.where(F.col(f"_k_{k}").isNotNull())
    borders = borders.select(
        *[f"_k_{k}" for k in keys],
        "_at",
        F.lit(0).alias("_kind"),
        F.lit(0).cast("long").alias("_tie"),
        "_step",
        F.lit(None).cast(timed.schema["_row"].dataType).alias("_row"),
    )
    order = ["_at", "_kind", "_tie"]
    laid = arrange(
        timed.unionByName(borders), order, [f"_k_{k}" for k in keys], rows_per_bucket=rows_per_bucket
    )
    found = add_running(laid, {"_label": ("sum", "_step")}).plain().where(F.col("_kind") == 1)
    label = F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.coalesce("_label", F.lit(0)))
    return found.select("_row.*", label.cast("int").alias(name))


def drop_sentinel(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) != DROP)


def lead_times(
    df: DataFrame,
    events: DataFrame,
    threshold: float | str,
    *,
    ts: str = "window_start",
    score: str = "score",
    lookback_hours: float = 48.0,
    keys: Sequence[str] = (),
    slot_hours: float = 24.0,
) -> DataFrame:
    """Per event: hours from its first alert in the look-back to its start (null if none),
    and whether any alert falls inside the event. Every event is kept."""
    keys = list(keys)
    width, back = int(slot_hours * MICROS_PER_HOUR), int(round(lookback_hours * MICROS_PER_HOUR))
    identity = [*keys, "start", "end"]
    spans = events.select(*identity).distinct()
    low, high = _micros("start") - back, F.greatest(_micros("start"), _micros("end"))
    _, bound = _extent(events, low, high, width)
    slotted = spans.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        "start",
        "end",
        _slots(low, high, width).alias("_slot"),
    )
    hits = df.where(alert(score, threshold)).select(
        *keys, F.col(ts).cast("timestamp").alias("_ts"), _micros(ts).alias("_at")
    )
    hits = hits.withColumn("_here", F.floor(F.col("_at") / width).cast("long"))
    before = (F.col("_at") >= _micros("start") - back) & (F.col("_at") < _micros("start"))
    during = (F.col("_at") >= _micros("start")) & (F.col("_at") <= _micros("end"))
    match = (F.col("_here") == F.col("_slot")) & (before | during)
    for k in keys:
        match = match & (F.col(k) == F.col(f"_k_{k}"))
    found = (
        hits.join(_small(slotted, bound), match)
        .groupBy(*identity)
        .agg(F.min(F.when(before, F.col("_ts"))).alias("_first"), F.max(during).alias("_during"))
    )
    return events.join(found, identity, "left").select(
        *events.columns,
        hours_between("_first", "start").alias("lead_hours"),
        F.coalesce("_during", F.lit(False)).alias("flagged_during"),
    )


def mark_healthy(
    df: DataFrame,
    events: DataFrame,
    *,
    ts: str = "window_start",
    keys: Sequence[str] = (),
    name: str = "healthy",
) -> DataFrame:
    """Add whether a row lies strictly before the first failure (of its key).

    A key without failures is healthy throughout.
    """
    keys = list(keys)
    if not keys:
        first = events.agg(F.min(_micros("start"))).first()[0]
        # Folded to a literal bound, which a filter on the flag takes to the scan.
        early = F.lit(True) if first is None else F.col(ts) < F.timestamp_micros(F.lit(first))
        return df.withColumn(name, early)
    firsts = events.groupBy(*keys).agg(F.min("start").alias("_first"))
    joined = df.join(broadcast_if_small(firsts), keys, "left")
    early = F.col("_first").isNull() | (F.col(ts) < F.col("_first"))
    return joined.select(*df.columns, early.alias(name))


def healthy_period(
    df: DataFrame, events: DataFrame, *, ts: str = "window_start", keys: Sequence[str] = ()
) -> DataFrame:
    """Rows strictly before the first failure."""
    marked = mark_healthy(df, events, ts=ts, keys=keys, name="_healthy")
    return marked.where("_healthy").drop("_healthy")


def label_free_threshold(
    df: DataFrame,
    events: DataFrame,
    *,
    score: str = "score",
    q: float = 0.99,
    ts: str = "window_start",
    keys: Sequence[str] = (),
) -> DataFrame:
    """The ``q`` quantile of healthy-period scores, per key."""
    calm = healthy_period(df, events, ts=ts, keys=keys)
    return exact_quantiles(calm, score, [q], keys).select(
        *keys, F.col("quantile").alias("threshold")
    )


def threshold_value(
    df: DataFrame, events: DataFrame, *, score: str = "score", q: float = 0.99, ts: str = "window_start"
) -> float:
    """:func:`label_free_threshold` without keys, as a number."""
    return label_free_threshold(df, events, score=score, q=q, ts=ts).first()["threshold"]
