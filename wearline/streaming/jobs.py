"""Structured Streaming forms of the batch operators; each gives the batch answer."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wearline.operators.contracts import Check, is_valid
from wearline.operators.drift import drift_of_counts, drift_verdict, sample_counts
from wearline.operators.iforest import Forest, predict
from wearline.operators.rates import prediction_rates, score_histogram
from wearline.operators.tiles import Signals, stack_sequences, window_features
from wearline.streaming.stores import put

BatchFunction = Callable[[DataFrame, int], None]


def stream_features(
    stream: DataFrame,
    signals: Signals,
    *,
    ts: str = "ts",
    width: str = "10 minutes",
    min_rows: int = 6,
    lateness: str = "1 hour",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Tumbling features with bounded lateness; in append mode a tile appears once closed."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return window_features(timed, signals, ts=ts, width=width, min_rows=min_rows, keys=keys)


def stream_score(tiles: DataFrame, forest: Forest) -> DataFrame:
    """Prediction records for closed tiles."""
    return predict(tiles, forest)


def stream_rates(
    predictions: DataFrame,
    *,
    ts: str = "ts",
    alert: str = "alert",
    rejected: str | None = None,
    width: str = "5 minutes",
    lateness: str = "1 hour",
    keys: Sequence[str] = (),
) -> DataFrame:
    timed = predictions.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return prediction_rates(timed, ts=ts, alert=alert, rejected=rejected, width=width, keys=keys)


def stream_histogram(
    predictions: DataFrame,
    score: str,
    *,
    ts: str = "ts",
    width: str = "5 minutes",
    lateness: str = "1 hour",
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Cumulative score counts per tile, at ``bounds`` or the usual ones."""
    timed = predictions.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    tiled = timed.withColumn("tile", F.window(ts, width))
    return score_histogram(tiled, score, ["tile"], **({"bounds": bounds} if bounds else {}))


def stream_dedupe(
    stream: DataFrame, keys: Sequence[str], *, ts: str = "ts", lateness: str = "1 hour"
) -> DataFrame:
    """Drop repeats of a reading within the lateness bound."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return timed.dropDuplicatesWithinWatermark([*keys, ts])


def validate_batches(contract: Sequence[Check], accepted: str, quarantined: str) -> BatchFunction:
    """Sink that writes rows in contract to one folder and all others to another."""
    ok = is_valid(contract)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            put(batch.where(ok), accepted, batch_id)
            put(batch.where(~ok), quarantined, batch_id)
        finally:
            batch.unpersist()

    return write


def drift_batches(
    reference: DataFrame,
    features: Sequence[str],
    edges: dict[str, list[float]],
    out: str,
    *,
    method: str = "series",
) -> BatchFunction:
    """Sink that compares each batch with the reference's stored counts, on stored bin edges.

    ``reference`` is a written table of :func:`sample_counts`; the reference's rows are not read again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.take(1):
            return
        found = drift_of_counts(
            reference, sample_counts(batch, features), features, method=method, edges=edges
        )
        put(drift_verdict(found), out, batch_id)

    return write


def sequence_batches(
    features: Sequence[str],
    k: int,
    order: Sequence[str],
    keys: Sequence[str],
    out: str,
    tails: str,
) -> BatchFunction:
    """Sink that extends row sequences over batch borders.

    The last ``k - 1`` rows of every key are kept in a table per batch and put before the
    next batch, so the batch operator, which splits large keys, does all the work. Rows of a
    key must come in order across batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(*keys, *order, *features).withColumn("_new", F.lit(True))
        rows = fresh
        if batch_id > 0 and k > 1:
            kept = spark.read.schema(fresh.schema).parquet(f"{tails}/batch_id={batch_id - 1}")
            rows = fresh.unionByName(kept.withColumn("_new", F.lit(False)))
        rows = rows.persist()
        try:
            stacked = stack_sequences(rows, features, k, order, keys)
            put(stacked.where("_new").select(*keys, *order, "sequence"), out, batch_id)
            newest = Window.partitionBy(*(list(keys) or [F.lit(0)])).orderBy(
                *[F.desc(c) for c in order]
            )
            ranked = rows.withColumn("_rank", F.row_number().over(newest))
            put(ranked.where(F.col("_rank") <= max(k - 1, 1)).drop("_rank"), tails, batch_id)
        finally:
            rows.unpersist()

    return write


def state_sequences(
    stream: DataFrame,
    features: Sequence[str],
    k: int,
    *,
    keys: Sequence[str],
    ts: str = "ts",
    tie: str = "seq",
    lateness: str = "1 hour",
    expiry_hours: float = 24.0,
    buckets: int = 1024,
) -> DataFrame:
    """Row sequences with the last ``k - 1`` rows of every key held in state: ``sequence``, ``late``.

    A row that is not after its key's newest row by (ts, tie) comes out at once, late and without a
    sequence, and changes nothing. Rows behind the watermark are dropped, as by every event-time
    operator. A key without rows for ``expiry_hours`` of event time is forgotten and starts anew. Rows
    before a key's k-th are held only. State is k - 1 rows a key, kept together for the keys of a
    bucket, as a call per key would cost more than its rows; one task holds a bucket's rows of a batch,
    so size batches by the busiest one. ``buckets`` must stay as it is for the life of a checkpoint.
    """
    if k < 1 or not keys:
        raise ValueError("k must be at least 1, and keys are needed")
    width = len(features)
    cells = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    rows = rows.select(*keys, ts, F.col(tie).cast("long").alias(tie), *cells)
    # Keys with nulls have buckets of their own: a column of numbers and nulls would turn to doubles.
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in keys])
    rows = rows.withColumn("_bucket", F.pmod(F.hash(*keys), F.lit(buckets))).withColumn("_nulls", nulls)
    key_schema = "".join(f"{rows.schema[c].simpleString().replace(':', ' ')}, " for c in keys)
    expiry = int(expiry_hours * 3_600_000)

    def follow(_, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}
        now, seen = state.getCurrentWatermarkMs(), set()
        if not state.hasTimedOut:
            chunks = list(chunks)
            frame = chunks[0] if len(chunks) == 1 else pd.concat(chunks, ignore_index=True)
            yield from extend(frame, held, seen, now)
        # Keys without rows in this batch whose time is over.
        for key in [key for key, entry in held.items() if key not in seen and entry[3] < now]:
            del held[key]
        if held:
            state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp(max(min(entry[3] for entry in held.values()), now + 1))
        elif state.exists:
            state.remove()

    def extend(frame: pd.DataFrame, held: dict, seen: set, now: int) -> Iterator[pd.DataFrame]:
        """The batch's rows with their sequences; ``held`` is a key's tail, newest (ts, tie) and end of time."""
        code = frame.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
        times, place = frame[ts].to_numpy(), frame[tie].to_numpy()
        order = np.lexsort((place, times.astype("datetime64[us]").astype("int64"), np.isnat(times), code))
        frame, code, times, place = frame.iloc[order], code[order], times[order], place[order]
        at = times.astype("datetime64[us]").astype("int64")
        values = np.stack([frame[f"_x{i}"].to_numpy(float) for i in range(width)], axis=1)
        sequences, late = [None] * len(at), np.zeros(len(at), bool)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        names = list(zip(*[frame[c].iloc[first].tolist() for c in keys]))
        for name, a, b in zip(names, first.tolist(), [*first[1:].tolist(), len(at)]):
            # Spark counts equal NaN as one key.
            key = tuple("nan" if v != v else v for v in name)
            tail, last_at, last_tie, _ = held.get(key, (np.empty((0, width)), None, None, None))
            seen.add(key)
            if last_at is not None:
                late[a:b] = (at[a:b] < last_at) | ((at[a:b] == last_at) & (place[a:b] <= last_tie))
            fresh = a + np.flatnonzero(~late[a:b])
            if len(fresh):
                grown = np.vstack([tail, values[fresh]])
                numbers = grown.ravel()
                for i, row in enumerate(fresh[max(0, k - 1 - len(tail)) :].tolist()):
                    sequences[row] = numbers[i * width : (i + k) * width]
                tail = grown[len(grown) - min(k - 1, len(grown)) :].copy()
                last_at, last_tie = int(at[fresh[-1]]), int(place[fresh[-1]])
            held[key] = (tail, last_at, last_tie, max(now + 1, last_at // 1000) + expiry)
        out = late | np.array([s is not None for s in sequences])
        if out.any():
            made = frame.loc[out, [*keys, ts, tie]].reset_index(drop=True)
            made["sequence"] = [s for s, wanted in zip(sequences, out) if wanted]
            made["late"] = late[out]
            yield made

    return rows.groupBy("_bucket", "_nulls").applyInPandasWithState(
        follow,
        f"{key_schema}{ts} timestamp, {tie} long, sequence array<double>, late boolean",
        "held binary",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def run_available(df: DataFrame, out: str, checkpoint: str, *, mode: str = "append") -> None:
    """Process everything that is there into parquet files, then stop."""
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    _finish(query)


def run_batches(
    df: DataFrame, function: BatchFunction, checkpoint: str, *, mode: str = "append"
) -> None:
    """Hand everything that is there to a batch function, then stop."""
    query = (
        df.writeStream.foreachBatch(function)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    _finish(query)


def _finish(query: StreamingQuery) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()
