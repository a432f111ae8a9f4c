"""Structured Streaming forms, run over everything available and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline.operators import drift as drift_ops
from wearline.operators.contracts import telemetry_contract
from wearline.plans import views
from wearline.plans.catalogue.drift import verdict_sql
from wearline.plans.catalogue.base import (
    DEVICE_REPORTS,
    FEATURES,
    ROUNDED,
    STATS,
    TELE,
    clock,
    query,
    r6,
    sql_clock,
    with_,
)
from wearline.session import materialize, scratch_path
from wearline.streaming import jobs, stores

# In append mode a tile is out once the watermark, one hour behind, has passed its end.
CLOSED = "w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM tele) - INTERVAL 1 HOUR"


def _run(spark, df):
    base = scratch_path(spark, "stream")
    jobs.run_available(df, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


def _run_batches(spark, df, function, base):
    jobs.run_batches(df, function, f"{base}/checkpoint")


def replay(spark, slices, base, run):
    """Let the slices arrive one after the other; after each the query goes on from its checkpoint."""
    for rows in slices:
        rows.write.mode("append").parquet(f"{base}/source")
        run(spark.readStream.schema(rows.schema).parquet(f"{base}/source"))


def _replay_updates(spark, slices, name, make, keys):
    """Tiles of a query in update mode, open ones included."""
    base = scratch_path(spark, name)
    sinks = []

    def run(stream):
        made = make(stream)
        sinks[:] = [stores.KeyedSink(f"{base}/tiles", made.schema, keys, merge_every=2)]
        jobs.run_batches(made, sinks[0].write, f"{base}/checkpoint", mode="update")

    replay(spark, slices, base, run)
    return sinks[0].read(spark)


@query(
    "stream_features",
    with_(TELE)
    + f"""SELECT {sql_clock('w')} AS window_start, {ROUNDED} FROM (
  SELECT date_trunc('hour', ts) AS w, {STATS} FROM tele GROUP BY 1 HAVING count(*) >= 6) t WHERE {CLOSED}""",
)
def _stream_features(spark, sf):
    tiles = jobs.stream_features(views.tele_stream(spark, sf), views.SIGNALS, width="1 hour")
    return _run(spark, tiles).select(clock("window_start", "window_start"), *map(r6, FEATURES))


@query(
    "stream_rates",
    with_(TELE)
    + f"""SELECT {sql_clock('w')} AS window_start, predictions, alerts FROM (
  SELECT date_trunc('hour', ts) AS w, count(*) AS predictions, count(CASE WHEN a1 >= 150 THEN 1 END) AS alerts
  FROM tele GROUP BY 1) t WHERE {CLOSED}""",
)
def _stream_rates(spark, sf):
    served = views.tele_stream(spark, sf).withColumn("alert", F.col("a1") >= 150)
    rates = jobs.stream_rates(served, width="1 hour")
    return _run(spark, rates).select(
        clock("window_start", "window_start"), "predictions", "alerts"
    )


@query(
    "stream_histogram",
    with_(TELE)
    + f"""SELECT {sql_clock('w')} AS window_start, le::BIGINT AS le, n FROM (
  SELECT date_trunc('hour', ts) AS w, b.le, count(CASE WHEN a1 <= b.le THEN 1 END) AS n
  FROM tele, (VALUES (50), (100), (1000000)) b(le) GROUP BY 1, 2) t WHERE {CLOSED}""",
)
def _stream_histogram(spark, sf):
    out = jobs.stream_histogram(views.tele_stream(spark, sf), "a1", width="1 hour", bounds=[50.0, 100.0])
    rows = _run(spark, out.select("tile", "le", "n"))
    return rows.select(
        clock("tile.start", "window_start"),
        F.when(F.col("le") == float("inf"), 1_000_000).otherwise(F.col("le")).cast("long").alias("le"),
        "n",
    )


@query(
    "stream_validate",
    with_(TELE)
    + """SELECT CASE WHEN a1 BETWEEN 0 AND 200 AND a2 BETWEEN 0 AND 90 THEN 'accepted' ELSE 'quarantined' END AS side,
  count(*) AS rows FROM tele GROUP BY 1""",
)
def _stream_validate(spark, sf):
    base = scratch_path(spark, "validate")
    contract = telemetry_contract(views.RANGES, views.STATES)
    good, bad = f"{base}/accepted", f"{base}/quarantined"
    _run_batches(spark, views.tele_stream(spark, sf), jobs.validate_batches(contract, good, bad), base)
    both = spark.read.parquet(good).withColumn("side", F.lit("accepted")).unionByName(
        spark.read.parquet(bad).withColumn("side", F.lit("quarantined"))
    )
    return both.groupBy("side").agg(F.count("*").alias("rows"))


@query(
    "stream_rates_live",
    with_(TELE)
    + f"""SELECT {sql_clock('w')} AS window_start, predictions, alerts FROM (
  SELECT date_trunc('hour', ts) AS w, count(*) AS predictions, count(CASE WHEN a1 >= 150 THEN 1 END) AS alerts
  FROM tele GROUP BY 1) t""",
)
def _stream_rates_live(spark, sf):
    slices = [s.withColumn("alert", F.col("a1") >= 150) for s in views.arrivals(spark, sf)]
    rates = _replay_updates(
        spark, slices, "rates", lambda s: jobs.stream_rates(s, width="1 hour"), ["window_start"]
    )
    return rates.select(clock("window_start", "window_start"), "predictions", "alerts")


@query(
    "stream_histogram_live",
    with_(TELE)
    + f"""SELECT {sql_clock('w')} AS window_start, le::BIGINT AS le, n FROM (
  SELECT date_trunc('hour', ts) AS w, b.le, count(CASE WHEN a1 <= b.le THEN 1 END) AS n
  FROM tele, (VALUES (50), (100), (1000000)) b(le) GROUP BY 1, 2) t""",
)
def _stream_histogram_live(spark, sf):
    def make(stream):
        return jobs.stream_histogram(stream, "a1", width="1 hour", bounds=[50.0, 100.0]).select("tile", "le", "n")

    rows = _replay_updates(spark, views.arrivals(spark, sf), "histogram", make, ["tile", "le"])
    return rows.select(
        clock("tile.start", "window_start"),
        F.when(F.col("le") == float("inf"), 1_000_000).otherwise(F.col("le")).cast("long").alias("le"),
        "n",
    )


@query("stream_dedupe", with_(TELE) + "SELECT device, count(DISTINCT ts) AS readings FROM tele GROUP BY 1")
def _stream_dedupe(spark, sf):
    """Every arrival repeats the half hour before it."""
    base = scratch_path(spark, "dedupe")

    def run(stream):
        out = jobs.stream_dedupe(stream.select("device", "ts"), ["device"])
        jobs.run_available(out, f"{base}/out", f"{base}/checkpoint")

    replay(spark, views.arrivals(spark, sf, overlap="30 minutes"), base, run)
    return spark.read.parquet(f"{base}/out").groupBy("device").agg(F.count("*").alias("readings"))


@query(
    "stream_sequences_state",
    with_(TELE)
    + """SELECT seq, round(l2, 6) AS oldest, round(l1, 6) AS previous, round(a1, 6) AS newest FROM (
  SELECT seq, a1, lag(a1) OVER w AS l1, lag(a1, 2) OVER w AS l2, row_number() OVER w AS i FROM tele
  WINDOW w AS (PARTITION BY device ORDER BY ts, seq)) t WHERE i >= 3""",
)
def _stream_sequences_state(spark, sf):
    base = scratch_path(spark, "states")

    def run(stream):
        made = jobs.state_sequences(stream, ["a1"], 3, keys=["device"], expiry_hours=24.0 * 365)
        jobs.run_available(made, f"{base}/out", f"{base}/checkpoint")

    replay(spark, views.arrivals(spark, sf), base, run)
    cell = F.col("sequence")
    rows = spark.read.parquet(f"{base}/out").where(~F.col("late"))
    return rows.select("seq", r6(cell[0], "oldest"), r6(cell[1], "previous"), r6(cell[2], "newest"))


@query(
    "stream_sequences",
    with_(TELE)
    + """SELECT seq, round(l1, 6) AS previous, round(a1, 6) AS newest FROM (
  SELECT seq, a1, lag(a1) OVER w AS l1, row_number() OVER w AS i FROM tele
  WINDOW w AS (PARTITION BY device ORDER BY ts, seq)) t WHERE i >= 2""",
)
def _stream_sequences(spark, sf):
    base = scratch_path(spark, "sequences")
    stream = views.tele_stream(spark, sf).select("device", "ts", "seq", "a1")
    sink = jobs.sequence_batches(["a1"], 2, ["ts", "seq"], ["device"], f"{base}/out", f"{base}/tails")
    _run_batches(spark, stream, sink, base)
    cell = F.col("sequence")
    return spark.read.parquet(f"{base}/out").select("seq", r6(cell[0], "previous"), r6(cell[1], "newest"))


@query(
    "stream_backfill",
    with_(
        TELE,
        DEVICE_REPORTS,
        """labelled AS (SELECT a1, CASE WHEN EXISTS (SELECT 1 FROM device_reports r WHERE r.device = t.device
    AND t.ts >= r.s - INTERVAL 2 HOUR AND t.ts <= r.e) THEN 1 ELSE 0 END AS y FROM tele t)""",
    )
    + """SELECT count(*) AS n, sum(y)::BIGINT AS n_positives, count(CASE WHEN y = 1 AND a1 >= 100 THEN 1 END) AS tp,
  count(CASE WHEN y = 0 AND a1 >= 100 THEN 1 END) AS fp FROM labelled""",
)
def _stream_backfill(spark, sf):
    """Reports come in four batches; each reads only the days it touches."""
    base = scratch_path(spark, "backfill")
    store = stores.TruthStore(f"{base}/truth", ["device"], score="a1", key_types=["long"])
    store.add_predictions(views.tele(spark, sf), 0)
    ends = F.col("ts") + F.make_dt_interval(mins=F.col("a2").cast("int"))
    slices = [
        s.where((F.col("d1") == 1) & (F.col("a1") > 150)).select("device", F.col("ts").alias("start"), ends.alias("end"))
        for s in views.arrivals(spark, sf)
    ]
    replay(spark, slices, base, lambda stream: _run_batches(spark, stream, store.write, base))
    return store.performance(spark, 100.0).select("n", "n_positives", "tp", "fp")


def _later(since: str, until: str | None) -> str:
    upto = f" AND ts < TIMESTAMP '{until}'" if until else ""
    return f"f.feature <> 'd1' AND (ts < TIMESTAMP '{views.CURRENT_FROM}' OR (ts >= TIMESTAMP '{since}'{upto}))"


_SECOND = views.ARRIVALS[-1]


@query(
    "stream_drift",
    f"""SELECT 0::BIGINT AS batch_id, * FROM ({verdict_sql(_later(views.CURRENT_FROM, _SECOND))}) a
UNION ALL SELECT 1::BIGINT, * FROM ({verdict_sql(_later(_SECOND, None))}) b""",
)
def _stream_drift(spark, sf):
    """Two batches against the counts of the first half of the month."""
    base = scratch_path(spark, "drift")
    reference, _ = views.samples(spark, sf)
    counts = materialize(drift_ops.sample_counts(reference, ["a1", "a2"]))
    edges = drift_ops.edges_of_counts(counts, ["a1", "a2"])
    sink = jobs.drift_batches(counts, ["a1", "a2"], edges, f"{base}/out")
    later = views.arrivals(spark, sf, (views.CURRENT_FROM, _SECOND))[1:]
    replay(spark, later, base, lambda stream: _run_batches(spark, stream, sink, base))
    found = spark.read.parquet(f"{base}/out")
    return found.select(F.col("batch_id").cast("long").alias("batch_id"), "drift_detected", "n_drifted")
