"""Tiles, requests, labels, lead times, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from wearline.operators import labels, splits, tiles as tile_ops
from wearline.operators.ordered import exact_quantiles, row_index
from wearline.plans import views
from wearline.plans.catalogue.base import (
    DEVICE_REPORTS,
    FEATURES,
    HOUR_US,
    ORACLES,
    REPORTS,
    ROUNDED,
    SCORED,
    STATS,
    TELE,
    TILES,
    big,
    clock,
    query,
    r6,
    sql_clock,
    with_,
)


@query(
    "window_features",
    with_(TELE, TILES) + f"SELECT {sql_clock('ws')} AS window_start, {ROUNDED} FROM tiles",
)
def _window_features(spark, sf):
    return views.tiles(spark, sf).select(clock("window_start", "window_start"), *map(r6, FEATURES))


@query(
    "window_features_fleet",
    with_(TELE)
    + f"""SELECT device, {sql_clock("date_trunc('day', ts)")} AS window_start, {ROUNDED} FROM (
  SELECT device, date_trunc('day', ts) AS ts, {STATS} FROM tele GROUP BY 1, 2) t""",
)
def _window_features_fleet(spark, sf):
    out = tile_ops.window_features(
        views.tele(spark, sf), views.SIGNALS, width="1 day", min_rows=1, keys=["device"]
    )
    return out.select("device", clock("window_start", "window_start"), *map(r6, FEATURES))


@query(
    "request_features",
    with_(TELE)
    + f"SELECT request, n_samples, {ROUNDED} FROM (SELECT seq // 8 AS request, count(*) AS n_samples, {STATS} FROM tele GROUP BY 1) t",
)
def _request_features(spark, sf):
    out = tile_ops.aggregate_request(views.requests(spark, sf), views.SIGNALS)
    return out.select("request", "n_samples", *map(r6, FEATURES))


@query(
    "hourly_downsample",
    with_(TELE)
    + f"""SELECT {sql_clock("date_trunc('hour', ts)")} AS hour, round(avg(a1), 6) AS a1 FROM tele
GROUP BY date_trunc('hour', ts)""",
)
def _hourly_downsample(spark, sf):
    out = tile_ops.downsample(views.tele(spark, sf), "a1", ts="ts", width="1 hour")
    return out.select(clock("ts", "hour"), r6("a1"))


def _label_sql(source: str, at: str, reports: str, warn: int, inside: int, match: str = "true") -> str:
    return f"""CASE WHEN EXISTS (SELECT 1 FROM {reports} r WHERE {match} AND {at} >= r.s AND {at} <= r.e) THEN {inside}
       WHEN EXISTS (SELECT 1 FROM {reports} r WHERE {match} AND {at} >= r.s - INTERVAL {warn} HOUR AND {at} < r.s) THEN 1
       ELSE 0 END"""


@query(
    "interval_labels",
    with_(TELE, TILES, REPORTS)
    + f"SELECT {sql_clock('ws')} AS window_start, CAST({_label_sql('tiles', 'ws', 'reports', 2, 1)} AS BIGINT) AS label FROM tiles",
)
def _interval_labels(spark, sf):
    out = labels.interval_labels(views.tiles(spark, sf), views.reports(spark))
    return out.select(clock("window_start", "window_start"), big("label"))


@query(
    "interval_labels_ahead",
    with_(TELE, TILES, REPORTS)
    + f"""SELECT * FROM (SELECT {sql_clock('ws')} AS window_start,
 CAST({_label_sql('tiles', 'ws', 'reports', 24, -1)} AS BIGINT) AS label FROM tiles) t WHERE label <> -1""",
)
def _interval_labels_ahead(spark, sf):
    out = labels.interval_labels(
        views.tiles(spark, sf), views.reports(spark), warn_hours=24, active=False
    )
    kept = labels.drop_sentinel(out)
    return kept.select(clock("window_start", "window_start"), big("label"))


@query(
    "interval_labels_fleet",
    with_(TELE, DEVICE_REPORTS)
    + f"SELECT seq, CAST({_label_sql('tele', 'tele.ts', 'device_reports', 6, -1, 'r.device = tele.device')} AS BIGINT) AS label FROM tele",
)
def _interval_labels_fleet(spark, sf):
    out = labels.interval_labels(
        views.tele(spark, sf),
        views.device_reports(spark, sf),
        ts="ts",
        warn_hours=6,
        active=False,
        keys=["device"],
    )
    return out.select("seq", big("label"))


@query("interval_labels_fleet_swept", ORACLES["interval_labels_fleet"])
def _interval_labels_fleet_swept(spark, sf):
    out = labels.interval_labels(
        views.tele(spark, sf),
        views.device_reports(spark, sf),
        ts="ts",
        warn_hours=6,
        active=False,
        keys=["device"],
        sweep=True,
        rows_per_bucket=500,
    )
    return out.select("seq", big("label"))


_ONE_DAY = """one_day AS (SELECT seq, TIMESTAMP '2024-01-01' + (ts - date_trunc('day', ts)) AS moment FROM tele),
day_reports AS (SELECT moment AS s, moment + to_minutes(CAST(a2 AS INTEGER)) AS e FROM one_day JOIN tele USING (seq)
  WHERE d1 = 1 AND a1 > 220)"""


@query(
    "interval_labels_one_day",
    with_(TELE, _ONE_DAY)
    + f"SELECT seq, CAST({_label_sql('one_day', 'one_day.moment', 'day_reports', 3, -1).replace('HOUR', 'MINUTE')} AS BIGINT) AS label FROM one_day",
)
def _interval_labels_one_day(spark, sf):
    """All rows on one day and no key: rows and borders swept together."""
    rows = views.tele(spark, sf)
    at = F.timestamp_micros(F.unix_micros(F.to_timestamp(F.lit("2024-01-01"))) + F.pmod(F.unix_micros("ts"), F.lit(86_400_000_000)))
    rows = rows.withColumn("ts", at)
    ends = F.col("ts") + F.make_dt_interval(mins=F.col("a2").cast("int"))
    reports = rows.where((F.col("d1") == 1) & (F.col("a1") > 220)).select(F.col("ts").alias("start"), ends.alias("end"))
    out = labels.interval_labels(
        rows, reports, ts="ts", warn_hours=0.05, active=False, sweep=True, rows_per_bucket=500
    )
    return out.select("seq", big("label"))


def lead_sql(reports: str, key: str, match: str, at: str = "h.ts", hits: str = "hits") -> str:
    return f"""SELECT {key}{sql_clock('r.s')} AS start, {sql_clock('r.e')} AS "end",
  round(max(CASE WHEN {at} >= r.s - INTERVAL 48 HOUR AND {at} < r.s
                 THEN (epoch_us(r.s) - epoch_us({at})) / {HOUR_US}.0::DOUBLE END), 6) AS lead_hours,
  coalesce(bool_or({at} >= r.s AND {at} <= r.e), false) AS flagged_during
FROM {reports} r LEFT JOIN {hits} h ON {match}
GROUP BY {key}r.s, r.e"""


@query(
    "lead_times",
    with_(TELE, TILES, REPORTS, "hits AS (SELECT ws AS ts FROM tiles WHERE a1_max >= 230)")
    + lead_sql("reports", "", "true"),
)
def _lead_times(spark, sf):
    out = labels.lead_times(views.tiles(spark, sf), views.reports(spark), 230.0, score="a1_max")
    return out.select(clock("start", "start"), clock("end", "end"), r6("lead_hours"), "flagged_during")


@query(
    "lead_times_fleet",
    with_(TELE, DEVICE_REPORTS, "hits AS (SELECT device, ts FROM tele WHERE a1 >= 100)")
    + lead_sql("device_reports", "r.device, ", "h.device = r.device"),
)
def _lead_times_fleet(spark, sf):
    out = labels.lead_times(
        views.tele(spark, sf),
        views.device_reports(spark, sf),
        100.0,
        ts="ts",
        score="a1",
        keys=["device"],
    )
    return out.select(
        "device", clock("start", "start"), clock("end", "end"), r6("lead_hours"), "flagged_during"
    )


@query(
    "healthy_period",
    with_(TELE, TILES, REPORTS)
    + f"SELECT {sql_clock('ws')} AS window_start, round(a1_mean, 6) AS a1_mean FROM tiles WHERE ws < (SELECT min(s) FROM reports)",
)
def _healthy_period(spark, sf):
    out = labels.healthy_period(views.tiles(spark, sf), views.reports(spark))
    return out.select(clock("window_start", "window_start"), r6("a1_mean"))


@query(
    "healthy_threshold",
    with_(TELE, TILES, REPORTS)
    + "SELECT round(quantile_cont(a1_max, 0.99), 6) AS threshold FROM tiles WHERE ws < (SELECT min(s) FROM reports)",
)
def _healthy_threshold(spark, sf):
    out = labels.label_free_threshold(views.tiles(spark, sf), views.reports(spark), score="a1_max")
    return out.select(r6("threshold"))


@query(
    "healthy_threshold_fleet",
    with_(TELE, DEVICE_REPORTS)
    + """SELECT t.device, round(quantile_cont(a1, 0.99), 6) AS threshold
FROM tele t LEFT JOIN (SELECT device, min(s) AS first FROM device_reports GROUP BY 1) f ON f.device = t.device
WHERE f.first IS NULL OR t.ts < f.first GROUP BY t.device""",
)
def _healthy_threshold_fleet(spark, sf):
    out = labels.label_free_threshold(
        views.tele(spark, sf),
        views.device_reports(spark, sf),
        score="a1",
        ts="ts",
        keys=["device"],
    )
    return out.select("device", r6("threshold"))


@query(
    "quantiles_by_type",
    "\nUNION ALL\n".join(
        f"SELECT event_type, {p}::DOUBLE AS prob, round(quantile_cont(value, {p}), 6) AS quantile FROM events GROUP BY 1"
        for p in (0.0001, 0.01, 0.5, 0.99, 0.9999)
    ),
)
def _quantiles_by_type(spark, sf):
    out = exact_quantiles(
        views.table(spark, sf, "events"), "value", [0.0001, 0.01, 0.5, 0.99, 0.9999], ["event_type"]
    )
    return out.select("event_type", "prob", r6("quantile"))


@query("row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders")
def _row_index(spark, sf):
    rows = views.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return row_index(rows, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_index")


@query(
    "row_index_fleet",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_index FROM events",
)
def _row_index_fleet(spark, sf):
    rows = views.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return row_index(rows, ["ts", "event_id"], ["user_id"]).select("event_id", "row_index")


_FOLD_ROWS = """folded AS (
  SELECT i.seq, f.fold, CASE WHEN i.at < f.size * (f.fold + 1) - 28 THEN 'train'
                             WHEN i.at >= f.size * (f.fold + 1) AND (f.fold = 4 OR i.at < f.size * (f.fold + 2)) THEN 'test' END AS role
  FROM (SELECT seq, row_number() OVER (ORDER BY ts, seq) - 1 AS at FROM tele) i,
       (SELECT range AS fold, (SELECT count(*) FROM tele) // 6 AS size FROM range(5)) f)"""


def _folds(spark, sf):
    # About 14 readings an hour, two hours of look-ahead.
    embargo = splits.embargo_rows(2.0, 14.0)
    rows = views.tele(spark, sf).select("seq", "ts")
    return splits.assign_folds(rows, ["ts", "seq"], n_splits=5, embargo=embargo)


@query(
    "temporal_folds",
    with_(TELE, _FOLD_ROWS)
    + "SELECT seq, CAST(fold AS BIGINT) AS fold, role FROM folded WHERE role IS NOT NULL",
)
def _temporal_folds(spark, sf):
    return _folds(spark, sf).select("seq", big("fold"), "role")


@query(
    "fold_counts",
    with_(TELE, _FOLD_ROWS)
    + "SELECT CAST(fold AS BIGINT) AS fold, role, count(*) AS n FROM folded WHERE role IS NOT NULL GROUP BY fold, role",
)
def _fold_counts(spark, sf):
    return _folds(spark, sf).groupBy(big("fold"), "role").agg(F.count("*").alias("n"))


@query(
    "stratified_split",
    with_(
        SCORED,
        "sizes AS (SELECT y, count(*) AS n FROM scored GROUP BY y)",
        "goal AS (SELECT CAST(ceil(sum(n) * 0.3) AS BIGINT) AS target, sum(n) AS total FROM sizes)",
        """share AS (SELECT y, CAST(floor(target * n / total) AS BIGINT) AS base,
  target * n / total - floor(target * n / total) AS rest, target FROM sizes, goal)""",
        """allot AS (SELECT y, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, y)
  <= target - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM share)""",
    )
    + """SELECT seq, CAST(s.y AS BIGINT) AS y, row_number() OVER (PARTITION BY s.y
  ORDER BY CAST('0x' || substr(md5('42:' || seq), 1, 13) AS BIGINT), seq) <= k AS is_test
FROM scored s JOIN allot a ON a.y = s.y""",
)
def _stratified_split(spark, sf):
    rows = views.scored(spark, sf).select("seq", "y")
    return splits.stratified_split(rows, "y", 0.3, "seq").select("seq", big("y"), "is_test")


_SEQ_PARTS = ("a1_mean", "a2_std", "d1_mean")


@query(
    "stack_sequences",
    with_(TELE, TILES, "numbered AS (SELECT *, row_number() OVER (ORDER BY ws) AS i FROM tiles)")
    + "\nUNION ALL\n".join(
        f"""SELECT {sql_clock('b.ws')} AS window_start, CAST({k * 3 + j} AS BIGINT) AS pos, round(a.{c}, 6) AS value
FROM numbered b JOIN numbered a ON a.i = b.i - {3 - k} WHERE b.i > 3"""
        for k in range(4)
        for j, c in enumerate(_SEQ_PARTS)
    ),
)
def _stack_sequences(spark, sf):
    out = tile_ops.stack_sequences(views.tiles(spark, sf), _SEQ_PARTS, 4, ["window_start"])
    cells = out.select("window_start", F.posexplode("sequence").alias("pos", "value"))
    return cells.select(clock("window_start", "window_start"), big("pos"), r6("value"))


@query(
    "make_sequences_fleet",
    with_(TELE)
    + """SELECT seq, round(l2, 6) AS oldest, round(l1, 6) AS middle, round(a1, 6) AS newest FROM (
  SELECT seq, a1, lag(a1) OVER w AS l1, lag(a1, 2) OVER w AS l2, row_number() OVER w AS i
  FROM tele WINDOW w AS (PARTITION BY device ORDER BY ts, seq)) t WHERE i >= 3""",
)
def _make_sequences_fleet(spark, sf):
    rows = views.tele(spark, sf).select("device", "ts", "seq", "a1", "d1")
    out = tile_ops.stack_sequences(rows, ["a1", "d1"], 3, ["ts", "seq"], ["device"], nested=True)
    cell = F.col("sequence")
    return out.select(
        "seq", r6(cell[0][0], "oldest"), r6(cell[1][0], "middle"), r6(cell[2][0], "newest")
    )


@query(
    "centered_mean",
    with_(TELE, TILES)
    + f"""SELECT {sql_clock('ws')} AS window_start,
  round(avg(a1_mean) OVER (ORDER BY ws ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING), 6) AS smoothed FROM tiles""",
)
def _centered_mean(spark, sf):
    out = tile_ops.centered_mean(views.tiles(spark, sf), "a1_mean", 12, ["window_start"])
    return out.select(clock("window_start", "window_start"), r6("smoothed"))
