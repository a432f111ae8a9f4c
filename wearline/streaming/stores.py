"""Stored tables that a stream keeps up to date, batch by batch, without reading its history again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wearline.functions.columns import MICROS_PER_HOUR, alert, ratio
from wearline.operators.cost import curve_of
from wearline.operators.labels import interval_labels
from wearline.operators.ranking import metrics_of

def put(df: DataFrame, path: str, batch: int) -> None:
    """Write one folder per batch, so a repeated batch replaces its own output."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


@dataclass(frozen=True)
class KeyedSink:
    """A table with one row per key, the newest: the sink of queries in update mode.

    Every batch is written on its own. Each ``merge_every`` batches they are merged with the last merged
    table into a new one, so a read takes that table and a few batches at most. A batch that is run
    again replaces itself, and merges are whole or absent, as Spark commits a folder at its end.
    """

    path: str
    schema: T.StructType
    keys: Sequence[str]
    merge_every: int = 16

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        put(batch, f"{self.path}/batches", batch_id)
        if batch_id % self.merge_every == self.merge_every - 1:
            newest = self._newest(spark, batch_id)
            newest.write.mode("overwrite").parquet(f"{self.path}/merged/upto={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest row of every key, without its batch number."""
        return self._newest(spark).drop("batch_id")

    def _newest(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """Rows with the number of the batch that gave them, as of batch ``upto``."""
        numbered = T.StructType([*self.schema, T.StructField("batch_id", T.LongType())])
        batches = _stored(spark, f"{self.path}/batches", numbered)
        merged = _stored(spark, f"{self.path}/merged", T.StructType([*numbered, T.StructField("upto", T.LongType())]))
        if upto is not None:
            batches, merged = batches.where(F.col("batch_id") <= upto), merged.where(F.col("upto") < upto)
        last = merged.agg(F.max("upto")).first()[0]
        if last is None:
            rows = batches
        else:
            fresh = batches.where(F.col("batch_id") > last)
            rows = merged.where(F.col("upto") == last).drop("upto").unionByName(fresh)
        whole = F.struct(*rows.columns)
        return rows.groupBy(*self.keys).agg(F.max_by(whole, "batch_id").alias("_r")).select("_r.*")


def _stored(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A folder of batches; one that was never written has no rows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


@dataclass(frozen=True)
class TruthStore:
    """Truth of stored predictions, kept as counts that failure reports only add to.

    Predictions lie by day, with their counts per (keys, score). A batch of reports reads the days it
    touches, marks the predictions that it covers and no earlier report did, and adds their counts
    per score as new positives. Performance comes from the counts alone.
    """

    path: str
    keys: Sequence[str] = ()
    warn_hours: float = 2.0
    ts: str = "ts"
    score: str = "score"
    key_types: Sequence[str] = field(default=())  # one SQL type per key

    @property
    def _key_schema(self) -> str:
        return "".join(f"{k} {t}, " for k, t in zip(self.keys, self.key_types))

    def _table(self, spark: SparkSession, name: str, columns: str) -> DataFrame:
        return _stored(spark, f"{self.path}/{name}", self._key_schema + columns)

    def _predictions(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "predictions", f"{self.ts} timestamp, {self.score} double, part int, day date")

    def _reports(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "reports", "start timestamp, end timestamp, batch_id long")

    def add_predictions(self, rows: DataFrame, part: int) -> None:
        """Store predictions under their part number; reports that are already known label them too."""
        spark = rows.sparkSession
        kept = rows.select(
            *self.keys, F.col(self.ts).cast("timestamp").alias(self.ts), F.col(self.score).cast("double").alias(self.score)
        )
        laid = kept.withColumn("day", F.to_date(self.ts))
        laid.write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/predictions/part={part}")
        mine = self._predictions(spark).where(F.col("part") == part)
        counts = mine.groupBy(*self.keys, self.score).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{self.path}/counts/part={part}")
        known = self._reports(spark)
        if known.take(1):
            hit = self._covered(mine, known, "_y")
            self._positives(hit.where("_y = 1")).write.mode("overwrite").parquet(
                f"{self.path}/positives/source=part-{part}"
            )

    def _covered(self, rows: DataFrame, reports: DataFrame, name: str) -> DataFrame:
        return interval_labels(
            rows, reports, ts=self.ts, warn_hours=self.warn_hours, active=True, keys=self.keys, name=name
        )

    def _positives(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys, self.score).agg(F.count("*").alias("pos"))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch of failure reports (keys, start, end). Days no report touches are not read."""
        spark = batch.sparkSession
        put(batch.select(*self.keys, "start", "end"), f"{self.path}/reports", batch_id)
        seen = self._reports(spark)
        fresh = seen.where(F.col("batch_id") == batch_id).drop("batch_id")
        first = F.timestamp_micros(F.unix_micros("start") - int(self.warn_hours * MICROS_PER_HOUR))
        spans = fresh.where(F.col("end") >= first).select(first.alias("first"), "end")
        days = spans.select(F.explode(F.sequence(F.to_date("first"), F.to_date("end"))).alias("day")).distinct()
        extent = spans.agg(F.min("first").alias("first"), F.max("end").alias("last")).first()
        if extent["first"] is None:
            return
        # One row per day; the join prunes the other days' folders.
        touched = self._predictions(spark).join(F.broadcast(days), "day", "left_semi")
        earlier = seen.where(
            (F.col("batch_id") < batch_id) & (F.col("end") >= F.lit(extent["first"])) & (first <= F.lit(extent["last"]))
        )
        new = self._covered(touched, fresh, "_new").where("_new = 1")
        added = self._covered(new, earlier.drop("batch_id"), "_old").where("_old = 0")
        self._positives(added).write.mode("overwrite").parquet(f"{self.path}/positives/source=batch-{batch_id}")

    def score_counts(self, spark: SparkSession) -> DataFrame:
        """Quiet and failing predictions per (keys, score): ``pos`` and ``neg``."""
        counts = self._table(spark, "counts", f"{self.score} double, n long, part int")
        added = self._table(spark, "positives", f"{self.score} double, pos long, source string")
        both = counts.select(*self.keys, self.score, "n", F.lit(0).cast("long").alias("pos")).unionByName(
            added.select(*self.keys, self.score, F.lit(0).cast("long").alias("n"), "pos")
        )
        summed = both.groupBy(*self.keys, self.score).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        return summed.withColumn("neg", F.col("n") - F.col("pos"))

    def performance(self, spark: SparkSession, threshold: float) -> DataFrame:
        """One row: counts, precision, recall and ``roc_auc`` over everything stored."""
        rows = self.score_counts(spark)
        hit, pos, neg = alert(self.score, threshold), F.col("pos"), F.col("neg")
        parts = (("tp", hit, pos), ("fp", hit, neg), ("fn", ~hit, pos), ("tn", ~hit, neg))
        counts = rows.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            *[F.coalesce(F.sum(F.when(which, what)), F.lit(0)).alias(name) for name, which, what in parts],
        )
        # A missing score is below every cutoff.
        merged = rows.groupBy(F.when(~F.isnan(self.score), F.col(self.score)).alias("_score"))
        ranks = metrics_of(curve_of(merged.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), []))
        # Two one-row results.
        return counts.join(F.broadcast(ranks.select("roc_auc")), F.lit(True), "left").select(
            "n",
            (F.col("tp") + F.col("fn")).alias("n_positives"),
            *[name for name, _, _ in parts],
            ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
            ratio("tp", F.col("tp") + F.col("fn")).alias("recall"),
            "roc_auc",
        )

