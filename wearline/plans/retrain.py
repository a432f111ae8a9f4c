"""Drift-gated retraining: drift, candidate, gates, decision, audit rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from wearline.operators.drift import decide_retrain, drift_verdict, feature_drift
from wearline.operators.governance import GATES, promotion_decision, replay_audit
from wearline.sources.claims import claim, exists, remove

AUDIT_SCHEMA = (
    "model string, seq long, action string, version string, at string, stage string, threshold double"
)
METRIC_SCHEMA = "model string, version string, name string, value double"


class Refused(RuntimeError):
    """Another writer was faster."""


@dataclass(frozen=True)
class Registry:
    """Append-only audit and metric tables; the state is derived from them."""

    spark: SparkSession
    path: str

    def create(self) -> None:
        for name, schema in (("audit", AUDIT_SCHEMA), ("metrics", METRIC_SCHEMA)):
            empty = self.spark.createDataFrame([], schema)
            empty.write.mode("ignore").parquet(f"{self.path}/{name}")

    def audit(self) -> DataFrame:
        return self.spark.read.schema(AUDIT_SCHEMA).parquet(f"{self.path}/audit")

    def metrics(self) -> DataFrame:
        return self.spark.read.schema(METRIC_SCHEMA).parquet(f"{self.path}/metrics")

    def next_seq(self, model: str) -> int:
        """The number of the model's next entry."""
        last = self.audit().where(F.col("model") == model).agg(F.max("seq")).first()[0]
        return 0 if last is None else last + 1

    def append(
        self, model: str, actions: Sequence[Mapping[str, object]], expected: int | None = None
    ) -> None:
        """Append entries from number ``expected`` on (the next one, if not given).

        The number is claimed by creating a file that must not exist, before anything is written. A second
        writer that decided on the same state is refused with :class:`Refused` and has to look again.
        """
        first = self.next_seq(model) if expected is None else expected
        if not claim(self.spark, self._claim(model, first)):
            raise Refused(f"entry {first} of {model} belongs to another writer")
        if self.next_seq(model) != first:
            raise Refused(f"entry {first} of {model} is not the next one")
        rows = [
            (model, first + i, a["action"], a.get("version"), a.get("at"), a.get("stage"), a.get("threshold"))
            for i, a in enumerate(actions)
        ]
        self.spark.createDataFrame(rows, AUDIT_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{self.path}/audit"
        )

    def release(self, model: str) -> None:
        """Give up the claim of a writer that died before it wrote its entries."""
        path = self._claim(model, self.next_seq(model))
        if exists(self.spark, path):
            remove(self.spark, path)

    def _claim(self, model: str, seq: int) -> str:
        return f"{self.path}/claims/{model.encode().hex()}-{seq}"

    def record_metrics(self, model: str, version: str, metrics: Mapping[str, float]) -> None:
        rows = [(model, version, k, float(v)) for k, v in metrics.items()]
        self.spark.createDataFrame(rows, METRIC_SCHEMA).write.mode("append").parquet(
            f"{self.path}/metrics"
        )

    def production(self, model: str) -> DataFrame:
        """Metric rows of the live version, as (model, name, value)."""
        state = replay_audit(self.audit().where(F.col("model") == model))
        live = state.where(F.col("production").isNotNull()).select(
            "model", F.col("production").alias("version")
        )
        return self.metrics().join(F.broadcast(live), ["model", "version"]).drop("version")


def heal(
    registry: Registry,
    model: str,
    version: str,
    metrics: Mapping[str, float],
    at: str,
    *,
    gates: Mapping[str, float] = GATES,
) -> dict:
    """Judge one candidate, record it, and promote it if it wins.

    A version is registered once: a known one is refused before anything is written.
    """
    spark = registry.spark
    # Read first: entries that others add from here on refuse ours.
    expected = registry.next_seq(model)
    known = (F.col("model") == model) & (F.col("version") == version)
    if registry.audit().where(known & (F.col("action") == "register")).take(1):
        raise ValueError(f"{model} already has a version {version}")
    rows = [(model, version, k, float(v)) for k, v in metrics.items()]
    candidate = spark.createDataFrame(rows, METRIC_SCHEMA)
    decided = promotion_decision(candidate, registry.production(model), gates=gates).first()
    actions = [{"action": "register", "version": version, "at": at, "stage": "candidate"}]
    if decided["promote"]:
        actions.append({"action": "promote", "version": version, "at": at})
    registry.append(model, actions, expected)
    registry.record_metrics(model, version, metrics)
    return decided.asDict()


def retrain_if_drift(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    registry: Registry,
    model: str,
    build: Callable[[], tuple[str, Mapping[str, float]]],
    at: str,
    *,
    gates: Mapping[str, float] = GATES,
) -> dict:
    """Run ``build`` (giving version and metrics) only when a feature has drifted."""
    per_feature = feature_drift(reference, current, features)
    verdict = drift_verdict(per_feature)
    decision = decide_retrain(verdict).first().asDict()
    if not decision["retrain"]:
        return {**decision, "healed": None}
    version, metrics = build()
    return {**decision, "healed": heal(registry, model, version, metrics, at, gates=gates)}
