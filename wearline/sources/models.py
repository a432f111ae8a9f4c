"""Fitted models in versioned folders, visible once their commit record is there."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.ml.classification import (
    GBTClassificationModel,
    MultilayerPerceptronClassificationModel,
    RandomForestClassificationModel,
)
from pyspark.sql import DataFrame, SparkSession

from wearline.operators.grid import GridForest
from wearline.operators.iforest import Forest, load_forest, save_forest
from wearline.operators.supervised import Scorer
from wearline.sources.claims import claim, exists

COMMIT_SCHEMA = (
    "version string, kind string, folder string, trained_at string, features array<string>, "
    "scaling map<string,array<double>>, metrics map<string,double>"
)
ISOLATION = "iforest"
_LOADERS = {
    "forest": RandomForestClassificationModel,
    "grid": GridForest,
    "boosted": GBTClassificationModel,
    "network": MultilayerPerceptronClassificationModel,
}


def version_stamp(kind: str, at: datetime | None = None) -> str:
    """Kind and time of training in UTC, to the second."""
    return f"{kind}-{(at or datetime.now(timezone.utc)).astimezone(timezone.utc):%Y%m%d-%H%M%S}"


@dataclass(frozen=True)
class ModelStore:
    """Models below one path. Files go to a folder of their own first; the commit record, one small file per
    version that only one writer can create, names it. What has no record does not exist."""

    spark: SparkSession
    path: str

    def save(
        self,
        model: Forest | Scorer,
        version: str | None = None,
        *,
        metrics: Mapping[str, float] | None = None,
        at: datetime | None = None,
    ) -> str:
        """Store a forest or a fitted scorer; a version that exists is refused."""
        at = at or datetime.now(timezone.utc)
        isolation = isinstance(model, Forest)
        kind = ISOLATION if isolation else model.kind
        version = version or version_stamp(kind, at)
        if exists(self.spark, self._commit(version)):
            raise ValueError(f"version {version} exists")
        folder = f"{version}-{uuid.uuid4().hex}"
        place = f"{self.path}/models/{folder}"
        found = dict(metrics or (model.metrics if isolation else {}))
        if isolation:
            save_forest(replace(model, version=version), self.spark, place, found)
        else:
            model.model.write().save(place)
        record = {
            "version": version,
            "kind": kind,
            "folder": folder,
            "trained_at": at.isoformat(),
            "features": list(model.features),
            "scaling": {} if isolation else {c: list(v) for c, v in (model.scaling or {}).items()},
            "metrics": {k: float(v) for k, v in found.items()},
        }
        if not claim(self.spark, self._commit(version), json.dumps(record) + "\n"):
            raise ValueError(f"version {version} was stored by another writer")
        return version

    def versions(self) -> DataFrame:
        """One row per committed version."""
        if not exists(self.spark, f"{self.path}/commits"):
            return self.spark.createDataFrame([], COMMIT_SCHEMA)
        return self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.path}/commits")

    def load(self, version: str) -> Forest | Scorer:
        """A committed version; one that is missing or not whole is an error."""
        if not exists(self.spark, self._commit(version)):
            raise FileNotFoundError(f"no committed version {version} at {self.path}")
        row = self.spark.read.schema(COMMIT_SCHEMA).json(self._commit(version)).first()
        if row is None or row["folder"] is None:
            raise FileNotFoundError(f"the record of {version} is not whole")
        place = f"{self.path}/models/{row['folder']}"
        if row["kind"] == ISOLATION:
            return load_forest(self.spark, place)
        try:
            model = _LOADERS[row["kind"]].load(place)
        except Exception as error:  # the reader of stored models raises Java errors of many kinds
            if isinstance(error, AnalysisException) or not exists(self.spark, f"{place}/metadata"):
                raise FileNotFoundError(f"the files of {version} are not whole") from error
            raise
        scaling = {c: (v[0], v[1]) for c, v in (row["scaling"] or {}).items()}
        return Scorer(row["kind"], model, tuple(row["features"]), scaling or None)

    def _commit(self, version: str) -> str:
        return f"{self.path}/commits/{version}.json"
