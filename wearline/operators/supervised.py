"""Supervised models on MLlib, behind one ``fit(train) -> scorer`` shape."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from wearline.operators.grid import find_cuts, fit_grid_forest
from wearline.operators.rates import scaling
from wearline.session import materialize

# A forest's training rows per task, beyond which few large files would leave most tasks idle.
ROWS_PER_TASK = 20_000
# From so many training rows a forest on few features is grown on counted cells. MLlib, too, reads all rows for
# its split points up to here, and a sample beyond.
GRID_ROWS = 10_000


@dataclass(frozen=True)
class Scorer:
    """A fitted model with its columns in order; calling it adds ``score`` to rows."""

    kind: str
    model: Any
    features: tuple[str, ...]
    scaling: Mapping[str, tuple[float, float]] | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.kind == "grid":
            return self.model.score(df)
        out = self.model.transform(_vectors(df, self.features, self.scaling))
        return out.select(*df.columns, vector_to_array("probability")[1].alias("score"))


def _vectors(
    df: DataFrame, features: Sequence[str], moments: Mapping[str, tuple[float, float]] | None = None
) -> DataFrame:
    """The columns as one vector ``_x``, scaled if moments are given."""
    if moments is None:
        return VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    scaled = [(F.col(c) - F.lit(moments[c][0])) / F.lit(moments[c][1]) for c in features]
    return df.withColumn("_x", array_to_vector(F.array(*scaled)))


def class_sizes(df: DataFrame, y: str) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(y) == 0), F.count_if(F.col(y) == 1)).first()
    return row[0], row[1]


def _weights(df: DataFrame, y: str, balanced: bool) -> Column:
    """Balanced weights n / (2 n_class), or failures weighted by the quiet-to-failure ratio."""
    quiet, failing = class_sizes(df, y)
    if balanced:
        total = quiet + failing
        w0, w1 = total / (2 * max(quiet, 1)), total / (2 * max(failing, 1))
    else:
        w0, w1 = 1.0, quiet / max(failing, 1)
    return F.when(F.col(y) == 1, F.lit(w1)).otherwise(F.lit(w0))


def fit_forest(
    train: DataFrame,
    features: Sequence[str],
    y: str = "y",
    *,
    trees: int = 200,
    leaf: int = 5,
    depth: int = 30,
    seed: int = 42,
) -> Scorer:
    """Random forest with balanced classes. MLlib's depth limit is 30.

    Many rows of few features are counted by cell first, see :mod:`wearline.operators.grid`. With MLlib, node
    numbers are cached with the rows, so that no pass sends the trees grown so far to the tasks.
    """
    sizes = class_sizes(train, y)
    if sum(sizes) > GRID_ROWS and min(sizes) > 0:
        weights = [sum(sizes) / (2 * n) for n in sizes]
        cuts = find_cuts(train, features, y, weights)
        if cuts is not None:
            model = fit_grid_forest(
                train, features, y, cuts, weights, trees=trees, leaf=leaf, depth=depth, seed=seed
            )
            return Scorer("grid", model, tuple(features))
    ready = _vectors(train.withColumn("_w", _weights(train, y, True)), features).select("_x", "_w", y)
    tasks = sum(sizes) // ROWS_PER_TASK
    if tasks > 1:
        ready = ready.repartition(tasks)
    model = RandomForestClassifier(
        featuresCol="_x",
        labelCol=y,
        weightCol="_w",
        numTrees=trees,
        minInstancesPerNode=leaf,
        maxDepth=depth,
        cacheNodeIds=True,
        seed=seed,
    ).fit(ready)
    return Scorer("forest", model, tuple(features))


def fit_gbt(
    train: DataFrame,
    features: Sequence[str],
    y: str = "y",
    *,
    rounds: int = 300,
    depth: int = 6,
    rate: float = 0.05,
    subsample: float = 0.8,
    columns: float = 0.8,
    seed: int = 42,
) -> Scorer:
    """Boosted trees with failures weighted up."""
    ready = _vectors(train.withColumn("_w", _weights(train, y, False)), features)
    model = GBTClassifier(
        featuresCol="_x",
        labelCol=y,
        weightCol="_w",
        maxIter=rounds,
        maxDepth=depth,
        stepSize=rate,
        subsamplingRate=subsample,
        featureSubsetStrategy=str(columns),
        seed=seed,
    ).fit(ready)
    return Scorer("boosted", model, tuple(features))


def fit_mlp(
    train: DataFrame,
    features: Sequence[str],
    y: str = "y",
    *,
    hidden: Sequence[int] = (64, 32),
    iterations: int = 400,
    every: int = 20,
    patience: int = 2,
    tail: float = 0.1,
    order: str | None = None,
    seed: int = 42,
) -> Scorer:
    """Neural network on columns standardised by the training rows.

    With ``order``, a column of consecutive row numbers, the last ``tail`` of the rows is held back: training
    goes on in steps of ``every`` iterations from the weights before, and stops once ``patience`` steps
    have not lowered the tail's log loss; the best weights stay. Without it all iterations are run.
    """
    moments = scaling(train, features)
    ready = _vectors(train, features, moments).select(y, "_x", *([order] if order else []))
    network = MultilayerPerceptronClassifier(
        featuresCol="_x", labelCol=y, layers=[len(features), *hidden, 2], maxIter=iterations, seed=seed
    )
    if order is None:
        return Scorer("network", network.fit(ready), tuple(features), moments)
    low, high = ready.agg(F.min(order), F.max(order)).first()
    cut = low + math.floor((1.0 - tail) * (high - low + 1))
    ready = materialize(ready)
    fitting, held = ready.where(F.col(order) < cut), ready.where(F.col(order) >= cut)
    best, least, waited = None, math.inf, 0
    for _ in range(0, iterations, every):
        step = network.copy({network.maxIter: every})
        if best is not None:
            step = step.setInitialWeights(model.weights)
        model = step.fit(fitting)
        loss = _log_loss(model, held, y)
        if best is None or loss < least:
            best, least, waited = model, loss, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return Scorer("network", best, tuple(features), moments)


def _log_loss(model, rows: DataFrame, y: str) -> float:
    p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-12)), F.lit(1.0 - 1e-12))
    loss = -F.when(F.col(y) == 1, F.ln(p)).otherwise(F.ln(1.0 - p))
    return model.transform(rows).agg(F.avg(loss)).first()[0] or 0.0


def spread_sequence(df: DataFrame, length: int, sequence: str = "sequence") -> DataFrame:
    """A flat sequence column as one column per element, for the models above."""
    cells = [F.col(sequence)[i].alias(f"x{i}") for i in range(length)]
    return df.select(*[c for c in df.columns if c != sequence], *cells)
