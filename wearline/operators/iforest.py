"""Isolation forest: trees built from small samples in parallel, scores by Arrow batches."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from wearline.operators.ordered import exact_quantiles
from wearline.session import materialize

SAMPLE = 256
TREES = 300
CONTAMINATION = 0.02
_SLACK = 1.6
_SPAN = float(2**52)

NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, path double"


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    long = 2.0 * harmonic - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """A fitted detector: node arrays (bounded by trees x sample size) and provenance."""

    nodes: pd.DataFrame
    features: tuple[str, ...]
    sample: int
    offset: float = 0.0
    threshold: float | None = None
    version: str = ""
    metrics: dict[str, float] = field(default_factory=dict)

    @property
    def trees(self) -> int:
        return int(self.nodes["tree"].nunique())


def tree_samples(
    df: DataFrame,
    columns: Sequence[str],
    *,
    ident: Sequence[str],
    total: int,
    trees: int,
    sample: int,
    seed: int,
) -> DataFrame:
    """At most ``sample`` rows for each tree as (tree, point), drawn by seeded hashes.

    The draw depends on the text of a row's identity, not on partitioning or engine. Each row gets a few chances to be
    thrown into some tree, about ``trees * sample`` in all, so most rows of a large table are
    dropped by one hash comparison and never shuffled. A row's chances go to different trees, until
    every tree has had one. Without ``ident`` equal rows are counted first and have the chances
    of all their copies together, so a value weighs as often as it occurs.
    """
    who = digest(*[_as_text(df, c) for c in (ident or df.columns)])
    point = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    rows = df.select(who.alias("who"), point.alias("point"))
    if ident:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    else:
        rows = rows.groupBy("who", "point").agg(F.count("*").alias("copies"))
    served = trees * min(1.0, sample * _SLACK / total)
    expected = F.col("copies") * F.lit(served)
    chances = F.ceil(expected)
    thrown = rows.withColumn("chance", F.explode(F.sequence(F.lit(1).cast("long"), chances)))
    luck = digest("who", "chance", F.lit(seed)) / F.lit(_SPAN)
    thrown = thrown.where(luck < expected / chances)
    # Steps prime to the number of trees visit all of them before one comes again.
    steps = F.array(*[F.lit(k) for k in range(1, trees + 1) if math.gcd(k, trees) == 1])
    start, step = digest("who", F.lit(seed + 1)), digest("who", F.lit(seed + 3))
    chosen = F.element_at(steps, (F.pmod(step, F.size(steps)) + 1).cast("int"))
    tree = F.pmod(F.pmod(start, F.lit(trees)) + F.col("chance") * chosen, F.lit(trees))
    thrown = thrown.withColumn("tree", tree.cast("int"))
    drawn = thrown.withColumn("draw", digest("who", "chance", F.lit(seed + 2)))
    order = Window.partitionBy("tree").orderBy("draw", "who", "chance")
    # The rank limit also runs before the shuffle, so a tree never receives many more rows.
    ranked = drawn.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= sample).select("tree", "rank", "point")


def digest(*parts: str | Column) -> Column:
    """52 bits of the MD5 digest of the parts as text, the same in any engine; null is empty."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 13), 16, 10).cast("long")


def _as_text(df: DataFrame, name: str) -> Column:
    """A column as text; times as microseconds."""
    timed = isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType))
    return F.unix_micros(F.col(name).cast("timestamp")) if timed else F.col(name)


def depth_limit(sample: int) -> int:
    """The depth of a balanced tree over the sample."""
    return max(1, (sample - 1).bit_length())


def _chance(*parts: object) -> int:
    """:func:`digest` of plain values."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def _grow(points: np.ndarray, depth: int, seed: int, tree: int) -> list[tuple]:
    """Rows (node, feature, cut, left, right, path) of one tree; leaves have feature -1.

    A node's choices follow from the digest of its place in the tree: 1 at the root, 2p and 2p + 1 below p.
    """
    rows: list[tuple] = []
    waiting = [(0, 1, np.arange(len(points)), 0)]
    used = 1
    while waiting:
        node, place, members, level = waiting.pop()
        low, high = points[members].min(axis=0), points[members].max(axis=0)
        varied = np.flatnonzero(high > low)
        if level == depth or len(members) < 2 or not len(varied):
            rows.append((node, -1, 0.0, node, node, level + float(mean_path(len(members)))))
            continue
        feature = int(varied[_chance(seed, tree, place, "feature") % len(varied)])
        share = _chance(seed, tree, place, "cut") / _SPAN
        cut = float(low[feature] + share * (high[feature] - low[feature]))
        # Below the maximum, so that both sides get rows.
        cut = float(low[feature]) if cut >= high[feature] else cut
        goes_left = points[members, feature] <= cut
        left, right = used, used + 1
        used += 2
        rows.append((node, feature, cut, left, right, 0.0))
        waiting.append((left, 2 * place, members[goes_left], level + 1))
        waiting.append((right, 2 * place + 1, members[~goes_left], level + 1))
    return rows


def _tree_builder(sample: int, seed: int):
    def build(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        points = np.stack(frame.sort_values("rank")["point"].to_numpy())
        rows = _grow(points, depth_limit(sample), seed, tree)
        out = pd.DataFrame(rows, columns=["node", "feature", "cut", "left", "right", "path"])
        out.insert(0, "tree", tree)
        return out

    return build


def fit_iforest(
    df: DataFrame,
    columns: Sequence[str],
    *,
    ident: Sequence[str] = (),
    trees: int = TREES,
    sample: int = SAMPLE,
    contamination: float | None = CONTAMINATION,
    seed: int = 42,
    version: str = "",
) -> Forest:
    """Fit on (healthy) rows without labels. Without ``contamination`` scores stay raw.

    ``ident`` names columns that identify a row, which saves counting equal rows. A group is one
    tree's sample, so trees grow in parallel in bounded memory. Scaling the columns would
    change nothing, so there is no scaler.
    """
    total = df.count()
    if total == 0:
        raise ValueError("no rows to fit on")
    size = min(sample, total)
    draws = tree_samples(
        df, columns, ident=list(ident), total=total, trees=trees, sample=size, seed=seed
    )
    # The samples are small, and trees cost CPU: spread them over all cores.
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)
    spread = draws.repartition(tasks, "tree")
    built = spread.groupBy("tree").applyInPandas(_tree_builder(size, seed), NODE_SCHEMA)
    # At most trees * (2 * sample - 1) rows.
    nodes = built.toPandas().sort_values(["tree", "node"], ignore_index=True)
    forest = Forest(nodes, tuple(columns), size, version=version)
    return forest if contamination is None else with_offset(forest, df, contamination)


def with_offset(forest: Forest, training: DataFrame, contamination: float) -> Forest:
    """Put 0 at the score that the given share of training rows exceeds."""
    raw = score_iforest(training, replace(forest, offset=0.0), name="_score")
    # Scored once, then read back several times.
    row = exact_quantiles(materialize(raw.select("_score")), "_score", [1.0 - contamination]).first()
    return replace(forest, offset=float(row["quantile"]))


def _arrays(forest: Forest) -> list[tuple[np.ndarray, ...]]:
    """Per tree: split column, cut (infinite at leaves), left child, path length.

    The right child follows the left one, and a leaf is its own left child.
    """
    nodes = forest.nodes.sort_values(["tree", "node"])
    leaf = (nodes["feature"] < 0).to_numpy()
    parts = (
        np.where(leaf, 0, nodes["feature"]).astype(np.intp),
        np.where(leaf, np.inf, nodes["cut"]).astype(float),
        nodes["left"].to_numpy(np.intp),
        nodes["path"].to_numpy(float),
    )
    starts = np.flatnonzero(np.diff(nodes["tree"].to_numpy(), prepend=-1))[1:]
    return list(zip(*[np.split(part, starts) for part in parts]))


def anomaly(
    points: np.ndarray,
    trees: list[tuple[np.ndarray, ...]],
    sample: int,
    sizes: Sequence[int] | None = None,
) -> np.ndarray:
    """2 to the minus mean path over the expected path; higher is more anomalous.

    One column per entry of ``sizes``, using that many first trees. All rows go down one
    level of one tree at a time, in chunks that fit the CPU cache.
    """
    sizes = sorted(sizes or [len(trees)])
    depth = depth_limit(sample)
    expected = max(float(mean_path(sample)), 1e-12)
    out = np.empty((len(points), len(sizes)))
    for start in range(0, len(points), 2048):
        chunk = points[start : start + 2048]
        rows = np.arange(len(chunk))
        flat = np.ascontiguousarray(chunk.T).ravel()
        total = np.zeros(len(chunk))
        for used, (feature, cut, left, path) in enumerate(trees, 1):
            column = feature * len(chunk)
            at = np.zeros(len(chunk), dtype=np.intp)
            for _ in range(depth):
                value = flat.take(column.take(at) + rows)
                at = left.take(at) + (value > cut.take(at))
            total += path.take(at)
            if used in sizes:
                out[start : start + 2048, sizes.index(used)] = np.exp2(-(total / used) / expected)
    return out


def _points(batch: Sequence[pd.Series] | pd.Series) -> np.ndarray:
    # A single column arrives as itself, not as a tuple of one.
    batch = [batch] if isinstance(batch, pd.Series) else batch
    return np.column_stack([np.nan_to_num(s.to_numpy(float)) for s in batch])


def score_iforest(df: DataFrame, forest: Forest, *, name: str = "score") -> DataFrame:
    """Add the anomaly score, 0 at the contamination quantile of the training rows.

    The forest is broadcast once; its size is bounded by trees and sample.
    """
    missing = [c for c in forest.features if c not in df.columns]
    if missing:
        raise ValueError(f"the forest was fitted on columns that the rows lack: {missing}")
    shared = df.sparkSession.sparkContext.broadcast((_arrays(forest), forest.sample, forest.offset))

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees, sample, offset = shared.value
        for batch in batches:
            yield pd.Series(anomaly(_points(batch), trees, sample)[:, 0] - offset)

    return df.withColumn(name, score(*[F.col(c).cast("double") for c in forest.features]))


def score_with_prefixes(df: DataFrame, forest: Forest, sizes: Sequence[int]) -> DataFrame:
    """Raw scores with only the first n trees, as ``score_<n>`` columns, in one walk."""
    sizes = sorted(sizes)
    shared = df.sparkSession.sparkContext.broadcast((_arrays(forest), forest.sample))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees, sample = shared.value
        for batch in batches:
            yield pd.Series(list(anomaly(_points(batch), trees, sample, sizes)))

    scored = df.withColumn("_scores", score(*[F.col(c).cast("double") for c in forest.features]))
    columns = [F.col("_scores")[i].alias(f"score_{n}") for i, n in enumerate(sizes)]
    return scored.select(*df.columns, *columns)


def save_forest(forest: Forest, spark: SparkSession, path: str, metrics: dict | None = None) -> None:
    """Write the node table and a one-row description."""
    spark.createDataFrame(forest.nodes, NODE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/nodes"
    )
    about = [
        (
            list(forest.features),
            forest.sample,
            forest.offset,
            forest.threshold,
            forest.version,
            {k: float(v) for k, v in (forest.metrics if metrics is None else metrics).items()},
        )
    ]
    schema = (
        "features array<string>, sample int, offset double, threshold double, version string, "
        "metrics map<string,double>"
    )
    spark.createDataFrame(about, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_forest(spark: SparkSession, path: str) -> Forest:
    """Read a saved forest; a missing path is an error."""
    from pyspark.errors import AnalysisException

    try:
        about = spark.read.parquet(f"{path}/about").first()
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()
    except AnalysisException as error:
        raise FileNotFoundError(f"no forest at {path}") from error
    nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
    return Forest(
        nodes,
        tuple(about["features"]),
        about["sample"],
        about["offset"],
        about["threshold"],
        about["version"],
        dict(about["metrics"] or {}),
    )


def predict(df: DataFrame, forest: Forest, *, score: str = "anomaly_score") -> DataFrame:
    """Prediction records: score, alert, threshold and model version for each row."""
    from wearline.functions.columns import alert

    limit = forest.threshold if forest.threshold is not None else 0.0
    return score_iforest(df, forest, name=score).select(
        "*",
        alert(score, limit).alias("alert"),
        F.lit(float(limit)).alias("threshold"),
        F.lit(forest.version).alias("model_version"),
    )
