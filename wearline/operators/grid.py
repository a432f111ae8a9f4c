"""MLlib's random forest for many rows and few features, grown on counted cells.

MLlib splits a feature at 31 values at most, so a tree only sees which cell of a grid a row lies in. Rows of one
cell and class are counted once; each tree then takes its bootstrap draws and all of its levels from those
counts, so its cost is bounded by the grid and not by the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wearline.session import MAX_BROADCAST_ROWS

BINS = 32  # MLlib's default
MAX_CELLS = 65_536
# A group's trees are grown one after the other, and their probabilities added in that order.
TREES_PER_GROUP = 4


def split_values(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """MLlib's split points of sorted distinct values: all midpoints if they are few, else near equal weights."""
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) < bins:
        return middle
    stride = weights.sum() / bins
    found, upto, target = [], weights[0], stride
    for i in range(1, len(values)):
        before, upto = upto, upto + weights[i]
        if abs(before - target) < abs(upto - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found)


def _cells(batch: Sequence[pd.Series] | pd.Series, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Numbers of the rows' cells; the last feature's bin varies fastest."""
    # A single column arrives as itself, not as a tuple of one.
    batch = [batch] if isinstance(batch, pd.Series) else batch
    at = np.zeros(len(batch[0]), dtype=np.int64)
    for values, found in zip(batch, cuts):
        x = values.to_numpy(float)
        if np.isnan(x).any():
            raise ValueError("a feature of the forest is null or NaN")
        at = at * (len(found) + 1) + np.searchsorted(found, x)
    return at


def _looked_up(df: DataFrame, features: Sequence[str], cuts: Sequence[np.ndarray], of_cell: np.ndarray) -> Column:
    """Each row's entry of ``of_cell``, an array of at most ``MAX_CELLS`` numbers, broadcast once."""
    shared = df.sparkSession.sparkContext.broadcast((tuple(cuts), of_cell))

    @F.pandas_udf(T.LongType() if of_cell.dtype == np.int64 else T.DoubleType())
    def look_up(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        cuts, of_cell = shared.value
        for batch in batches:
            yield pd.Series(of_cell[_cells(batch, cuts)])

    return look_up(*[F.col(c).cast("double") for c in features])


def _classes(y: str) -> list[Column]:
    return [F.count_if(F.col(y) == 0).alias("quiet"), F.count_if(F.col(y) == 1).alias("failing")]


def _grid(cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The bins of every cell, a row per feature."""
    shape = [len(c) + 1 for c in cuts]
    return np.array(np.unravel_index(np.arange(math.prod(shape)), shape))


def grow(
    cells: np.ndarray,
    counts: np.ndarray,
    shape: Sequence[int],
    weights: Sequence[float],
    *,
    leaf: int,
    depth: int,
    per_node: int,
    rng: np.random.Generator,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """MLlib's tree on counted cells, as arrays (feature, bin, left child, class counts) of its nodes.

    ``cells`` has the bins by feature, ``counts`` the rows of either class. A row goes left if its bin is at most the
    node's; the right child follows the left one; leaves have feature -1. As in MLlib a split leaves ``leaf`` rows on both
    sides and lowers the Gini impurity, the first of equal ones is taken, and two leaves of one class are pruned.
    """
    w0, w1 = weights
    held = np.flatnonzero(counts.sum(axis=0))
    bins, quiet, failing = cells[:, held], counts[0, held].astype(float), counts[1, held].astype(float)
    node = np.zeros(len(held), dtype=np.intp)
    n0, n1 = np.array([quiet.sum()]), np.array([failing.sum()])
    levels, used = [], 1
    for level in range(depth + 1):
        size = len(n0)
        feature, cut, left = np.full(size, -1), np.zeros(size, dtype=np.intp), np.zeros(size, dtype=np.intp)
        levels.append((feature, cut, left, n0, n1))
        # Pure nodes and those too small to divide stay leaves.
        open_ = (n0 > 0) & (n1 > 0) & (n0 + n1 >= 2 * leaf) & (level < depth)
        if not open_.any():
            break
        best = np.zeros(size)
        tried = np.ones((len(shape), size), dtype=bool)
        if per_node < len(shape):
            tried = rng.random((len(shape), size)).argsort(axis=0).argsort(axis=0) < per_node
        for f, width in enumerate(shape):
            here = tried[f] & open_
            rows = np.flatnonzero(here[node])
            key = node[rows] * width + bins[f, rows]
            h0 = np.bincount(key, quiet[rows], size * width)
            h1 = np.bincount(key, failing[rows], size * width)
            at = np.flatnonzero(h0 + h1)
            of = at // width
            # Running totals over all nodes, less those of the nodes before.
            l0 = np.cumsum(h0[at]) - (np.cumsum(n0 * here) - n0 * here)[of]
            l1 = np.cumsum(h1[at]) - (np.cumsum(n1 * here) - n1 * here)[of]
            fits = np.flatnonzero((l0 + l1 >= leaf) & (n0[of] + n1[of] - l0 - l1 >= leaf))
            if not len(fits):
                continue
            at, of, l0, l1 = at[fits], of[fits], l0[fits], l1[fits]
            gain = _gain(w0 * l0, w1 * l1, w0 * (n0[of] - l0), w1 * (n1[of] - l1))
            first = np.flatnonzero(np.diff(of, prepend=-1))
            top = np.maximum.reduceat(gain, first)
            most = np.flatnonzero(gain == np.repeat(top, np.diff(first, append=len(of))))
            most = most[np.flatnonzero(np.diff(of[most], prepend=-1))]
            better = most[gain[most] > best[of[most]]]
            owner = of[better]
            best[owner], feature[owner], cut[owner] = gain[better], f, at[better] - owner * width
        parents = np.flatnonzero(feature >= 0)
        if not len(parents):
            break
        left[parents] = used + 2 * np.arange(len(parents))
        rows = np.flatnonzero(feature[node] >= 0)
        bins, quiet, failing, node = bins[:, rows], quiet[rows], failing[rows], node[rows]
        right = bins[feature[node], np.arange(len(node))] > cut[node]
        node = left[node] - used + right
        used += 2 * len(parents)
        n0, n1 = (np.bincount(node, c, 2 * len(parents)) for c in (quiet, failing))
    feature, cut, left, n0, n1 = (np.concatenate(parts) for parts in zip(*levels))
    predicted = w1 * n1 > w0 * n0
    end = len(feature)
    for part in reversed(levels):
        inner = np.arange(end - len(part[0]), end)
        end -= len(part[0])
        inner = inner[feature[inner] >= 0]
        a = left[inner]
        alike = (feature[a] < 0) & (feature[a + 1] < 0) & (predicted[a] == predicted[a + 1])
        feature[inner[alike]] = -1
    return feature, cut, left, np.array([n0, n1])


def _gain(l0: np.ndarray, l1: np.ndarray, r0: np.ndarray, r1: np.ndarray) -> np.ndarray:
    """How much a split lowers the Gini impurity, from weighted counts, in MLlib's steps."""

    def gini(a, b):
        total = a + b
        return 1.0 - (a / total) * (a / total) - (b / total) * (b / total)

    below, above = l0 + l1, r0 + r1
    total = below + above
    return gini(l0 + r0, l1 + r1) - below / total * gini(l0, l1) - above / total * gini(r0, r1)


def probabilities(tree: tuple[np.ndarray, ...], grid: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    """The tree's probability of failure in every cell."""
    feature, cut, left, (n0, n1) = tree
    at = np.zeros(grid.shape[1], dtype=np.intp)
    going = np.flatnonzero(feature[at] >= 0)
    while len(going):
        node = at[going]
        node = left[node] + (grid[feature[node], going] > cut[node])
        at[going] = node
        going = going[feature[node] >= 0]
    quiet, failing = weights[0] * n0, weights[1] * n1
    return (failing / (quiet + failing))[at]


@dataclass(frozen=True)
class GridForest:
    """A fitted forest: its mean probability of failure in every cell, which is all that scoring needs."""

    features: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]
    scores: np.ndarray

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        return df.withColumn(name, _looked_up(df, self.features, self.cuts, self.scores))

    def write(self) -> GridForest:
        return self

    def save(self, path: str) -> None:
        """Write the scores and a one-row description; an existing folder is an error."""
        spark = SparkSession.active()
        cells = spark.createDataFrame(pa.table({"cell": np.arange(len(self.scores)), "score": self.scores}))
        cells.coalesce(1).write.parquet(f"{path}/scores")
        about = [(list(self.features), [[float(t) for t in c] for c in self.cuts])]
        schema = "features array<string>, cuts array<array<double>>"
        spark.createDataFrame(about, schema).coalesce(1).write.parquet(f"{path}/metadata")

    @classmethod
    def load(cls, path: str) -> GridForest:
        spark = SparkSession.active()
        about = spark.read.parquet(f"{path}/metadata").first()
        scores = spark.read.parquet(f"{path}/scores").toPandas().sort_values("cell")["score"].to_numpy()
        return cls(tuple(about["features"]), tuple(np.array(c, dtype=float) for c in about["cuts"]), scores)


def find_cuts(
    train: DataFrame, features: Sequence[str], y: str, weights: Sequence[float]
) -> tuple[np.ndarray, ...] | None:
    """Split points from the counted values of all rows; None if a grid of them would be too large.

    None also for values or labels that are missing or no numbers, which MLlib refuses.
    """
    value = [F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)]
    long = train.select(F.col(y), F.inline(F.array(*value)))
    counted = long.groupBy("f", "v").agg(F.count("*").alias("n"), *_classes(y))
    found = counted.limit(MAX_BROADCAST_ROWS + 1).toPandas()
    odd = found["v"].isna() | (found["n"] != found["quiet"] + found["failing"])
    if len(found) > MAX_BROADCAST_ROWS or odd.any():
        return None
    found["w"] = weights[0] * found["quiet"] + weights[1] * found["failing"]
    parts = [found[found["f"] == i].sort_values("v") for i in range(len(features))]
    cuts = tuple(split_values(p["v"].to_numpy(), p["w"].to_numpy()) for p in parts)
    return cuts if math.prod(len(c) + 1 for c in cuts) <= MAX_CELLS else None


def fit_grid_forest(
    train: DataFrame,
    features: Sequence[str],
    y: str,
    cuts: Sequence[np.ndarray],
    weights: Sequence[float],
    *,
    trees: int,
    leaf: int,
    depth: int,
    seed: int,
) -> GridForest:
    """Grow all trees in parallel from the counts of all cells, at most ``MAX_CELLS`` rows.

    The sum of the Poisson draws of equal rows is one Poisson draw of their number. The draws follow from the seed
    and the tree's number, so the forest does not depend on partitioning.
    """
    spark = train.sparkSession
    grid, shape = _grid(cuts), [len(c) + 1 for c in cuts]
    cell = _looked_up(train, features, cuts, np.arange(grid.shape[1]))
    counted = train.select(F.col(y), cell.alias("cell")).groupBy("cell").agg(*_classes(y))
    found = counted.toPandas().sort_values("cell")
    cells = grid[:, found["cell"].to_numpy()]
    shared = spark.sparkContext.broadcast((cells, found[["quiet", "failing"]].to_numpy().T, [c.tolist() for c in cuts]))
    per_node = len(features) if trees == 1 else math.ceil(math.sqrt(len(features)))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, counts, cuts = shared.value
        grid = _grid(cuts)
        for number in (n for frame in frames for n in frame["id"]):
            total = np.zeros(grid.shape[1])
            for tree in range(number * TREES_PER_GROUP, min(trees, (number + 1) * TREES_PER_GROUP)):
                rng = np.random.default_rng([seed, tree])
                grown = grow(
                    cells, rng.poisson(counts), shape, weights, leaf=leaf, depth=depth, per_node=per_node, rng=rng
                )
                total += probabilities(grown, grid, weights)
            yield pd.DataFrame({"number": [number], "total": [total.tobytes()]})

    groups = math.ceil(trees / TREES_PER_GROUP)
    spread = spark.range(0, groups, 1, groups).mapInPandas(build, "number long, total binary")
    # At most groups * MAX_CELLS numbers.
    totals = sorted(spread.collect(), key=lambda r: r["number"])
    scores = reduce(add, [np.frombuffer(bytes(r["total"])) for r in totals]) / trees
    shared.unpersist()
    return GridForest(tuple(features), tuple(cuts), scores)
