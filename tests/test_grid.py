"""The forest on counted cells beside MLlib's."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wearline.operators import grid, supervised
from wearline.sources.models import ModelStore

COLUMNS = ["a", "b", "c"]


def units(spark, n):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"a": rng.integers(0, 50, n).astype(float), "b": rng.normal(size=n), "c": rng.choice([0.1, 0.2, 0.7], n)})
    share = 0.1 + 0.5 * (rows["a"] > 30) * (rows["b"] > 0) + 0.2 * (rows["c"] > 0.5)
    rows["y"] = (rng.random(n) < share).astype("int32")
    return spark.createDataFrame(rows)


@pytest.fixture(scope="module")
def few(spark):
    return units(spark, 4000).cache()


@pytest.mark.parametrize("leaf, depth", [(20, 30), (1, 30), (5, 4)])
def test_a_tree_is_mllibs_tree(few, leaf, depth):
    """Without random draws both trees give every row the same probability."""
    weighted = few.withColumn("_w", F.when(F.col("y") == 1, 2.0).otherwise(1.0))
    ready = supervised._vectors(weighted, COLUMNS)
    model = RandomForestClassifier(
        featuresCol="_x", labelCol="y", weightCol="_w", numTrees=1, minInstancesPerNode=leaf, maxDepth=depth,
        bootstrap=False, featureSubsetStrategy="all",
    ).fit(ready)
    want = model.transform(ready).select(*COLUMNS, vector_to_array("probability")[1].alias("score")).toPandas()
    cuts = grid.find_cuts(few, COLUMNS, "y", [1.0, 2.0])
    bins, shape = grid._grid(cuts), [len(c) + 1 for c in cuts]
    rows = few.toPandas()
    cell = grid._cells([rows[c] for c in COLUMNS], cuts)
    counts = np.array([np.bincount(cell[rows["y"] == k], minlength=bins.shape[1]) for k in (0, 1)])
    tree = grid.grow(
        bins, counts, shape, [1.0, 2.0], leaf=leaf, depth=depth, per_node=3, rng=np.random.default_rng(0)
    )
    found = grid.GridForest(tuple(COLUMNS), cuts, grid.probabilities(tree, bins, [1.0, 2.0]))
    got = found.score(few.select(*COLUMNS)).toPandas()
    assert got[COLUMNS].equals(want[COLUMNS]) and want["score"].nunique() > 5
    assert np.allclose(got["score"], want["score"], rtol=0, atol=1e-9)


def test_a_forest_scores_as_mllibs_does(few, monkeypatch):
    """Other draws, the same scores up to what two seeds of MLlib differ by."""
    options = {"trees": 40, "leaf": 20, "depth": 30}
    old, other = (supervised.fit_forest(few, COLUMNS, seed=s, **options)(few).toPandas()["score"] for s in (1, 2))
    monkeypatch.setattr(supervised, "GRID_ROWS", 1000)
    scorer = supervised.fit_forest(few, COLUMNS, seed=1, **options)
    assert scorer.kind == "grid"
    new = scorer(few).toPandas()["score"]
    assert abs(new - old).mean() < 1.5 * abs(other - old).mean()
    assert abs(new.mean() - old.mean()) < 0.01
    again = supervised.fit_forest(few.repartition(7), COLUMNS, seed=1, **options)(few).toPandas()["score"]
    assert new.equals(again)


def test_many_units_take_no_pass_over_rows_per_level(spark, monkeypatch, tmp_path):
    """MLlib read all rows for each level of 200 trees and did not end on a fleet of sf0.6."""
    passes = []
    monkeypatch.setattr(supervised.RandomForestClassifier, "fit", lambda *a: passes.append(a))
    df = units(spark, supervised.GRID_ROWS + 500)
    scorer = supervised.fit_forest(df, COLUMNS, trees=6, leaf=20)
    got = scorer(df).toPandas()
    assert not passes and len(got) == supervised.GRID_ROWS + 500
    assert got[got["y"] == 1]["score"].mean() > got[got["y"] == 0]["score"].mean() + 0.1
    store = ModelStore(spark, str(tmp_path / "store"))
    back = store.load(store.save(scorer))
    assert back.features == scorer.features and back(df).toPandas()["score"].equals(got["score"])
    with pytest.raises(Exception, match="null or NaN"):
        scorer(df.withColumn("b", F.lit(None).cast("double"))).collect()


def test_what_the_grid_cannot_hold_goes_to_mllib(few, monkeypatch):
    weights = [1.0, 1.0]
    assert grid.find_cuts(few, COLUMNS, "y", weights) is not None
    assert grid.find_cuts(few, [*COLUMNS, "b"], "y", weights) is None
    assert grid.find_cuts(few.withColumn("c", F.when(F.col("c") > 0.5, F.col("c"))), COLUMNS, "y", weights) is None
    assert grid.find_cuts(few.withColumn("y", F.when(F.col("c") > 0.5, 2).otherwise(0)), COLUMNS, "y", weights) is None
    monkeypatch.setattr(grid, "MAX_BROADCAST_ROWS", 100)
    assert grid.find_cuts(few, COLUMNS, "y", weights) is None


def test_split_values_by_hand():
    assert grid.split_values(np.array([1.0, 2.0, 4.0]), np.ones(3)).tolist() == [1.5, 3.0]
    assert grid.split_values(np.array([5.0]), np.ones(1)).tolist() == []
    # Equal weights of 2 in 4 bins; the heavy value has a bin of its own.
    assert grid.split_values(np.arange(8.0), np.ones(8), 4).tolist() == [1.5, 3.5, 5.5]
    assert grid.split_values(np.arange(6.0), np.array([1.0, 1.0, 5.0, 1.0, 1.0, 1.0]), 3).tolist() == [1.5, 2.5]
