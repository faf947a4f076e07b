"""Forests of all folds and trees grown together: Spark's own tree as the oracle, and no pass more for more folds or trees."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from platewright.operators import forests
from platewright.operators.forests import BINS, bag_weights, condensed, cuts, forest_cv

K = 3


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (400, 4)).astype(float)
    y = 3 * x[:, 0] - x[:, 1] * (x[:, 2] > 5) + rng.normal(0, 0.5, 400)
    data = [(i, i % K, float(y[i]), x[i].tolist()) for i in range(400)]
    return spark.createDataFrame(data, "key long, fold int, y double, vec array<double>").repartition(5).cache()


def _predicted(df):
    return df.select("key", "predicted").toPandas().set_index("key")["predicted"].sort_index()


@pytest.mark.parametrize("min_leaf", [2, 15])
def test_single_tree_equals_sparks_own(rows, min_leaf):
    got = _predicted(forest_cv(rows, "key", "vec", "y", "fold", K, trees=1, depth=4, min_leaf=min_leaf, bootstrap=False))
    own = rows.withColumn("features", array_to_vector("vec"))
    tree = DecisionTreeRegressor(labelCol="y", maxDepth=4, minInstancesPerNode=min_leaf, predictionCol="predicted")
    for f in range(K):
        expected = _predicted(tree.fit(own.where(F.col("fold") != f)).transform(own.where(F.col("fold") == f)))
        assert np.allclose(got[expected.index], expected, atol=1e-9)


def test_a_pass_per_level_whatever_the_folds_and_trees(spark, rows):
    def jobs(k, trees):
        group = f"forest-{k}-{trees}"
        spark.sparkContext.setJobGroup(group, group)
        folded = rows.withColumn("fold", F.col("key").cast("int") % k)
        assert forest_cv(folded, "key", "vec", "y", "fold", k, trees=trees, depth=3).count() == 400
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2, 3) == jobs(6, 12)


def test_trees_that_take_turns_are_the_same(rows, monkeypatch):
    at_once = _predicted(forest_cv(rows, "key", "vec", "y", "fold", K, trees=6, depth=3))
    monkeypatch.setattr(forests, "HELD_BYTES", 1)
    assert np.allclose(at_once, _predicted(forest_cv(rows, "key", "vec", "y", "fold", K, trees=6, depth=3)), atol=1e-9)


def test_forest_learns_and_keeps_every_row_of_a_fold(spark, rows):
    more = rows.withColumn("note", F.lit("x")).unionByName(
        spark.createDataFrame([(900, None, 1.0, [1.0] * 4, "x"), (901, K + 4, 1.0, [1.0] * 4, "x")], "key long, fold int, y double, vec array<double>, note string")
    )
    out = forest_cv(more, "key", "vec", "y", "fold", K, trees=30, depth=6)
    assert out.columns == ["key", "fold", "y", "vec", "note", "predicted"]
    got = out.toPandas()
    assert sorted(got["key"]) == list(range(400))
    assert np.mean((got["y"] - got["predicted"]) ** 2) < 0.25 * np.var(got["y"])


def test_missing_targets_and_empty_tables(spark, rows):
    empty = forest_cv(rows.where("key < 0"), "key", "vec", "y", "fold", K)
    assert empty.columns == [*rows.columns, "predicted"] and empty.count() == 0
    with pytest.raises(ValueError, match="numbers"):
        forest_cv(rows.withColumn("y", F.when(F.col("key") > 0, F.col("y"))), "key", "vec", "y", "fold", K)
    with pytest.raises(ValueError, match="outside"):
        forest_cv(rows.where("fold = 0"), "key", "vec", "y", "fold", K)


def test_constant_target_makes_no_split(rows):
    got = _predicted(forest_cv(rows.withColumn("y", F.lit(5.1)), "key", "vec", "y", "fold", K, trees=3, depth=3))
    assert np.allclose(got, 5.1)


def test_bags_are_poisson_and_belong_to_the_tree():
    number = np.arange(20_000) << 20
    w = bag_weights(number, 0, 9, 42)
    assert np.allclose(w.mean(axis=1), 1, atol=0.03) and np.allclose(w.var(axis=1), 1, atol=0.06)
    assert np.abs(np.corrcoef(w) - np.eye(9)).max() < 0.04
    for first in (3, 5):
        assert (bag_weights(number, first, 4, 42) == w[first : first + 4]).all()


def test_cuts_of_many_values_hold_even_shares():
    x = np.random.default_rng(1).lognormal(size=50_000)
    parts = [condensed(p) for p in np.array_split(x, 7)]
    found = cuts(*condensed(*(np.concatenate(p) for p in zip(*parts))))
    assert len(found) == BINS - 1
    assert np.abs(np.diff(np.searchsorted(np.sort(x), found)) / len(x) - 1 / BINS).max() < 0.003
    assert cuts(np.array([1.0, 2.0, 4.0]), np.ones(3)).tolist() == [1.5, 3.0]
