"""Attribution by a table for each tree, over rows that are dealt by fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelab.operators import boost, model
from featurelab.operators.splits import Folds


def grown(rng, features, depth):
    """A tree as leaves(): nodes are cut at random bins, some stay leaves, shares of both sides add up to 1."""
    found = []

    def walk(level, path):
        if level == depth or (level and rng.random() < 0.2):
            found.append((float(rng.normal()), path))
            return
        f, cut, share = int(rng.integers(features)), float(rng.integers(256)), float(rng.random())
        walk(level + 1, [*path, (f, -np.inf, cut, share)])
        walk(level + 1, [*path, (f, cut, np.inf, 1 - share)])

    walk(0, [])
    return found


@pytest.mark.parametrize("features, depth", [(1, 3), (5, 6), (30, 6), (12, 8)])
def test_tables_give_the_values_of_the_definition(features, depth):
    rng = np.random.default_rng(features)
    trees = [grown(rng, features, depth) for _ in range(3)] + [[(0.7, [])]]
    bins = rng.integers(0, 256, (model.SHAP_BLOCK + 9, features)).astype(np.uint8)
    assert np.allclose(model.binned_shap(trees, bins, features), model.tree_shap(trees, bins.astype(float))[0], rtol=0, atol=1e-12)
    assert model.binned_shap(trees, bins[:0], features).shape == (0, features)


def test_rows_of_a_task_are_attributed_together(spark, monkeypatch):
    """A table is made once for a tree and task, however many batches the rows come in; a task has few folds."""
    rows = spark.range(4000).select((F.col("id") % 4).cast("int").alias("fold"), (F.col("id") % 61).cast("double").alias("a"), (F.col("id") % 50).cast("double").alias("b"), (F.col("id") * 7 % 113).cast("double").alias("y"))
    made = boost.fit(rows, [["a"], ["b"]], "y", None, Folds(4, "fold"), 0, 3, 0.3, 3)
    whole = model.mean_abs_shap(made, rows, 2)
    calls = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(model, "SHAP_ROWS", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    monkeypatch.setattr(model, "binned_shap", lambda trees, bins, features, real=model.binned_shap: calls.add(len(trees)) or real(trees, bins, features))
    try:
        got = model.mean_abs_shap(made, rows, 2)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(got, whole, rtol=1e-12) and (whole > 0).all()
    assert 3 * 4 <= calls.value <= 3 * (4 + 4)  # four tasks over four folds in a row: at most four more than the folds
