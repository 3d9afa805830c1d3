"""Boosting sums up rows that are alike first."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelab.operators import boost
from featurelab.operators.splits import Folds


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_boosting_passes_over_different_rows_only(spark, monkeypatch, classes):
    rows = spark.range(1200).select(F.col("id"), (F.col("id") % 6).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"), (F.col("id") % 6 % classes if classes else F.col("id") % 12 / 7).alias("y"))
    seen, real = [], boost._read
    monkeypatch.setattr(boost, "_read", lambda table: seen.append(sum(r["n"] for r in table.select("n").collect())) or real(table))
    one = boost.fit(rows, [["a"], ["b"]], "y", "id", Folds(1), classes, 2, 0.3, 2)
    other = boost.fit(rows.repartition(7, "b").orderBy(F.desc("id")), [["a"], ["b"]], "y", "id", Folds(1), classes, 2, 0.3, 2)
    assert seen == [12, 12]
    assert (one.trees.column == other.trees.column).all() and (one.trees.value == other.trees.value).all() and (one.start == other.start).all()


def test_margins_are_walked_once_for_rows_that_are_alike(monkeypatch):
    trees = boost.Trees.empty(1, 2, 1)
    trees.column[0, :, 0], trees.value[0, 0, 1:], trees.value[0, 1, 1:] = 0, (1.0, 2.0), (3.0, 4.0)
    made = boost.Boosted("squared", Folds(2, "fold"), 1, ["a"], [[0], [0]], [np.array([0.0])], np.zeros((2, 1)), trees, 1)
    walked, real = [], boost.Trees.margins
    monkeypatch.setattr(boost.Trees, "margins", lambda self, m, bins: walked.append(bins.shape[1]) or real(self, m, bins))
    x, fold, known = np.array([[0.0], [1.0]] * 50), np.repeat([0, 1], 50), {}
    for most in (boost.KNOWN, 3):  # with the second all are forgotten each time
        monkeypatch.setattr(boost, "KNOWN", most)
        for _ in range(2):
            assert (made.margins_of(x, fold, known)[0] == np.array([1.0, 2.0] * 25 + [3.0, 4.0] * 25)).all()
    assert sum(walked) == 4 * 3 and (made.margins_of(x, fold) == made.margins_of(x, fold, known)).all()
    assert made.margins_of(x[:0], fold[:0], known).shape == (1, 0)


@pytest.mark.parametrize("classes", [0, 3])
def test_small_histograms_are_summed_without_an_exchange(spark, monkeypatch, classes):
    """The same trees either way; a histogram has the bins that its feature has."""
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 37).cast("double").alias("a"), (F.col("id") * 7 % 311).cast("double").alias("b"), (F.col("id") * 13 % 5 % classes if classes else F.col("id") * 17 % 101 / 7).alias("y"), (F.col("id") % 3).cast("int").alias("fold"))
    monkeypatch.setattr(boost, "BLOCK_ROWS", 256)
    exchanged, real, shapes, best = [], boost.best_cuts, set(), boost.best
    monkeypatch.setattr(boost, "best_cuts", lambda hist, parts: exchanged.append(parts) or real(hist, parts))
    monkeypatch.setattr(boost, "best", lambda g, h: shapes.add(g.shape[1]) or best(g, h))
    made = [boost.fit(rows, [["a"], ["b"]], "y", "id", Folds(3, "fold"), classes, 2, 0.3, 3)]
    assert not exchanged and shapes == {37, 256}
    monkeypatch.setattr(boost, "SMALL", 0)
    made.append(boost.fit(rows, [["a"], ["b"]], "y", "id", Folds(3, "fold"), classes, 2, 0.3, 3))
    assert exchanged and (made[0].trees.column >= 0).any()
    for name in ("column", "cut", "value", "cover"):
        assert (getattr(made[0].trees, name) == getattr(made[1].trees, name)).all()


def test_rows_stay_in_the_leaf_they_reach():
    trees = boost.Trees.empty(1, 2, 2)
    trees.column[0, 0, [0, 2]], trees.cut[0, 0, [0, 2]] = (0, 1), (4, 7)
    bins = np.array([[4, 5, 255, 0], [9, 7, 8, 255]], np.uint8)
    assert trees.node(0, 0, bins, 2).tolist() == [1, 5, 6, 1] and trees.node(0, 0, bins, 1).tolist() == [1, 2, 2, 1]
    assert trees.node(0, 1, bins, 2).tolist() == [0] * 4 and trees.node(0, 1, bins[:0], 2).tolist() == [0] * 4
