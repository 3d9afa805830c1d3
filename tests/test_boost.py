"""Boosted trees of all folds at once against a slow version, fold-stacked guard and features against those of one training frame."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from featurelab.operators import boost, fitted, guard, model, splits
from featurelab.operators import transforms as tf
from featurelab.operators.splits import Folds
from featurelab.plans import models


def slow_boost(x, y, loss, outputs, trees, rate, depth, start):
    """Exact cuts between all different values; returns the margins [output, row] of all rows of x, trained on those with y."""
    margin, train = np.repeat(start[:, None], len(x), axis=1).astype(float), ~np.isnan(y)
    for _ in range(trees):
        g, h = boost.gradients(loss, y[train], margin[:, train])
        for c in range(outputs):
            new = np.zeros(len(x))

            def grow(rows, mine, level):
                gg, hh = g[c][mine].sum(), h[c][mine].sum()
                top = (1e-12, None, None)
                if level < depth:
                    for f in range(x.shape[1]):
                        v = x[train][mine, f]
                        for cut in np.unique(v)[:-1]:
                            left = mine[v <= cut]
                            gl, hl = g[c][left].sum(), h[c][left].sum()
                            if hl >= 1 and hh - hl >= 1:
                                gain = gl**2 / (hl + 1) + (gg - gl) ** 2 / (hh - hl + 1) - gg**2 / (hh + 1)
                                if gain > top[0] + 1e-9:
                                    top = (gain, f, cut)
                if top[1] is None:
                    new[rows] = -gg / (hh + 1) * rate
                    return
                _, f, cut = top
                below, mine_below = x[rows, f] <= cut, x[train][mine, f] <= cut
                grow(rows[below], mine[mine_below], level + 1)
                grow(rows[~below], mine[~mine_below], level + 1)

            grow(np.arange(len(x)), np.arange(train.sum()), 0)
            margin[c] += new
    return margin


@pytest.mark.parametrize("loss, classes, column, rows", [("squared", 0, "fold", 1 << 16), ("logistic", 2, "chunk", 1 << 16), ("softmax", 3, "fold", 40), ("squared", 0, "chunk", 40)])
def test_trees_equal_a_slow_version(spark, monkeypatch, loss, classes, column, rows):
    monkeypatch.setattr(boost, "BLOCK_ROWS", rows)
    monkeypatch.setattr(boost, "TREES_A_TABLE", 3)
    rng, n, folds = np.random.default_rng(classes), 160, 2
    x = np.stack([rng.integers(0, 9, n), np.round(rng.normal(size=n), 1), rng.integers(0, 3, n)], axis=1).astype(float)
    y = x[:, 0] + x[:, 1] * 2 if not classes else ((x[:, 0] + 3 * x[:, 2] + rng.integers(0, 3, n)) % classes)
    part = rng.integers(1, 4, n) if column == "chunk" else rng.integers(0, 2, n)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), int(part[i])) for i in range(n)], f"id int, a double, b double, c double, y double, {column} int").repartition(3)
    f = Folds.of(df, folds)
    made = boost.fit(df, [["a"], ["b"], ["c"]], "y", "id", f, classes, 4, 0.3, 3)
    got = {r["id"]: r for r in made.predict(df, "p").collect()}
    outputs = classes if loss == "softmax" else 1
    seen = 0
    for k in range(folds):
        train = f.trains(k, part)
        start = np.zeros(outputs) if loss == "softmax" else np.array([y[train].mean()])
        start = np.log(start / (1 - start)) if loss == "logistic" else start
        want = slow_boost(x, np.where(train, y, np.nan), loss, outputs, 4, 0.3, 3, start)
        share = want[0] if loss == "squared" else boost.shares(loss, want)
        for i in np.flatnonzero(f.validates(k, part)):
            v = got[i]["p"] if loss == "squared" else got[i]["p"][1] if loss == "logistic" else got[i]["p"]
            assert v == pytest.approx(share[i] if loss == "squared" else share[0, i] if loss == "logistic" else share[:, i].tolist(), abs=1e-9)
            assert got[i]["judged_by"] == k
            seen += 1
    assert seen == len(got)


def test_many_values_fall_into_quantile_bins(spark):
    at = boost.edges(spark.range(5000).selectExpr("cast(id as double) as a", "cast(id % 256 as double) as b", "1.0D as c"), ["a", "b", "c"])
    assert [len(e) for e in at] == [255, 255, 0] and np.bincount(boost.binned(np.arange(5000.0)[:, None], at[:1])[0]).std() < 1


def frame(spark, column):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        rows.append((i, [None, float(i % 17), float("inf")][min(i % 11, 2) if i % 11 < 3 else 1], None if i % 13 == 0 else f"c{i * i % 23 if i < 250 else i}", float(rng.normal()), float(rng.normal()), i % 7, None if i % 29 == 0 else float(i * 31 % 101)))
    df = spark.createDataFrame(rows, "row_id int, a double, s string, b double, z double, w int, y double").repartition(4)
    if column == "chunk":
        return splits.temporal_split(df, [F.col("row_id")], 3)
    return splits.stratified_split(df.withColumn("stratum", F.col("w").cast("string")), "row_id", "stratum", 3)


@pytest.mark.parametrize("column", ["fold", "chunk"])
def test_guard_of_all_folds_equals_that_of_each(spark, column):
    df = frame(spark, column).filter("split = 'train'").drop("rn")
    folds = Folds.of(df, 3)
    got, use = guard.guard_folds(df.filter(folds.part().isNotNull()), {c: [c] for c in ("a", "s", "b", "w")}, "row_id", folds)
    assert [len(use[c]) for c in ("a", "s", "b", "w")] == [3, 3, 1, 1]
    rows = {r["row_id"]: r for r in got.collect()}
    for k in range(3):
        g = guard.Guard(["a", "s", "b", "w"], "row_id").fit(splits.training_rows(df, k))
        for part in (splits.training_rows(df, k), splits.validation_rows(df, k)):
            for r in g.transform(part).collect():
                own = rows[r["row_id"]]
                assert [own[use[c][k] if len(use[c]) > 1 else use[c][0]] for c in use] == pytest.approx([r[c] for c in use])


ONE_FRAME = {
    "zscore:b": lambda t, d: tf.zscore("b", "v").apply(t, d), "minmax:z": lambda t, d: tf.minmax("z", "v").apply(t, d), "wbin:b:4": lambda t, d: tf.equal_width_bin("b", 4, "v").apply(t, d),
    "clip:b:0.1:0.8": lambda t, d: tf.clip("b", 0.1, 0.8, "v").apply(t, d), "qbin:z:5": lambda t, d: tf.quantile_bin("z", 5, "v").apply(t, d), "count:s": lambda t, d: tf.count_encoding(t, d, "s", "v"),
    "frequency:s": lambda t, d: tf.frequency_encoding(t, d, "s", "v"), "label:s": lambda t, d: tf.label_encoding(t, d, "s", "v"), "target:s": lambda t, d: tf.target_encoding(t, d, "s", "y", "v"),
    "group_mean:b:s:w": lambda t, d: tf.group_aggregate(t, d, ["s", "w"], "b").withColumnRenamed("b_mean", "v"), "group_std:b:w": lambda t, d: tf.group_aggregate(t, d, ["w"], "b").withColumnRenamed("b_std", "v"),
    "log:b": lambda t, d: tf.log("b", "v").apply(t, d), "power:b:3": lambda t, d: tf.power("b", 3.0, "v").apply(t, d), "onehot:s:c4": lambda t, d: tf.onehot("s", "c4").apply(t, d).withColumnRenamed("s_is_c4", "v"),
    "ordinal:s:c4:c1": lambda t, d: tf.ordinal("s", ["c4", "c1"], "v").apply(t, d), "bin:b:-1:0.5": lambda t, d: tf.custom_bin("b", [-1.0, 0.5], "v").apply(t, d), "product:b:z": lambda t, d: tf.product("b", "z", "v").apply(t, d),
}


@pytest.mark.parametrize("column", ["fold", "chunk"])
def test_fitted_features_equal_those_of_one_training_frame(spark, column):
    df = frame(spark, column).filter("split = 'train'").drop("rn")
    folds = Folds.of(df, 3)
    got, places = fitted.stacked(df.filter(folds.part().isNotNull()), [fitted.FoldFeature.parse(x) for x in ONE_FRAME], "y", folds)
    rows = {r["row_id"]: r for r in got.collect()}
    for k in (2,) if column == "fold" else (0,):
        train, val = splits.training_rows(df, k).persist(), splits.validation_rows(df, k).persist()
        for spec, made in ONE_FRAME.items():
            for r in made(train, val).select("row_id", F.col("v").cast("double")).collect():
                own = rows[r["row_id"]][places[spec][k] if len(places[spec]) > 1 else places[spec][0]]
                assert own == (None if r["v"] is None else pytest.approx(r["v"])), (spec, k, r)


def test_out_of_fold_leaves_a_rows_own_part_out(spark):
    df = frame(spark, "fold").filter("split = 'train'")
    got, places = fitted.stacked(df, [fitted.FoldFeature.parse("oof:w")], "y", Folds(3, "fold"))
    rows = got.collect()
    for k in range(3):
        ok = [r for r in rows if r["fold"] != k and r["y"] is not None]
        for r in rows[:60]:
            others = [q["y"] for q in ok if q["w"] == r["w"] and q["fold"] != r["fold"]] or [q["y"] for q in ok]
            assert r[places["oof:w"][k]] == pytest.approx(np.mean(others))


def test_fitted_features_in_cross_validation(spark):
    df = frame(spark, "fold").filter("y is not null")
    r = model.cross_validate(df, ["b", "s"], "y", "mae", "row_id", 3, 4, shap=True, fitted=[fitted.FoldFeature.parse(x) for x in ("oof:s", "zscore:a", "cluster:3:b:z")])
    assert r["features"] == ["b", "s", "oof:s", "zscore:a", "cluster:3:b:z"] and set(r["shap"]) == set(r["features"]) and len(r["scores"]) == 3
    with pytest.raises(ValueError, match="target"):
        model.cross_validate(df, [], "y", "mae", "row_id", 3, 1, fitted=[fitted.FoldFeature.parse("zscore:y")])
    with pytest.raises(ValueError, match="not there"):
        model.cross_validate(df, [], "y", "mae", "row_id", 3, 1, fitted=[fitted.FoldFeature.parse("zscore:nope")])
    assert fitted.FoldFeature.parse("a / b") is None and fitted.FoldFeature.parse("log(a)") is None


def test_a_model_of_ones_own(spark):
    seen = []

    def fit(df, features, target, metric):
        seen.append((df.count(), metric))
        m = LinearRegression(featuresCol="_v", labelCol=target).fit(VectorAssembler(inputCols=features, outputCol="_v").transform(df))
        return lambda rows: m.transform(VectorAssembler(inputCols=features, outputCol="_v").transform(rows))

    df = frame(spark, "fold").withColumn("y", F.col("b") * 3 + F.col("w"))
    r = model.cross_validate(df, ["b", "w", "s"], "y", "rmse", "row_id", 3, fit=fit)
    assert r["cv_score"] < 0.1 and len(seen) == 3 and all(m == "rmse" for _, m in seen)


def test_attribution_adds_up_over_folds(spark):
    df = frame(spark, "fold").filter("y is not null").select("row_id", "b", "z", "w", "y", "fold")
    folds = Folds(3, "fold")
    made = boost.fit(df, [["b"], ["z"], ["w"]], "y", "row_id", folds, 0, 5)
    got = model.mean_abs_shap(made, df, 3)
    for k in range(3):
        rows = df.filter(f"fold = {k}").collect()
        x = boost.binned(np.array([[r["b"], r["z"], r["w"]] for r in rows]), made.at).T.astype(float)
        values, base = model.tree_shap(made.leaves(k, 0), x)
        margin = [r["p"] for r in made.predict(df.filter(f"fold = {k}"), "p").orderBy("row_id").collect()]
        order = np.argsort([r["row_id"] for r in rows])
        assert np.allclose(values.sum(axis=1)[order] + base + made.start[k, 0], margin)
        assert np.allclose(np.abs(values).mean(axis=0), got[k])


@pytest.mark.parametrize("name", ["gbt_cv_scores", "gbt_multiclass", "shap_by_fold", "model_residual_icc"])
def test_model_queries(spark, sf, monkeypatch, name):
    """With few trees; that the queries run with all of them is tested in test_whole.py."""
    from inspect import signature

    for f in ("cross_validate", "residuals"):
        def few(*a, real=getattr(model, f), **k):
            got = signature(real).bind(*a, **k)
            got.arguments["trees"] = 3
            return real(*got.args, **got.kwargs)

        monkeypatch.setattr(model, f, few)
    rows = models.QUERIES[name](spark, sf).collect()
    assert len(rows) == (2 if name == "model_residual_icc" else 5) and all(v is not None for r in rows for v in r)
