"""Gradient-boosted trees per fold, attribution of their predictions, and the experiment around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import gram, metrics
from ..functions.expr import finite
from ..functions.shared import dropped, stored
from . import boost
from .fitted import FoldFeature, stacked
from .guard import guard_folds, impute, label_index, medians
from .profile import numeric_columns
from .splits import Folds

#: A model of one's own: from a numeric training frame, its feature columns, the target and the metric to a function of frames.
Fit = Callable[[DataFrame, list[str], str, str], Callable[[DataFrame], DataFrame]]
TREES, RATE, DEPTH, SEED = 100, 0.05, 6, 42
MAX_LABELS = 1000
#: Different rows that a task attributes, about, and how many of them at a time.
SHAP_ROWS, SHAP_BLOCK = 10_000, 256
#: Deeper trees are attributed leaf by leaf, without tables.
SHAP_DEPTH = 8
CORRELATED = 0.8


def coded_labels(rows: DataFrame, target: str, folds: Folds) -> tuple[DataFrame, int]:
    """rows with the target as codes from 0 (sorted labels of what fold 0 trains on), and how many there are. Another label or none is an error."""
    label = F.col(target).cast("string")
    codes = {r["value"]: r["code"] for r in label_index(rows.filter(folds.trains(0, folds.part())), target).limit(MAX_LABELS + 1).collect()}
    if len(codes) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels: each would be a model of its own")
    unseen = [r[0] for r in rows.select(label).filter(label.isNull() | ~label.isin(list(codes))).distinct().limit(10).collect()]
    if unseen:
        raise ValueError(f"labels that the first fold does not train on: {unseen}")
    return rows.withColumn(target, F.element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), label)), len(codes)


def score(df: DataFrame, metric: str, target: str, n_classes: int) -> float:
    """Of a frame with `target` and `prediction` (numbers) or `proba`."""
    y = F.col(target)
    if metric in ("rmse", "mae"):
        return df.agg((metrics.rmse if metric == "rmse" else metrics.mae)(y, F.col("prediction")).alias("v")).first()[0]
    if metric == "logloss":
        return df.agg(metrics.logloss(F.element_at("proba", y.cast("int") + 1)).alias("v")).first()[0]
    if metric == "auc":
        cols = df.withColumns({f"_c{k}": F.col("proba")[k] for k in range(n_classes)})
        if n_classes == 2:
            return metrics.auc(cols, target, "_c1").first()[0]
        return metrics.macro_auc(cols, target, {k: f"_c{k}" for k in range(n_classes)}).first()[0]
    hard = df.withColumns({"_h": (F.array_position("proba", F.array_max("proba")) - 1).cast("int"), "_t": y.cast("int")})
    if metric == "f1":
        return metrics.f1(hard, "_t", "_h").first()[0]
    return hard.agg(metrics.accuracy(F.col("_t"), F.col("_h")).alias("v")).first()[0]


def cross_validate(df: DataFrame, features: list[str], target: str, metric: str, row_id: str, n_folds: int = 5, trees: int = TREES, shap: bool = False, fit: Fit | None = None, fitted: Sequence[FoldFeature] = ()) -> dict:
    """df has split and fold, or chunk (temporal_split). Fitted features, guard and model learn from each fold's training rows alone (with
    chunks from earlier ones); all folds share one frame and the boosted trees of all folds grow together. Returns scores, mean, std, and with shap also attribution and
    correlated pairs of numeric features (over .8 in the last fold's training rows).

    fitted: features with a state (fitted.py), besides the columns in `features`. fit: another model, fitted and applied fold by fold: fit(df, features, target, metric) returns a
    function that gives a frame its `prediction` (a number) or `proba` (an array that sums to 1). A label that fold 0 does not train on is
    an error.
    """
    folds, rows = Folds.of(df, n_folds), df.filter("split = 'train'")
    rows, n_classes = (rows, 0) if metric in ("rmse", "mae") else coded_labels(rows, target, folds)
    rows = rows.filter(folds.part().isNotNull())
    rows, places = stacked(rows, fitted, target, folds)
    alike = _correlated(rows, {f: [f] for f in features} | places, folds) if shap else []
    rows, use = guard_folds(rows, {f: [f] for f in features} | places, row_id, folds)
    names = list(use)
    columns = list(dict.fromkeys([row_id, target, folds.column, *[c for cs in use.values() for c in cs]]))
    rows = stored(rows.select(*[F.col(f"`{c}`") for c in columns]), "cv-rows")
    out: dict = {"features": names, "correlated": alike}
    if fit is None:
        made = boost.fit(rows, [use[f] for f in names], target, row_id, folds, n_classes, trees, RATE, DEPTH)
        got = stored(made.predict(rows, "proba" if n_classes else "prediction").drop(*[c for cs in use.values() for c in cs if c not in (row_id, target, folds.column)]), "cv-scored")
        parts = [got.filter(F.col("judged_by") == k) for k in range(n_folds)]
    else:
        parts = []
        for k in range(n_folds):
            own = [F.col(f"`{cs[k] if len(cs) > 1 else cs[0]}`").alias(f"x{i}") for i, cs in enumerate(use.values())]
            one = rows.select(target, folds.part().alias("_part"), *own)
            apply = fit(one.filter(folds.trains(k, F.col("_part"))).drop("_part"), [f"x{i}" for i in range(len(own))], target, metric)
            parts.append(apply(one.filter(folds.validates(k, F.col("_part"))).drop("_part")))
    scores = [float(score(p, metric, target, max(n_classes, 2))) for p in parts]
    out |= {"scores": scores, "cv_score": float(np.mean(scores)), "cv_std": float(np.std(scores))}
    if shap and fit is None:
        by = mean_abs_shap(made, rows, len(names))
        out["shap"] = {f: float(np.mean(by[:, i])) for i, f in enumerate(names)}
        out["shap_std"] = {f: float(np.std(by[:, i])) for i, f in enumerate(names)}
    elif shap:
        out |= {"shap": {}, "shap_std": {}}  # trees of one's own are not opened
    dropped(rows)
    return out


def _correlated(df: DataFrame, use: dict[str, list[str]], folds: Folds) -> list[tuple[str, str, float]]:
    own = {f: c[-1] for f, c in use.items() if isinstance(df.schema[c[-1]].dataType, T.NumericType)}
    rows = df.filter(folds.trains(folds.n - 1, folds.part()))
    return [tuple(r) for r in gram.pairs(rows, {f: F.col(f"`{c}`") for f, c in own.items()}).filter(F.abs("r") > CORRELATED).select("col_a", "col_b", F.round("r", 4)).collect()]


def residuals(df: DataFrame, features: list[str], target: str, n_classes: int = 0, trees: int = 50) -> DataFrame:
    """df (numeric features without missing values; a label as its code from 0) with `residual`, in-sample: y - prediction, y - p, or 1 - p of the true class."""
    made = boost.fit(df, [[f] for f in features], target, None, Folds(1), n_classes, trees, RATE, DEPTH)
    got = made.predict(df, "_p").drop("judged_by")
    if not n_classes:
        return got.withColumn("residual", F.col(target) - F.col("_p")).drop("_p")
    own = F.element_at("_p", F.col(target).cast("int") + 1)
    return got.withColumn("residual", F.col(target) - F.col("_p")[1] if n_classes == 2 else 1 - own).drop("_p")


def entity_residuals(df: DataFrame, target: str, metric: str, trees: int = 50) -> DataFrame:
    """df's rows that have a target, with `residual` of boosting over all other numeric columns as they are, in-sample.

    Missing numbers and infinities count as the median, without any as 0, for the model alone: the columns stay as they are, so that
    a missing entity key stays one. The residual is y - prediction for rmse and mae, y - p for two labels, 1 - p of the row's label
    for more. Labels are coded in sorted order.
    """
    rows = df.filter(F.col(target).isNotNull())
    numbers = [c for c in numeric_columns(rows, boolean=True) if c != target]
    if not numbers:
        raise ValueError("no numeric column besides the target")
    own = {f"_x{i}": finite(F.col(f"`{c}`").cast("double")) for i, c in enumerate(numbers)}
    wide = rows.withColumns({**own, "_y": F.col(target)})
    n_classes = 0
    if metric not in ("rmse", "mae"):
        wide, n_classes = coded_labels(wide, "_y", Folds(1))
    wide = stored(impute(wide, medians(wide, list(own)), 0.0), "residual-rows")
    return residuals(wide, list(own), "_y", max(n_classes, 2) if n_classes else 0, trees=trees).drop("_y", *own)


# --- attribution -------------------------------------------------------------------------------------------------------


def tree_shap(trees: list, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Exact path-dependent Shapley values of the margin for the rows of x, and the base value.

    A leaf pays its value if every feature on its path agrees; a feature that is left out agrees with the share z of training
    rows that went that way. For such a product of (o or z) factors the Shapley value of a feature is
    value * (o - z) * sum over k of |S|! (m - 1 - |S|)! / m! times the k-th coefficient of the product of (z + o t) of the
    other features.
    """
    from math import factorial

    out, base = np.zeros(x.shape), 0.0
    for tree in trees:
        for value, path in tree:
            by: dict[int, list[float]] = {}
            for f, lo, hi, share in path:
                a = by.setdefault(f, [-np.inf, np.inf, 1.0])
                by[f] = [max(a[0], lo), min(a[1], hi), a[2] * share]
            base += value * float(np.prod([z for _, _, z in by.values()])) if by else value
            m = len(by)
            if not m:
                continue
            names = list(by)
            ok = np.array([(x[:, f] > by[f][0]) & (x[:, f] <= by[f][1]) for f in names], float)
            z = [by[f][2] for f in names]
            weight = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
            for i, f in enumerate(names):
                poly = [np.ones(len(x))]
                for j in range(m):
                    if j != i:
                        poly = [(poly[k] * z[j] if k < len(poly) else 0) + (poly[k - 1] * ok[j] if k else 0) for k in range(len(poly) + 1)]
                out[:, f] += value * (ok[i] - z[i]) * sum(w * p for w, p in zip(weight, poly, strict=True))
    return out, base


def _leaf_tables(tree: list, features: int) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """For a tree over bins: by feature the bits [bin, leaf] that its conditions set, contributions [place, leaf and bits], and the
    feature [place, leaf, feature] (0 or 1) of each place. Leaves with more features come first.

    A leaf numbers the features on its path; bit i says whether the i-th agrees. Its contributions depend on the bits alone, so they are
    computed once for all bits, by the products of tree_shap. Places that a leaf has no feature for always agree, with share 1: they change nothing.
    """
    from math import factorial

    leaves = []
    for value, path in tree:
        by: dict[int, tuple[float, float, float]] = {}
        for f, lo, hi, share in path:
            a = by.get(f, (-np.inf, np.inf, 1.0))
            by[f] = (max(a[0], lo), min(a[1], hi), a[2] * share)
        leaves.append((value, by))
    leaves.sort(key=lambda v: -len(v[1]))
    m, n, bin_ = max(1, len(leaves[0][1])), len(tree), np.arange(boost.BINS)
    z, free, of, bits = np.ones((m, n, 1)), np.ones((m, n, 1), bool), np.zeros((m, n, features)), {}
    for leaf, (_, by) in enumerate(leaves):
        for i, (f, (lo, hi, share)) in enumerate(by.items()):
            z[i, leaf], free[i, leaf], of[i, leaf, f] = share, False, 1
            bits.setdefault(f, np.zeros((boost.BINS, n), np.uint8))[:, leaf] = ((bin_ > lo) & (bin_ <= hi)).astype(np.uint8) << i
    ok = np.where(free, 1.0, np.arange(1 << m) >> np.arange(m)[:, None, None] & 1)  # [place, leaf, bits]
    poly = np.zeros((m, m, n, 1 << m))  # [power, place that is left out, leaf, bits]
    poly[0] = 1
    for j in range(m):
        rest = np.arange(m) != j
        more = poly[:, rest] * z[j]
        more[1:] += poly[:-1, rest] * ok[j]
        poly[:, rest] = more
    weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
    pays = np.array([value for value, _ in leaves])[:, None] * (ok - z) * np.tensordot(weight, poly, 1)
    return bits, pays.reshape(m, -1), of


def binned_shap(trees: list, bins: np.ndarray, features: int) -> np.ndarray:
    """The Shapley values of tree_shap [row, feature] for rows of bins [row, feature], trees of at most SHAP_DEPTH levels: by a table for each tree."""
    out = np.zeros((len(bins), features))
    for tree in trees:
        bits, pays, of = _leaf_tables(tree, features)
        have = of.any(axis=2).sum(axis=1)  # the first leaves have the most places
        start = np.arange(len(tree)) * (pays.shape[1] // len(tree))
        for lo in range(0, len(bins) if bits else 0, SHAP_BLOCK):
            some = bins[lo : lo + SHAP_BLOCK]
            at = np.zeros((len(some), len(tree)), np.uint8)
            for f, set_ in bits.items():
                at |= set_.take(some[:, f], axis=0)
            at = start + at
            for own, to, k in zip(pays, of, have, strict=True):
                out[lo : lo + SHAP_BLOCK] += own.take(at[:, :k], mode="clip") @ to[:k]
    return out


def mean_abs_shap(model: boost.Boosted, df: DataFrame, features: int) -> np.ndarray:
    """[fold, feature]: mean absolute contribution to the margins over the rows that the fold is judged by, and over classes.

    Rows of the same bins have the same contributions, so they are counted first; sums are made where the counts are. Tasks have ranges
    of the order by fold and bins, so that a task makes the tables of few folds only. A fold without rows has zeros.
    """
    folds, n = model.folds, model.outputs
    sent = df.sparkSession.sparkContext.broadcast(model)
    fold = F.coalesce(*[F.when(folds.validates(k, folds.part()), F.lit(k)) for k in range(folds.n)])
    rows = boost.in_bins(df.filter(fold.isNotNull()), model.columns, model.at, {"fold": fold.cast("int")})
    rows = stored(rows.groupBy("fold", "bins").agg(F.count("*").alias("w")), "shap-cells")
    tasks = max(1, min(-(-rows.count() // SHAP_ROWS), 10_000))

    def run(batches):
        import pandas as pd

        boosted = sent.value
        total, count, width = np.zeros((folds.n, features)), np.zeros(folds.n, np.int64), len(boosted.columns)
        got = [(np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), width), pdf["fold"].to_numpy(), pdf["w"].to_numpy()) for pdf in batches]
        bins, at, w = (np.concatenate(v) for v in zip(*got, strict=True)) if got else (np.zeros((0, width), np.uint8), *np.zeros((2, 0), np.int64))
        for k in np.unique(at):
            own, n_rows = np.ascontiguousarray(bins[at == k][:, boosted.use[k]]), w[at == k]
            count[k] += n_rows.sum()
            for c in range(n):
                trees = boosted.leaves(k, c)
                each = binned_shap(trees, own, features) if boosted.depth <= SHAP_DEPTH else tree_shap(trees, own.astype(float))[0]
                total[k] += n_rows @ np.abs(each) / n
        yield pd.DataFrame({"fold": np.repeat(range(folds.n), features), "i": np.tile(range(features), folds.n), "s": total.ravel(), "n": np.repeat(count, features)})

    line = rows.repartitionByRange(tasks, "fold", "bins") if tasks > 1 else rows.repartition(1)
    got = line.sortWithinPartitions("fold", "bins").mapInPandas(run, "fold int, i int, s double, n bigint").groupBy("fold", "i").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("v")).collect()
    dropped(rows)
    out = np.zeros((folds.n, features))
    for r in got:
        out[r["fold"], r["i"]] = r["v"] or 0.0
    return out
