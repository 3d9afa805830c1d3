"""Features with a state that is learned from each fold's training rows, for all folds at once.

A feature is a column for every fold (or one column, if nothing is learned). Statistics are stacked: each family takes one
aggregation over the rows for all of its columns and all folds. Moments come by part and are merged for the parts that a fold
trains on; quantiles come from counted values with a weight for each fold; categories have sums and counts by part, from which a
fold takes its training parts (all but its own, or a prefix of the chunks of time), and out-of-fold encoding also leaves out the
part of the row. Tables of categories are joined: Spark sends them to all tasks if they are small, else splits the partitions of
frequent values. Missing values and categories stay as the transforms of one training frame have them (transforms.py).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio
from ..functions.order import counted, counted_percentiles
from ..functions.shared import stored
from . import transforms as tf
from .splits import Folds

#: Name in a specification -> transform without a state.
STATELESS = {
    "log": tf.log, "sqrt": tf.sqrt, "power": tf.power, "reciprocal": tf.reciprocal, "abs": tf.absolute, "dow": tf.day_of_week, "month": tf.month, "year": tf.year,
    "since": tf.time_since, "weekend": tf.is_weekend, "season": tf.season, "onehot": tf.onehot, "product": tf.product, "ratio": tf.quotient,
    "difference": tf.difference, "sum": tf.total,
}
MOMENTS, QUANTILES, CATEGORIES, GROUPS = ("zscore", "minmax", "wbin"), ("clip", "qbin"), ("count", "frequency", "target", "oof"), ("group_mean", "group_std")
OTHER = ("ordinal", "bin", "label", "cluster")
KINDS = (*STATELESS, *MOMENTS, *QUANTILES, *CATEGORIES, *GROUPS, *OTHER)


@dataclass(frozen=True)
class FoldFeature:
    """kind and arguments, as in a specification kind:argument:argument."""

    kind: str
    args: tuple[str, ...]

    @classmethod
    def parse(cls, text: str) -> FoldFeature | None:
        """None if text is no specification (a column or an expression)."""
        kind, *args = text.split(":")
        if not args or kind not in KINDS:
            return None
        return cls(kind, tuple(args))

    @property
    def name(self) -> str:
        return ":".join([self.kind, *self.args])

    @property
    def inputs(self) -> tuple[str, ...]:
        """Columns that are read, besides the target of an encoding."""
        if self.kind in ("product", "ratio", "difference", "sum", *GROUPS):
            return self.args
        return self.args[1:] if self.kind == "cluster" else self.args[:1]

    def number(self, i: int, default: float) -> float:
        return float(self.args[i]) if len(self.args) > i else default


def stacked(df: DataFrame, features: Sequence[FoldFeature], target: str, folds: Folds) -> tuple[DataFrame, dict[str, list[str]]]:
    """df with the features' columns, and where each is: one column, or a column for each fold. target is a number."""
    for f in features:
        if missing := [c for c in f.inputs if c not in df.columns]:
            raise ValueError(f"{f.name} reads columns that are not there: {missing}")
        if target in f.inputs:
            raise ValueError(f"{f.name} reads the target")
    places = {f.name: [f"_s{i}_{k}" for k in range(folds.n)] for i, f in enumerate(features)}
    of = lambda kinds: [f for f in features if f.kind in kinds]
    alone, source = {}, df
    for f in features:
        made = _alone(f)
        if made is not None:
            places[f.name] = places[f.name][:1]
            alone[places[f.name][0]] = made
    out = df.withColumns(alone) if alone else df
    for kinds, add in ((MOMENTS, _moments), (QUANTILES, _quantiles), (CATEGORIES, _categories), (("label",), _labels), (GROUPS, _groups), (("cluster",), _clusters)):
        if some := of(kinds):
            out = add(out, source, some, places, target, folds)
    return out, places


def _number(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def _alone(f: FoldFeature) -> Column | None:
    if f.kind in STATELESS:
        args = [float(a) if f.kind == "power" and i else a for i, a in enumerate(f.args)]
        return STATELESS[f.kind](*args).make(None)
    if f.kind == "ordinal":
        return tf.ordinal(f.args[0], list(f.args[1:])).make(None)
    return tf.custom_bin(f.args[0], [float(a) for a in f.args[1:]]).make(None) if f.kind == "bin" else None


def _parts(folds: Folds) -> list[int]:
    return [0] if folds.column is None else list(range(1, folds.n + 2)) if folds.column == "chunk" else list(range(folds.n))


def merged(parts: list[tuple[int, float, float]]) -> tuple[int, float, float]:
    """Count, mean and sum of squared deviations of rows in parts that have these (pairwise, so that nothing cancels)."""
    n, mean, square = 0, 0.0, 0.0
    for m, other, s in parts:
        if m:
            d, both = other - mean, n + m
            mean, square, n = mean + d * m / both, square + s + d * d * n * m / both, both
    return n, mean, square


def _moments(out: DataFrame, source: DataFrame, features, places, target: str, folds: Folds) -> DataFrame:
    columns = list(dict.fromkeys(f.args[0] for f in features))
    aggs = [a for i, c in enumerate(columns) for a in (F.count(_number(c)).alias(f"n{i}"), F.avg(_number(c)).alias(f"m{i}"), F.var_pop(_number(c)).alias(f"v{i}"), F.min(_number(c)).alias(f"l{i}"), F.max(_number(c)).alias(f"h{i}"))]
    rows = source.groupBy(folds.part().alias("_part")).agg(*aggs).collect()  # one row for each part
    new = {}
    for f in features:
        i, x = columns.index(f.args[0]), _number(f.args[0])
        for k, name in enumerate(places[f.name]):
            mine = [r for r in rows if r["_part"] is not None and folds.trains(k, r["_part"]) and r[f"n{i}"]]
            n, mean, square = merged([(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"] * r[f"n{i}"]) for r in mine])
            low, high = min((r[f"l{i}"] for r in mine), default=None), max((r[f"h{i}"] for r in mine), default=None)
            if f.kind == "zscore":
                new[name] = ratio(x - F.lit(mean), F.lit(math.sqrt(square / (n - 1)) if n > 1 else None).cast("double"))
            elif f.kind == "minmax":
                new[name] = ratio(x - F.lit(low).cast("double"), F.lit(None if low is None else high - low).cast("double"))
            else:
                new[name] = tf.equal_width_bin(f.args[0], int(f.number(1, 10))).make((low, high))
    return out.withColumns(new)


def _quantiles(out: DataFrame, source: DataFrame, features, places, target: str, folds: Folds) -> DataFrame:
    columns = list(dict.fromkeys(f.args[0] for f in features))
    asked = {f: [f.number(1, 0.01), f.number(2, 0.99)] if f.kind == "clip" else [i / int(f.number(1, 10)) for i in range(int(f.number(1, 10)) + 1)] for f in features}
    at, weights = sorted({p for ps in asked.values() for p in ps}), [f"w{k}" for k in range(folds.n)]
    counts = counted(source, {c: _number(c) for c in columns}, {w: F.count_if(folds.trains(k, folds.part())) for k, w in enumerate(weights)})
    got, new = counted_percentiles(counts, weights, at), {}
    for f in features:
        for k, name in enumerate(places[f.name]):
            known = got.get((f.args[0], weights[k]))
            q = [known[at.index(p)] if known else None for p in asked[f]]
            state = q if f.kind == "clip" else sorted({x for x in q if x is not None})[1:-1]
            new[name] = (tf.clip(f.args[0]) if f.kind == "clip" else tf.quantile_bin(f.args[0])).make(state)
    return out.withColumns(new)


def category_sums(df: DataFrame, columns: list[str], target: str, folds: Folds) -> DataFrame:
    """name, value, n, s, m (arrays with an item for each part): rows of each category, the sum of the target and how many it is there for."""
    y = F.col(f"`{target}`").cast("double")
    long = df.select(folds.part().alias("_part"), y.alias("_y"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("_x"))
    own = [F.col("_part") == p for p in _parts(folds)]
    arrays = {
        "n": [F.count_if(o) for o in own], "s": [F.coalesce(F.sum(F.when(o, F.col("_y"))), F.lit(0.0)) for o in own], "m": [F.count(F.when(o, F.col("_y"))) for o in own],
    }
    return long.filter("_x.value is not null").groupBy("_x.name", "_x.value").agg(*[F.array(*a).alias(k) for k, a in arrays.items()])


def _categories(out: DataFrame, source: DataFrame, features, places, target: str, folds: Folds) -> DataFrame:
    parts, columns = _parts(folds), list(dict.fromkeys(f.args[0] for f in features))
    table = stored(category_sums(source, columns, target, folds), "fold-categories")
    y = F.col(f"`{target}`").cast("double")
    row = source.agg(*folds.sums(F.lit(1)), *folds.sums(y), *folds.sums(F.lit(1), y.isNotNull())).first()
    zero = lambda v: F.coalesce(v, F.lit(0))
    for j, c in enumerate(columns):
        t = table.filter(F.col("name") == c).select(F.col("value").alias("_v"), "n", "s", "m").withColumnsRenamed({k: f"_{k}" for k in "nsm"})
        out = out.join(t, out[c].cast("string") == t["_v"], "left")
        new = {}
        for f in (f for f in features if f.args[0] == c):
            for k, name in enumerate(places[f.name]):
                mine = [i for i, p in enumerate(parts) if folds.trains(k, p)]
                rows, all_y, with_y = row[k] or 0, row[folds.n + k], row[2 * folds.n + k] or 0

                def total(a: str, but_own: bool) -> Column:
                    items = [F.when(folds.part() != parts[i], zero(F.col(a)[i])).otherwise(0) if but_own else zero(F.col(a)[i]) for i in mine]
                    return sum(items[1:], items[0])

                if f.kind == "count":
                    new[name] = total("_n", False)
                elif f.kind == "frequency":
                    new[name] = total("_n", False) / F.lit(float(max(rows, 1)))
                else:
                    s, m = total("_s", f.kind == "oof"), total("_m", f.kind == "oof")
                    new[name] = F.coalesce(F.when(m > 0, s / F.nullif(m, F.lit(0))), F.lit(all_y / with_y if with_y else None).cast("double"))
        out = out.withColumns(new).drop("_v", "_n", "_s", "_m")
    return out


def _labels(out: DataFrame, source: DataFrame, features, places, target: str, folds: Folds) -> DataFrame:
    from .guard import fold_codes

    columns = list(dict.fromkeys(f.args[0] for f in features))
    codes = stored(fold_codes(source, columns, None, folds), "fold-labels")
    for c in columns:
        t = codes.filter(F.col("name") == c).select(F.col("value").alias("_v"), F.col("codes").alias("_c"))
        out = out.join(t, out[c].cast("string") == t["_v"], "left")
        new = {name: F.when(F.col(f"`{c}`").isNotNull(), F.coalesce(F.col("_c")[k], F.lit(-1.0))) for f in features if f.args[0] == c for k, name in enumerate(places[f.name])}
        out = out.withColumns(new).drop("_v", "_c")
    return out


def _groups(out: DataFrame, source: DataFrame, features, places, target: str, folds: Folds) -> DataFrame:
    cells: dict[tuple[str, ...], list[FoldFeature]] = {}
    for f in features:
        cells.setdefault(f.args[1:], []).append(f)
    for cell, some in cells.items():
        key = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(cell)]))
        whole = F.lit(True)
        for c in cell:
            whole = whole & F.col(f"`{c}`").isNotNull()
        aggs = [(F.avg if f.kind == "group_mean" else F.stddev_samp)(F.when(folds.trains(k, folds.part()), _number(f.args[0]))).alias(name) for f in some for k, name in enumerate(places[f.name])]
        table = stored(source.filter(whole).groupBy(key.alias("_v")).agg(*aggs), "fold-cells")
        out = out.withColumn("_k", F.when(whole, key))
        out = out.join(table, out["_k"] == table["_v"], "left").drop("_k", "_v")
    return out


def _clusters(out: DataFrame, source: DataFrame, features, places, target: str, folds: Folds) -> DataFrame:
    """k-means is fitted fold by fold; there is nothing to share."""
    for f in features:
        k, own = int(f.args[0]), {f"_k{i}": _number(c) for i, c in enumerate(f.args[1:])}  # copies, as missing values are filled in
        for fold, name in enumerate(places[f.name]):
            train = source.filter(folds.trains(fold, folds.part())).select(*[c.alias(n) for n, c in own.items()])
            out = tf.clustering(train, out.withColumns(own), list(own), k, name="_cluster").withColumn(name, F.col("_cluster").cast("double")).drop("_cluster", *own)
    return out
