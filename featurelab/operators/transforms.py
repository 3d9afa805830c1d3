"""Feature transforms. Each declares the columns it reads; statistics are fitted on training rows only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expr import finite, ratio
from ..functions.order import percentiles

#: Categories of a one-hot encoding at most.
MOST_COLUMNS = 10_000


@dataclass(frozen=True)
class Transform:
    """A column computed from inputs: ``make`` takes what ``fit`` learned from training rows."""

    name: str
    family: str
    inputs: tuple[str, ...]
    make: Callable[[object], Column]
    fit: Callable[[DataFrame], object] = lambda df: None

    def apply(self, train: DataFrame, df: DataFrame) -> DataFrame:
        missing = [c for c in self.inputs if c not in df.columns]
        if missing:
            raise ValueError(f"{self.name} reads columns that are not there: {missing}")
        return df.withColumn(self.name, self.make(self.fit(train.select(*self.inputs))))


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def log(c: str, name: str | None = None) -> Transform:
    return Transform(name or f"log_{c}", "log", (c,), lambda _: F.when(_num(c) > -1, F.log1p(_num(c))))


def sqrt(c: str, name: str | None = None) -> Transform:
    return Transform(name or f"sqrt_{c}", "sqrt", (c,), lambda _: F.when(_num(c) >= 0, F.sqrt(_num(c))))


def power(c: str, exponent: float = 2.0, name: str | None = None) -> Transform:
    return Transform(name or f"power_{c}", "power", (c,), lambda _: finite(F.pow(_num(c), F.lit(exponent))))


def reciprocal(c: str, name: str | None = None) -> Transform:
    return Transform(name or f"reciprocal_{c}", "reciprocal", (c,), lambda _: ratio(F.lit(1.0), _num(c)))


def absolute(c: str, name: str | None = None) -> Transform:
    return Transform(name or f"abs_{c}", "abs", (c,), lambda _: F.abs(_num(c)))


def clip(c: str, low: float = 0.01, high: float = 0.99, name: str | None = None) -> Transform:
    fit = lambda df: percentiles(df, {c: _num(c)}, [low, high])[c]
    return Transform(name or f"clip_{c}", "clip", (c,), lambda q: F.when(_num(c).isNotNull(), F.least(F.greatest(_num(c), F.lit(q[0])), F.lit(q[1]))) if q[0] is not None else _num(c), fit)


def zscore(c: str, name: str | None = None) -> Transform:
    fit = lambda df: df.agg(F.avg(_num(c)), F.stddev_samp(_num(c))).first()
    return Transform(name or f"z_{c}", "normalize", (c,), lambda s: ratio(_num(c) - F.lit(s[0]).cast("double"), F.lit(s[1]).cast("double")), fit)


def minmax(c: str, name: str | None = None) -> Transform:
    fit = lambda df: df.agg(F.min(_num(c)), F.max(_num(c))).first()
    return Transform(name or f"unit_{c}", "normalize", (c,), lambda s: ratio(_num(c) - F.lit(s[0]).cast("double"), (F.lit(s[1]) - F.lit(s[0])).cast("double")), fit)


def day_of_week(c: str, name: str | None = None) -> Transform:
    """0 is Monday."""
    return Transform(name or f"dow_{c}", "day_of_week", (c,), lambda _: F.weekday(c))


def month(c: str, name: str | None = None) -> Transform:
    return Transform(name or f"month_{c}", "month", (c,), lambda _: F.month(c))


def year(c: str, name: str | None = None) -> Transform:
    return Transform(name or f"year_{c}", "year", (c,), lambda _: F.year(c))


def time_since(c: str, reference: str, name: str | None = None) -> Transform:
    return Transform(name or f"since_{c}", "time_since", (c,), lambda _: F.datediff(c, F.lit(reference).cast("date")))


def is_weekend(c: str, name: str | None = None) -> Transform:
    return Transform(name or f"weekend_{c}", "is_weekend", (c,), lambda _: (F.weekday(c) >= 5).cast("int"))


def season(c: str, name: str | None = None) -> Transform:
    """0 winter (December to February) to 3 autumn."""
    return Transform(name or f"season_{c}", "season", (c,), lambda _: F.floor((F.month(c) % 12) / 3).cast("int"))


def onehot(c: str, value: str) -> Transform:
    return Transform(f"{c}_is_{value}", "onehot", (c,), lambda _: F.when(F.col(c).isNotNull(), (F.col(c) == value).cast("int")).otherwise(0))


def onehot_all(train: DataFrame, c: str) -> list[Transform]:
    """One transform for each category of the training rows, sorted. Each is a column, so more than MOST_COLUMNS are an error."""
    found = [r[0] for r in train.select(F.col(c).cast("string")).distinct().filter(F.col(c).isNotNull()).orderBy(c).limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"{c} has more than {MOST_COLUMNS} categories: take an encoding with one column")
    return [onehot(c, v) for v in found]


def ordinal(c: str, order: list[str], name: str | None = None) -> Transform:
    pairs = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return Transform(name or f"ordinal_{c}", "ordinal", (c,), lambda _: F.when(F.col(c).isNotNull(), F.coalesce(F.try_element_at(pairs, F.col(c)), F.lit(-1))))


def product(a: str, b: str, name: str | None = None) -> Transform:
    return Transform(name or f"{a}_x_{b}", "product", (a, b), lambda _: _num(a) * _num(b))


def quotient(a: str, b: str, name: str | None = None) -> Transform:
    return Transform(name or f"{a}_per_{b}", "ratio", (a, b), lambda _: ratio(_num(a), _num(b)))


def difference(a: str, b: str, name: str | None = None) -> Transform:
    return Transform(name or f"{a}_less_{b}", "difference", (a, b), lambda _: _num(a) - _num(b))


def total(a: str, b: str, name: str | None = None) -> Transform:
    return Transform(name or f"{a}_plus_{b}", "sum", (a, b), lambda _: _num(a) + _num(b))


def _above(c: str, edges: list[float]) -> Column:
    out = F.lit(0)
    for e in edges:
        out = out + F.when(_num(c) > e, 1).otherwise(0)
    return F.when(F.col(c).isNotNull(), out)


def quantile_bin(c: str, bins: int = 10, name: str | None = None) -> Transform:
    """Bins closed at the right; equal edges fall together."""
    def fit(df: DataFrame) -> list[float]:
        q = percentiles(df, {c: _num(c)}, [i / bins for i in range(bins + 1)])[c]
        return sorted({x for x in q if x is not None})[1:-1]

    return Transform(name or f"qbin_{c}", "quantile_bin", (c,), lambda edges: _above(c, edges), fit)


def equal_width_bin(c: str, bins: int = 10, name: str | None = None) -> Transform:
    """Bins closed at the left, 0 .. bins - 1; values outside the training range fall into the outer bins."""
    def make(s) -> Column:
        lo, hi = s
        if lo is None or hi == lo:
            return F.when(F.col(c).isNotNull(), 0)
        i = F.floor((_num(c) - F.lit(lo)) * bins / F.lit(hi - lo))
        return F.when(F.col(c).isNotNull(), F.least(F.greatest(i, F.lit(0)), F.lit(bins - 1)).cast("int"))

    return Transform(name or f"wbin_{c}", "equal_width_bin", (c,), make, lambda df: df.agg(F.min(_num(c)), F.max(_num(c))).first())


def custom_bin(c: str, edges: list[float], name: str | None = None) -> Transform:
    return Transform(name or f"bin_{c}", "custom_bin", (c,), lambda _: _above(c, edges))


def _joined(df: DataFrame, c: str, table: DataFrame) -> DataFrame:
    t = table.withColumnRenamed(c, "_key")
    return df.join(t, df[c] == t["_key"], "left").drop("_key")


def count_encoding(train: DataFrame, df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    """Occurrences of the category in the training rows; 0 if unseen or missing."""
    name = name or f"count_{c}"
    return _joined(df, c, train.groupBy(c).agg(F.count("*").alias(name))).withColumn(name, F.coalesce(name, F.lit(0)))


def frequency_encoding(train: DataFrame, df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    name, n = name or f"freq_{c}", train.count()
    got = count_encoding(train, df, c, name)
    return got.withColumn(name, F.col(name) / F.lit(float(max(n, 1))))


def label_encoding(train: DataFrame, df: DataFrame, c: str, name: str | None = None) -> DataFrame:
    """Place of the category in sorted order, from 0; -1 if unseen."""
    from .guard import label_index

    name = name or f"label_{c}"
    codes = label_index(train, c).select(F.col("value").alias("_key"), F.col("code").alias(name))
    return df.join(codes, df[c].cast("string") == codes["_key"], "left").drop("_key").withColumn(name, F.when(F.col(c).isNotNull(), F.coalesce(name, F.lit(-1))))


def target_encoding(train: DataFrame, df: DataFrame, c: str, target: str, name: str | None = None) -> DataFrame:
    """Mean target of the category in the training rows; the global mean if unseen."""
    name = name or f"target_{c}"
    overall = train.agg(F.avg(target)).first()[0]
    return _joined(df, c, train.groupBy(c).agg(F.avg(target).alias(name))).withColumn(name, F.coalesce(name, F.lit(overall).cast("double")))


def target_encoding_oof(df: DataFrame, c: str, target: str, fold: str, name: str | None = None) -> DataFrame:
    """Mean target of the category over the other folds, so that no row's own label is in its value; global mean if there is none."""
    name = name or f"oof_{c}"
    overall = df.agg(F.avg(target)).first()[0]
    parts = df.groupBy(c, fold).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    parts = parts.withColumnsRenamed({c: "_c", fold: "_f"})
    w = Window.partitionBy("_c")  # one row for each category and fold
    others, rest = F.col("_count") - F.col("_n"), F.col("_sum") - F.coalesce("_s", F.lit(0))
    table = parts.withColumns({"_sum": F.sum("_s").over(w), "_count": F.sum("_n").over(w)}).select("_c", "_f", F.when(others > 0, rest / F.when(others > 0, others)).alias(name))
    got = df.join(table, df[c].eqNullSafe(table["_c"]) & (df[fold] == table["_f"]), "left").drop("_c", "_f")
    return got.withColumn(name, F.coalesce(name, F.lit(overall).cast("double")))


def group_aggregate(train: DataFrame, df: DataFrame, cell: list[str], c: str) -> DataFrame:
    """mean and std of c by cell in the training rows, joined to df."""
    t = train.groupBy(*cell).agg(F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))
    return df.join(t, cell, "left")


def clustering(train: DataFrame, df: DataFrame, columns: list[str], k: int = 8, seed: int = 42, name: str = "cluster") -> DataFrame:
    """k-means cell of the (imputed, scaled) columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from .guard import impute, medians

    values = medians(train, columns)
    stages = [VectorAssembler(inputCols=columns, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_z", withMean=True), KMeans(k=k, seed=seed, featuresCol="_z", predictionCol=name)]
    model = Pipeline(stages=stages).fit(impute(train, values, 0.0))
    return model.transform(impute(df, values, 0.0)).drop("_v", "_z")


def lineage(transforms: list[Transform]) -> list[tuple[str, str]]:
    """(feature, column) for all declared inputs."""
    return [(t.name, c) for t in transforms for c in t.inputs]
