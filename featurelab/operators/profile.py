"""Profiles of columns and their kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.order import counted_percentiles, percentiles
from ..functions.shared import stored
from ..functions.stats import TOP, skewness, top_values

FEW = 20


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType | T.BooleanType)


def numeric_columns(df: DataFrame, boolean: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) or (boolean and isinstance(f.dataType, T.BooleanType))]


def _text(f: T.StructField) -> Column:
    """A value as text that tells different values apart: both zeros are one, bytes are base 64, nested values JSON."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.FloatType | T.DoubleType):
        return F.when(c == 0, F.lit(0.0).cast(f.dataType)).otherwise(c).cast("string")
    if isinstance(f.dataType, T.BinaryType):
        return F.base64(c)
    return F.to_json(F.struct(c)) if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.VariantType) else c.cast("string")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """i (place of the column in `columns`), value (text), n: how often each value of each column occurs, null left out.

    All columns go through one exchange of counts that are summed up where the rows are.
    """
    fields = {f.name: f for f in df.schema.fields}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _text(fields[c]).alias("value")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    return long.filter("value is not null").groupBy("i", "value").agg(F.count("*").alias("n"))


def _with_distinct(df: DataFrame, columns: list[str], rows: DataFrame, name: str) -> DataFrame:
    """rows (a row for each column, with its place i) and the number of its different values."""
    distinct = value_counts(df, columns).groupBy("i").agg(F.count("*").alias(name))
    return rows.join(F.broadcast(distinct), "i", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def profile(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """column, cardinality, missingness_rate, mean, std (0.0 for columns without numbers). A scan for the moments, one for the values."""
    names = [c for c in df.columns if c not in (exclude or [])]
    number = {c: F.col(f"`{c}`").cast("double") for c in names if is_numeric(df, c)}
    aggs = []
    for i, c in enumerate(names):
        aggs.append(F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"m{i}"))
        x = number.get(c)
        aggs += [(F.coalesce(F.avg(x), F.lit(0.0)) if x is not None else F.lit(0.0)).alias(f"a{i}"), (F.coalesce(F.stddev_samp(x), F.lit(0.0)) if x is not None else F.lit(0.0)).alias(f"s{i}")]
    row = df.agg(*aggs)
    rows = row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.col(f"m{i}").alias("missingness_rate"), F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, c in enumerate(names)])).alias("x")).select("x.*")
    return _with_distinct(df, names, rows, "cardinality").select("column", "cardinality", "missingness_rate", "mean", "std")


def quantiles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, p5, p25, p75, p95 (linear), skewness. Booleans count as 0 and 1."""
    names = columns or numeric_columns(df, boolean=True)
    q = percentiles(df, {c: F.col(c) for c in names}, [0.05, 0.25, 0.75, 0.95]) if names else {}
    row = df.agg(*[skewness(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(names)])
    item = lambda i, k: F.lit(q[names[i]][k]).cast("double")
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), item(i, 0).alias("p5"), item(i, 1).alias("p25"), item(i, 2).alias("p75"), item(i, 3).alias("p95"), F.col(f"s{i}").alias("skewness")) for i, c in enumerate(names)])).alias("x")).select("x.*")


def top5(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n, place of the most frequent values of each column, in one shuffle over (column, value) counts."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    return top_values(long, "v", ["column"])


def kinds(df: DataFrame, few: int = FEW) -> DataFrame:
    """column, n_distinct, kind: numbers with fewer than `few` values, text, booleans and dates are categorical."""
    numbers = set(numeric_columns(df))
    rows = df.sparkSession.createDataFrame([(i, c, c in numbers) for i, c in enumerate(df.columns)], "i int, column string, number boolean")
    kind = F.when(F.col("number") & (F.col("n_distinct") >= few), "numeric").otherwise("categorical")
    return _with_distinct(df, df.columns, rows, "n_distinct").select("column", "n_distinct", kind.alias("kind"))


EXTENDED = "column string, p5 double, p25 double, p75 double, p95 double, skewness double, top5_values array<string>, top5_counts array<bigint>, missingness_group int"


def extended(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """EXTENDED: quantiles (linear) and skewness of numbers and booleans, the most frequent values of every column as text (ties by
    value), and the group of columns whose values are missing together (null without missing values, or if no other column has some).

    Quantiles and frequent values come from one table of counted values; missing values count nowhere but for the groups.
    """
    from .discover import missingness_groups

    names = columns or df.columns
    if not names:
        return df.sparkSession.createDataFrame([], EXTENDED)
    kinds_ = {f.name: f.dataType for f in df.schema.fields}
    numbers = [c for c in names if isinstance(kinds_[c], T.NumericType | T.BooleanType)]
    counts = stored(value_counts(df, names), "profile-values")
    truth = [i for i, c in enumerate(names) if isinstance(kinds_[c], T.BooleanType)]
    number = F.when(F.col("i").isin(truth), (F.col("value") == "true").cast("double")).otherwise(F.col("value").try_cast("double"))
    own = counts.filter(F.col("i").isin([i for i, c in enumerate(names) if c in numbers])).select(F.array(*map(F.lit, names))[F.col("i")].alias("name"), number.alias("v"), "n")
    quantile = {c: q for (c, _), q in counted_percentiles(own, ["n"], [0.05, 0.25, 0.75, 0.95]).items()} if numbers else {}
    row = df.agg(*[skewness(F.col(f"`{c}`").cast("double")).alias(f"s{i}") for i, c in enumerate(numbers)]).first() if numbers else None
    skew = {c: row[f"s{i}"] for i, c in enumerate(numbers)}
    top: dict[str, list] = {}
    for r in top_values(counts.withColumnRenamed("n", "_n"), "value", ["i"], TOP, "_n").orderBy("i", "place").collect():  # at most TOP for each column
        top.setdefault(names[r["i"]], []).append((r["value"], r["n"]))
    group = {r["column"]: r["missingness_group"] for r in missingness_groups(df, names).collect()}  # one row for each column
    rows = [(c, *quantile.get(c, [None] * 4), skew.get(c), [v for v, _ in top.get(c, [])], [n for _, n in top.get(c, [])], group.get(c)) for c in names]
    return df.sparkSession.createDataFrame(rows, EXTENDED)
