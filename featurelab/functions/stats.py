"""Column statistics as aggregations. Missing values are NULL; undefined results are NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import gram
from .order import group_percentiles, parts, percentiles, with_before
from .shared import stored

MIN_GROUP, INVARIANT_CV, TOP = 10, 0.1, 5


def present(*columns: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns], F.lit(True))


def pearson(x: Column, y: Column) -> Column:
    """Over rows where both are there; NULL if either is constant."""
    a, b = F.when(present(x, y), x.cast("double")), F.when(present(x, y), y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / F.when(spread > 0, spread))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks from 1 with ties at their mean. Counts of distinct values are ranked, in ranges of the order."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    line = with_before(parts(counts, [column]), F.col("_n"), "_earlier")
    ranks = line.select(F.col(column).alias("_v"), (F.col("_earlier") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, df[column] == ranks["_v"]).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: spearman."""
    both = df.select(x, y).filter(present(F.col(x), F.col(y)))
    return average_ranks(average_ranks(both, x, "_rx"), y, "_ry").agg(pearson(F.col("_rx"), F.col("_ry")).alias("spearman"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pearson, spearman, n_complete."""
    first = df.agg(pearson(F.col(x), F.col(y)).alias("pearson"), F.count_if(present(F.col(x), F.col(y))).alias("n_complete"))
    return first.crossJoin(spearman(df, x, y))  # one row each


def correlated_pairs(df: DataFrame, columns: list[str], above: float = 0.8) -> DataFrame:
    """col_a, col_b, correlation (4 places) of pairs with a larger absolute value."""
    long = gram.pairs(df, {c: F.col(c) for c in columns})
    return long.filter(F.abs("r") > above).select("col_a", "col_b", F.round("r", 4).alias("correlation"))


def group_stats(df: DataFrame, value: Column, keys: list[str], min_group: int = MIN_GROUP) -> DataFrame:
    """keys, mean, std, n of groups with at least min_group values. Rows without a key or value don't count."""
    rows = df.select(*keys, value.alias("_v")).filter(present(*[F.col(k) for k in keys], F.col("_v")))
    got = rows.groupBy(*keys).agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.count("_v").alias("n"))
    return got.filter(F.col("n") >= min_group)


def with_cv(groups: DataFrame) -> DataFrame:
    return groups.withColumn("cv", F.when(F.abs("mean") > 0, F.col("std") / F.when(F.abs("mean") > 0, F.abs("mean"))))


def variation(df: DataFrame, value: Column, keys: list[str], min_group: int = MIN_GROUP) -> DataFrame:
    """One row: median_cv, mean_cv, n_groups (also those without a cv), n_invariant."""
    g = stored(with_cv(group_stats(df, value, keys, min_group)).select("cv"), "group-cv")
    middle = percentiles(g, {"cv": F.col("cv")}, [0.5])["cv"][0]
    return g.agg(F.lit(middle).cast("double").alias("median_cv"), F.avg("cv").alias("mean_cv"), F.count("*").alias("n_groups"), F.count_if(F.col("cv") < INVARIANT_CV).alias("n_invariant"))


def most_invariant(df: DataFrame, value: Column, keys: list[str], top: int = TOP) -> DataFrame:
    g = with_cv(group_stats(df, value, keys)).filter("cv is not null")
    return g.orderBy("cv", *keys).limit(top)


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_distinct (no nulls), n_missing. A branch for each column: its values are counted where they are, then once over all."""
    out = None
    for c in columns:
        counts = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        part = counts.agg(F.count("v").alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_missing")).select(F.lit(c).alias("column"), "n_distinct", "n_missing")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame([], "column string, n_distinct bigint, n_missing bigint")
    return out


def pair_cardinality(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """col_a, col_b, n_groups: distinct pairs without nulls, a branch for each pair."""
    out = None
    for a, b in pairs:
        part = df.select(a, b).filter(present(F.col(a), F.col(b))).distinct().agg(F.count("*").alias("n_groups")).select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), "n_groups")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, n_groups bigint")
    return out


def combined_cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n_groups without rows that miss a key."""
    return df.agg(F.count_distinct(*columns).alias("n_groups"))


def largest_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("size")).orderBy(F.desc("size"), key).limit(n)


def conditional_distribution(df: DataFrame, column: str, key: str, n_groups: int = 5) -> DataFrame:
    """key, n, mean, std, p25, median, p75 in the n_groups largest groups; groups without values are left out."""
    rows = df.join(F.broadcast(largest_groups(df, key, n_groups)).select(key), key, "left_semi")
    got = rows.groupBy(key).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    q = group_percentiles(rows, [key], F.col(column), [0.25, 0.5, 0.75]).select(key, "q")  # a row for each of the groups
    return got.filter("n > 0").join(F.broadcast(q), key).select(key, "n", "mean", "std", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"))


def top_values(df: DataFrame, column: str, by: list[str] | None = None, top: int = TOP, times: str | None = None) -> DataFrame:
    """by, value (as text), count of the most frequent values; ties by value. times: a column that says how often a row counts."""
    by = by or []
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg((F.sum(times) if times else F.count("*")).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), column)
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select(*by, F.col(column).cast("string").alias("value"), "n", F.col("place").cast("bigint"))


def conditional_top_values(df: DataFrame, column: str, key: str, n_groups: int = 5, top: int = TOP) -> DataFrame:
    rows = df.join(F.broadcast(largest_groups(df, key, n_groups)).select(key), key, "left_semi")
    return top_values(rows, column, [key], top)


def skewness(c: Column) -> Column:
    """Bias-adjusted; 0 for a constant, NULL below 3 values."""
    n = F.count(c).cast("double")
    flat = F.stddev_pop(c) == 0
    return F.when(n < 3, None).when(flat, 0.0).otherwise(F.skewness(F.when(c.isNotNull(), c)) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def icc(df: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """One row: icc of value within keys. A missing key forms a group; 0 if there are fewer than 2 groups or no spread."""
    label = F.concat_ws("_", *[F.coalesce(F.col(k).cast("string"), F.lit("-999")) for k in keys])
    g = df.select(label.alias("g"), value.alias("v")).filter("v is not null").groupBy("g").agg(F.count("v").cast("double").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2"))
    t = g.agg(F.sum("n").alias("n"), F.count("*").cast("double").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("s2")).alias("ssw"))
    t = t.withColumn("ssb", F.col("q") - F.col("n") * F.col("gm") * F.col("gm"))
    ok = (F.col("k") >= 2) & (F.col("n") > F.col("k"))
    msb, msw = F.col("ssb") / F.when(ok, F.col("k") - 1), F.col("ssw") / F.when(ok, F.col("n") - F.col("k"))
    size = F.col("n") / F.col("k")
    den = msb + (size - 1) * msw
    return t.select(F.when(ok & (den > 0), (msb - msw) / F.when(den > 0, den)).otherwise(0.0).alias("icc"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """col_a, col_b, correlation of null indicators (0 if undefined), distance (1 - r) / 2."""
    long = gram.pairs(df, {c: F.col(f"`{c}`").isNull().cast("int") for c in columns})
    r = F.coalesce("r", F.lit(0.0))
    return long.select("col_a", "col_b", r.alias("correlation"), ((1 - r) / 2).alias("distance"))


def variances(df: DataFrame, expressions: dict[str, Column]) -> DataFrame:
    """expr, variance: finite and positive ones."""
    long = gram.moments(df, expressions).select(F.col("name").alias("expr"), "variance")
    return long.filter("variance > 0 and variance < double('infinity')")
