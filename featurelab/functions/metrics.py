"""Metrics of predictions as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import average_ranks

HIGHER_IS_BETTER = {"auc": True, "f1": True, "accuracy": True, "rmse": False, "mae": False, "logloss": False}
EPS, PENALTY = 1e-15, 0.001


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def accuracy(y: Column, p: Column) -> Column:
    return F.avg((y == p).cast("double"))


def logloss(p_true: Column) -> Column:
    """From the probability given to the true class."""
    return -F.avg(F.ln(F.least(F.greatest(p_true, F.lit(EPS)), F.lit(1 - EPS))))


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: auc of a binary label, exact, ties at half. NULL with one class only."""
    r = average_ranks(df.select(F.col(y).alias("_y"), F.col(score).alias("_s")).filter("_y is not null and _s is not null"), "_s", "_r")
    pos = F.count_if(F.col("_y") == 1).cast("double")
    neg = F.count_if(F.col("_y") == 0).cast("double")
    total = F.sum(F.when(F.col("_y") == 1, F.col("_r")))
    return r.agg(F.when((pos > 0) & (neg > 0), (total - pos * (pos + 1) / 2) / F.when(pos * neg > 0, pos * neg)).alias("auc"))


def macro_auc(df: DataFrame, y: str, scores: dict[str, str]) -> DataFrame:
    """One row: mean of the one-against-rest AUCs. scores: class -> column."""
    out = None
    for k, c in scores.items():
        part = auc(df.select((F.col(y) == k).cast("int").alias("y"), F.col(c).alias("s")), "y", "s")
        out = part if out is None else out.unionByName(part)
    return out.agg(F.avg("auc").alias("auc"))


def f1(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: f1 of class 1 if the labels are 0 and 1, else the mean over classes weighted by their rows."""
    long = df.select(F.explode(F.array(F.struct(F.col(y).alias("k"), F.lit(1).alias("t"), F.lit(0).alias("g"), (F.col(y) == F.col(p)).cast("int").alias("hit")), F.struct(F.col(p).alias("k"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    per = long.groupBy("k").agg(F.sum("t").alias("support"), F.sum("g").alias("given"), F.sum("hit").alias("hit"))
    per = per.withColumn("f1", F.col("hit") * 2.0 / F.greatest(F.col("support") + F.col("given"), F.lit(1)))
    binary = F.max(F.col("k").cast("string").isin("0", "1").cast("int")) + F.min(F.col("k").cast("string").isin("0", "1").cast("int")) == 2
    return per.agg(F.when(binary, F.max(F.when(F.col("k").cast("string") == "1", F.col("f1")))).otherwise(F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"))


def composite(cv: Column, n_features: Column, higher: bool) -> Column:
    """The score with a penalty for each feature."""
    return cv - PENALTY * n_features if higher else cv + PENALTY * n_features
