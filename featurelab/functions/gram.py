"""Moments of many columns or pairs of columns in one scan: summed where the rows are, merged in one exchange.

A task keeps counts, means and (co-)moments about the mean as arrays and merges each batch of rows into them (pairwise formulas, so
that nothing cancels); it gives one row for each column or pair. Rows of all tasks are merged in the order of the tasks, so
results don't depend on how they arrive. Null, NaN and infinite values are missing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative deviations below this are rounding: such a column is constant.
ROUNDING = 1e-13

_MOMENTS = "task int, i int, n bigint, mean double, square double"
_PAIRS = "task int, i int, j int, n bigint, mx double, my double, xx double, yy double, xy double"


def merge_pairs(a: tuple, b: tuple) -> tuple:
    """(n, mean x, mean y, xx, yy, xy) of the rows of two frames together; arrays [i, j] where x is column i and y column j, over rows that have both."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * share
    return n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w


def pair_moments(x: np.ndarray) -> tuple:
    """(n, mean x, mean y, xx, yy, xy) of rows x [row, column], by products of the masked matrix with itself."""
    there = np.isfinite(x)
    m = there.astype(float)
    centre = np.where(there, x, 0).sum(axis=0) / np.maximum(m.sum(axis=0), 1)
    x = np.where(there, x - centre, 0)
    n, s, q, p = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x  # s[i, j]: sum of column i where column j is there
    one = np.maximum(n, 1)
    return n, centre[:, None] + s / one, centre[None, :] + s.T / one, q - s * s / one, q.T - s.T * s.T / one, p - s * s.T / one


def _rows(df: DataFrame, columns: list[Column], run, schema: str) -> DataFrame:
    return df.select(F.array(*[c.cast("double") for c in columns]).alias("x")).mapInArrow(run, schema)


def _matrix(batch, width: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, width)


def pairs(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """col_a, col_b, n (rows that have both), r (Pearson; null if either is constant there) of all pairs of columns."""
    names, width = list(columns), len(columns)
    if width < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, n bigint, r double")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = None
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                new = pair_moments(_matrix(b.slice(at, 4096), width))
                total = new if total is None else merge_pairs(total, new)
        if total is not None:
            i, j = np.triu_indices(width, 1)
            task = np.full(len(i), TaskContext.get().partitionId(), np.int32)
            values = [task, i.astype(np.int32), j.astype(np.int32), total[0][i, j].astype(np.int64), *[a[i, j] for a in total[1:]]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=[f.split(" ")[0] for f in _PAIRS.split(", ")])

    start = F.struct(F.lit(0).cast("bigint").alias("n"), *[F.lit(0.0).alias(k) for k in ("mx", "my", "xx", "yy", "xy")])

    def step(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        share = F.when(n > 0, b["n"] / F.when(n > 0, n)).otherwise(0.0)
        dx, dy, w = b["mx"] - a["mx"], b["my"] - a["my"], a["n"] * share
        return F.struct(
            n.alias("n"), (a["mx"] + dx * share).alias("mx"), (a["my"] + dy * share).alias("my"), (a["xx"] + b["xx"] + dx * dx * w).alias("xx"),
            (a["yy"] + b["yy"] + dy * dy * w).alias("yy"), (a["xy"] + b["xy"] + dx * dy * w).alias("xy"),
        )

    each = _rows(df, list(columns.values()), run, _PAIRS).groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("task", "n", "mx", "my", "xx", "yy", "xy"))).alias("t"))
    got = each.select("i", "j", F.aggregate("t", start, step).alias("s")).select("i", "j", "s.*")
    varies = lambda s, m: (F.col(s) > 0) & (F.col(s) > F.col("n") * F.pow(F.col(m) * ROUNDING, 2))
    spread = F.when(varies("xx", "mx") & varies("yy", "my"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy")))
    named = F.array(*map(F.lit, names))
    return got.select(named[F.col("i")].alias("col_a"), named[F.col("j")].alias("col_b"), "n", (F.col("xy") / spread).alias("r"))


def moments(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """name, n, mean, variance (of the sample; null below 2 values, 0 for a constant) of all columns."""
    names, width = list(columns), len(columns)
    if not width:
        return df.sparkSession.createDataFrame([], "name string, n bigint, mean double, variance double")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        n, mean, square = np.zeros(width), np.zeros(width), np.zeros(width)
        for b in batches:
            x = _matrix(b, width)
            there = np.isfinite(x)
            m = there.sum(axis=0).astype(float)
            own = np.where(there, x, 0).sum(axis=0) / np.maximum(m, 1)
            dev = ((np.where(there, x - own, 0)) ** 2).sum(axis=0)
            both = n + m
            share = np.divide(m, both, out=np.zeros(width), where=both > 0)
            d = own - mean
            square, mean, n = square + dev + d * d * n * share, mean + d * share, both
        task = np.full(width, TaskContext.get().partitionId(), np.int32)
        values = [task, np.arange(width, dtype=np.int32), n.astype(np.int64), mean, square]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=[f.split(" ")[0] for f in _MOMENTS.split(", ")])

    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("square"))

    def step(a: Column, b: Column) -> Column:
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        share = F.when(n > 0, b["n"] / F.when(n > 0, n)).otherwise(0.0)
        return F.struct(n.alias("n"), (a["mean"] + d * share).alias("mean"), (a["square"] + b["square"] + d * d * a["n"] * share).alias("square"))

    each = _rows(df, list(columns.values()), run, _MOMENTS).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("task", "n", "mean", "square"))).alias("t"))
    got = each.select("i", F.aggregate("t", start, step).alias("s")).select("i", "s.*")
    varies = F.col("square") > F.col("n") * F.pow(F.col("mean") * ROUNDING, 2)
    variance = F.when(F.col("n") > 1, F.when(varies, F.col("square") / F.nullif(F.col("n") - 1, F.lit(0))).otherwise(0.0))
    return got.select(F.array(*map(F.lit, names))[F.col("i")].alias("name"), "n", F.when(F.col("n") > 0, F.col("mean")).alias("mean"), variance.alias("variance"))
