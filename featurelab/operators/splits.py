"""Deterministic splits: folds as a column, never as copies of the data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.order import percentiles, ranked

SEED = 42


def draw(row_id: Column, seed: int = SEED) -> Column:
    """A hash that orders rows at random but always alike."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f"|{seed}")))


def temporal_split(df: DataFrame, order: list[Column], n_folds: int = 5, test_share: float = 0.2) -> DataFrame:
    """split ("train" or "test": the last part), chunk (1 .. n_folds + 1, NULL for test and for rows that no chunk takes).

    Fold k (from 0) trains on chunks 1 .. k + 1 and validates on chunk k + 2: on the past only. The order is ascending, nulls first;
    rows that are equal in all of it lie in one chunk. Only the order's columns are sorted and kept: rows are compared with the last
    places of the chunks where they are.
    """
    n = df.count()
    pool = int(n * (1 - test_share))
    size = max(1, pool // (n_folds + 1))
    names = [f"_o{i}" for i in range(len(order))]
    line = ranked(df.select(*[o.alias(x) for o, x in zip(order, names, strict=True)]), names)
    lasts = [size * k for k in range(1, n_folds + 2)]
    ends = line.filter(F.col("rn").isin([*lasts, pool])).agg(F.collect_list(F.struct("rn", F.struct(*names).alias("o"))).alias("_ends"))
    own = F.struct(*[o.alias(x) for o, x in zip(order, names, strict=True)])
    passed = F.filter("_ends", lambda e: own > e["o"])["rn"]
    chunk = F.size(F.array_intersect(passed, F.array(*[F.lit(x).cast("bigint") for x in lasts]))).cast("bigint") + 1
    test = F.array_contains(passed, F.lit(pool).cast("bigint")) if pool else F.lit(True)
    r = df.crossJoin(F.broadcast(ends)).withColumns({"_test": test, "_chunk": chunk})  # one row of at most n_folds + 2 places
    r = r.withColumns({"split": F.when(F.col("_test"), "test").otherwise("train"), "chunk": F.when(~F.col("_test") & (F.col("_chunk") <= n_folds + 1), F.col("_chunk"))})
    return r.drop("_ends", "_test", "_chunk")


def training_rows(df: DataFrame, fold: int) -> DataFrame:
    """What a fold may learn from: with chunks (temporal_split) those before its own, else all other folds."""
    return df.filter((F.col("split") == "train") & (F.col("chunk") <= fold + 1 if "chunk" in df.columns else F.col("fold") != fold))


def validation_rows(df: DataFrame, fold: int) -> DataFrame:
    return df.filter((F.col("split") == "train") & (F.col("chunk") == fold + 2 if "chunk" in df.columns else F.col("fold") == fold))


@dataclass(frozen=True)
class Folds:
    """Which rows the folds learn from and are judged by, told by one column: folds, or chunks of time; without a column one fold does both on all rows.

    trains() and validates() take Columns and numpy arrays alike.
    """

    n: int
    column: str | None = None

    @classmethod
    def of(cls, df: DataFrame, n: int) -> Folds:
        return cls(n, "chunk" if "chunk" in df.columns else "fold")

    def trains(self, fold: int, part):
        return part == part if self.column is None else part <= fold + 1 if self.column == "chunk" else part != fold  # noqa: PLR0124

    def validates(self, fold: int, part):
        return part == part if self.column is None else part == (fold + 2 if self.column == "chunk" else fold)  # noqa: PLR0124

    def part(self) -> Column:
        return F.lit(0) if self.column is None else F.col(self.column).cast("int")

    def sums(self, what: Column, rows: Column | None = None) -> list[Column]:
        """For each fold an aggregate: the sum of what over its training rows (where `rows` holds), all in one pass."""
        return [F.sum(F.when(self.trains(k, self.part()) & (F.lit(True) if rows is None else rows), what)) for k in range(self.n)]


def fold_roles(df: DataFrame, n_folds: int = 5) -> DataFrame:
    """The rows of df once for each fold that reads them, with `fold` and `role` ("train" or "validation")."""
    out = None
    for k in range(n_folds):
        for role, rows in (("train", training_rows(df, k)), ("validation", validation_rows(df, k))):
            part = rows.withColumns({"fold": F.lit(k), "role": F.lit(role)})
            out = part if out is None else out.unionByName(part)
    return out


def strata(df: DataFrame, target: str, bins: int = 10, few: int = 20) -> DataFrame:
    """df with `stratum` (text): quantile bins, closed at the right, of a numeric target of more than `few` values; else the target."""
    kind = dict(df.dtypes)[target]
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    if not numeric or df.agg(F.count_distinct(target)).first()[0] <= few:
        return df.withColumn("stratum", F.col(target).cast("string"))
    edges = sorted(set(percentiles(df, {target: F.col(target)}, [i / bins for i in range(bins + 1)])[target]))
    inner = [F.when(F.col(target) > e, 1).otherwise(0) for e in edges[1:-1]]
    total = F.lit(0)
    for i in inner:
        total = total + i
    return df.withColumn("stratum", total.cast("string"))


def stratified_split(df: DataFrame, row_id: str, stratum: str = "stratum", n_folds: int = 5, test_share: float = 0.2, seed: int = SEED, draw_by: str | None = None) -> DataFrame:
    """split and fold (0 .. n_folds - 1; NULL for test), balanced within each stratum to one row. draw_by: a column to draw by instead of row_id.

    Places within a stratum come from the global order by (stratum, hash), so that a large stratum is no single task.
    """
    r = ranked(df.withColumn("_draw", draw(F.col(draw_by or row_id), seed)), [F.col(stratum), F.col("_draw"), F.col(row_id)], "_rn")
    per = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    w = Window.partitionBy().orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)  # one row for each stratum
    per = per.withColumn("_before", F.coalesce(F.sum("_size").over(w), F.lit(0))).withColumnRenamed(stratum, "_s")
    out = r.join(per, r[stratum].eqNullSafe(per["_s"]))
    place, test = F.col("_rn") - F.col("_before"), F.round(F.col("_size") * F.lit(test_share)).cast("bigint")
    out = out.withColumns({"split": F.when(place <= test, "test").otherwise("train"), "fold": F.when(place > test, (place - test - 1) % n_folds)})
    return out.drop("_draw", "_rn", "_s", "_size", "_before")


def hash_sample(df: DataFrame, row_id: str, above: int = 100_000, one_in: int = 10, seed: int = SEED) -> DataFrame:
    """A tenth of a frame of more than `above` rows, chosen by a hash of row_id (the same rows under any partitioning)."""
    if df.count() <= above:
        return df
    return df.filter(F.pmod(F.conv(F.substring(draw(F.col(row_id), seed), 1, 8), 16, 10).cast("bigint"), F.lit(one_in)) == 0)
