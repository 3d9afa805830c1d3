"""Global order without a single task: ranges of the order, each sorted for itself, and sums over the ranges before."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

LOCAL = (1 << 33) - 1


def parts(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """df with `_part` (ascending ranges of the order) and `_row` (from 0 within its range).

    The sorted rows are kept in the shared folder, so that all later passes see the same ranges, also after an executor is lost.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return cut(line).withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit(LOCAL))}).drop("_at")


def with_before(line: DataFrame, amount: Column, name: str) -> DataFrame:
    """`name`: the sum of amount over all rows before this one, for a frame of parts()."""
    sizes = line.groupBy("_part").agg(F.sum(amount).alias("_n"))
    w = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    here = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return line.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.coalesce(F.sum(amount).over(here), F.lit(0))).drop("_start")


def ranked(df: DataFrame, order: list[Column | str], name: str = "rn") -> DataFrame:
    """df with each row's place in the order, from 1."""
    line = parts(df, order)
    sizes = line.groupBy("_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    return line.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_row") + 1).drop("_part", "_row", "_start")


def percentiles(df: DataFrame, columns: dict[str, Column], at: list[float]) -> dict[str, list[float | None]]:
    """Exact percentiles (linear between neighbours) of each column at the given shares; None without values. Missing is left out.

    Values are counted first, all columns in one exchange; no task holds the values of a column.
    """
    got = counted_percentiles(counted(df, columns, {"n": F.count("*")}), ["n"], at)
    return {n: got.get((n, "n"), [None] * len(at)) for n in columns}


def counted(df: DataFrame, columns: dict[str, Column], weights: dict[str, Column]) -> DataFrame:
    """name, v and the weights (aggregates over rows) of all different values of the columns, without missing ones. weights may read the other columns of df."""
    long = df.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in columns.items()])).alias("_x"))
    return long.filter("_x.v is not null").groupBy(F.col("_x.name").alias("name"), F.col("_x.v").alias("v")).agg(*[w.alias(k) for k, w in weights.items()])


def counted_percentiles(counts: DataFrame, weights: list[str], at: list[float]) -> dict[tuple[str, str], list[float | None]]:
    """(name, weight) -> percentiles, where each row (name, v) counts as often as the weight says. Names without weight are left out.

    The weights are summed up along the order (name, v), all in one pass, and the few values at the wanted places are looked up.
    """
    line = parts(counts, ["name", "v"])
    w = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    here = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    starts = line.groupBy("_part").agg(*[F.sum(k).alias(k) for k in weights]).select("_part", F.array(*[F.coalesce(F.sum(k).over(w), F.lit(0)) for k in weights]).alias("_starts"))
    line = line.join(F.broadcast(starts), "_part").select("name", "v", F.array(*[F.col(k) for k in weights]).alias("_n"), F.array(*[F.col("_starts")[i] + F.coalesce(F.sum(k).over(here), F.lit(0)) for i, k in enumerate(weights)]).alias("_before"))
    spans = line.groupBy("name").agg(*[a for i in range(len(weights)) for a in (F.min(F.col("_before")[i]), F.sum(F.col("_n")[i]))]).collect()  # one row for each column
    ends = {(r[0], i): (r[1 + 2 * i], r[2 + 2 * i]) for r in spans for i in range(len(weights)) if r[2 + 2 * i]}
    places = {(n, i, p): first + p * (total - 1) for (n, i), (first, total) in ends.items() for p in at}
    wanted = sorted({(n, i, int(f(x))) for (n, i, _), x in places.items() for f in (floor, ceil)})
    if not wanted:
        return {}
    asked = counts.sparkSession.createDataFrame(wanted, "name string, i int, place bigint")  # two for each column, weight and share
    before, n = F.element_at("_before", F.col("i") + 1), F.element_at("_n", F.col("i") + 1)
    found = line.join(F.broadcast(asked), "name").filter((F.col("place") >= before) & (F.col("place") < before + n))
    value = {(r["name"], r["i"], r["place"]): r["v"] for r in found.select("name", "i", "place", "v").collect()}

    def between(n: str, i: int, p: float) -> float:
        x = places[n, i, p]
        lo, hi = floor(x), ceil(x)
        a, b = value[n, i, lo], value[n, i, hi]
        return a if lo == hi or a == b else (hi - x) * a + (x - lo) * b

    return {(n, weights[i]): [between(n, i, p) for p in at] for n, i in ends}


def group_percentiles(df: DataFrame, by: list[str], value: Column, at: list[float]) -> DataFrame:
    """by, n, q (array): exact percentiles of the values of each group; missing values are left out, and groups without any.

    Different values of a group are counted; the counts are summed up along the order of group and value. A group may lie in
    several ranges: then the sums of its part of each range come first. No task holds a group.
    """
    keys = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], value.cast("double").alias("_v")).filter("_v is not null")
    line = parts(rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n")), [*keys, "_v"])
    each = line.groupBy(*keys, "_part").agg(F.sum("_n").alias("_own"))
    over = Window.partitionBy(*keys)  # a row for each range that holds some of the group
    each = each.select(*keys, "_part", F.sum("_own").over(over).alias("_total"), F.coalesce(F.sum("_own").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    here = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("_before", F.coalesce(F.sum("_n").over(here), F.lit(0)))
    on = line["_part"] == each["_part"]
    for k in keys:
        on = on & line[k].eqNullSafe(each[k])
    both = line.join(each, on).select(*[line[k] for k in keys], "_v", "_n", "_total", (F.col("_before") + F.col("_start")).alias("_before"))
    found = []
    for p in at:
        x = F.lit(float(p)) * (F.col("_total") - 1)
        for f in (F.floor(x), F.ceil(x)):
            found.append(F.max(F.when((f >= F.col("_before")) & (f < F.col("_before") + F.col("_n")), F.col("_v"))).alias(f"_q{len(found)}"))
    got = both.groupBy(*keys, F.col("_total").alias("_total")).agg(*found)

    def between(i: int, p: float) -> Column:
        x, a, b = F.lit(float(p)) * (F.col("_total") - 1), F.col(f"_q{2 * i}"), F.col(f"_q{2 * i + 1}")
        return F.when(a == b, a).otherwise((F.ceil(x) - x) * a + (x - F.floor(x)) * b)

    return got.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], F.col("_total").alias("n"), F.array(*[between(i, p) for i, p in enumerate(at)]).alias("q"))
