"""The guard that makes a feature frame numeric: infinities, ordinal codes, medians. Fitted on training rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import finite
from ..functions.order import counted, counted_percentiles, percentiles, ranked
from ..functions.shared import stored
from .splits import Folds


def infinite_to_missing(df: DataFrame) -> DataFrame:
    return df.select(*[finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.FloatType | T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def ordinal_codes(train: DataFrame, column: str, row_id: str) -> DataFrame:
    """value, code: distinct values by first appearance (least row_id), from 0."""
    firsts = train.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(row_id).alias("_first"))
    return ranked(firsts, ["_first", "value"]).select("value", (F.col("rn") - 1).alias("code"))


def encode(df: DataFrame, column: str, codes: DataFrame, unseen: float = -1.0) -> DataFrame:
    """column replaced by its code as float; values without a code get `unseen`, missing stays missing."""
    c = codes.select(F.col("value").alias("_v"), F.col("code").alias("_c"))
    out = df.join(c, df[column] == c["_v"], "left")
    return out.withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce("_c", F.lit(unseen))).cast("float")).drop("_v", "_c")


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in percentiles(df, {c: F.col(c) for c in columns}, [0.5]).items()} if columns else {}


def impute(df: DataFrame, values: dict[str, float | None], empty: float | None = None) -> DataFrame:
    """Missing numbers replaced by the given values; columns without a value get `empty` (NULL: they stay missing)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v if v is not None else empty).cast("double")) for c, v in values.items()})


@dataclass
class Guard:
    """impute: "train" (medians of training rows) or "self" (each frame's own medians)."""

    features: list[str]
    row_id: str
    impute: str = "train"
    codes: dict[str, DataFrame] = field(default_factory=dict)
    values: dict[str, float | None] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> Guard:
        text = [f.name for f in train.schema.fields if f.name in self.features and not isinstance(f.dataType, T.NumericType)]
        self.codes = {c: ordinal_codes(train, c, self.row_id) for c in text}
        self.values = medians(self._numbers(train), self.features)
        return self

    def _numbers(self, df: DataFrame) -> DataFrame:
        out = infinite_to_missing(df)
        for c, codes in self.codes.items():
            out = encode(out, c, codes)
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._numbers(df)
        out = impute(out, medians(out, self.features) if self.impute == "self" else self.values, 0.0)
        rest = [f.name for f in out.schema.fields if f.name in self.features and not isinstance(f.dataType, T.NumericType)]
        if rest:
            raise AssertionError(f"columns that are not numeric: {rest}")
        return out


def fold_codes(df: DataFrame, columns: list[str], row_id: str | None, folds: Folds) -> DataFrame:
    """name, value, codes, counts (arrays with an item for each fold): ordinal codes of all columns' values in every fold, from one pass.

    A value's code is its place by first appearance among the training rows of the fold, or in sorted order without row_id; null
    if it has none there.
    """
    place = F.col(row_id) if row_id else F.lit(0)
    long = df.select(place.alias("_id"), folds.part().alias("_part"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_x"))
    trains = [folds.trains(k, F.col("_part")) for k in range(folds.n)]
    each = long.filter("_x.value is not null").groupBy("_x.name", "_x.value").agg(F.array(*[F.struct(F.min(F.when(t, F.col("_id"))).alias("first"), F.count_if(t).alias("n")) for t in trains]).alias("folds"))
    each = stored(each, "fold-values")
    line = ranked(each.select("name", "value", F.posexplode("folds").alias("fold", "x")).filter("x.n > 0").select("name", "fold", "x.first", "value"), ["name", "fold", "first", "value"])
    starts = line.groupBy("name", "fold").agg(F.min("rn").alias("start"))  # one row for each column and fold
    codes = line.join(F.broadcast(starts), ["name", "fold"]).groupBy("name", "value").agg(F.map_from_entries(F.collect_list(F.struct("fold", (F.col("rn") - F.col("start")).cast("double")))).alias("code"))
    at = F.sequence(F.lit(0), F.lit(folds.n - 1))
    return each.join(codes, ["name", "value"]).select("name", "value", F.transform(at, lambda k: F.try_element_at("code", k)).alias("codes"), F.col("folds.n").alias("counts"))


def guard_folds(df: DataFrame, use: dict[str, list[str]], row_id: str, folds: Folds) -> tuple[DataFrame, dict[str, list[str]]]:
    """What Guard does for each fold, for all of them in one frame.

    use: for each feature its column, or a column for each fold. Returns df with the numeric columns and where each feature now is;
    columns that are the same for all folds stay single. Codes and medians of all folds come from one aggregation each. Codes are
    joined as a table: Spark sends it to all tasks if it is small, else splits the partitions of frequent values.
    """
    out, kinds = infinite_to_missing(df), {f.name: f.dataType for f in df.schema.fields}
    names = list(dict.fromkeys(c for cs in use.values() for c in cs))
    text = [c for c in names if not isinstance(kinds[c], T.NumericType)]
    numbers = [c for c in names if c not in text]
    row = out.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(names)]).first()
    gaps = {c for i, c in enumerate(names) if row[f"m{i}"]}
    places: dict[tuple[str, int], str] = {}
    median: dict[tuple[str, int], float] = {}
    weights = [f"w{k}" for k in range(folds.n)]
    some = [c for c in numbers if c in gaps]
    if some:
        counts = counted(out, {c: F.col(f"`{c}`") for c in some}, {w: F.count_if(folds.trains(k, folds.part())) for k, w in enumerate(weights)})
        median |= {(c, weights.index(w)): v[0] for (c, w), v in counted_percentiles(counts, weights, [0.5]).items()}
    if text:
        codes = stored(fold_codes(out, text, row_id, folds), "fold-codes")
        each = codes.select("name", F.posexplode("codes").alias("k", "v"), "counts").filter("v is not null").select(F.concat_ws("|", "k", "name").alias("name"), "v", F.element_at("counts", F.col("k") + 1).alias("n"))
        for (c, _), v in (counted_percentiles(each, ["n"], [0.5]) if gaps & set(text) else {}).items():
            k, _, c = c.partition("|")
            median[c, int(k)] = v[0]
    for j, c in enumerate(text):
        t = codes.filter(F.col("name") == c).select(F.col("value").alias("_v"), F.col("codes").alias("_c"))
        out = out.join(t, out[c].cast("string") == t["_v"], "left")
        out = out.withColumns({f"_t{j}_{k}": F.when(F.col(f"`{c}`").isNotNull(), F.coalesce(F.col("_c")[k], F.lit(-1.0))) for k in range(folds.n)}).drop("_v", "_c")
        places |= {(c, k): f"_t{j}_{k}" for k in range(folds.n)}
    filled = {}
    for j, c in enumerate(names):
        for k in range(folds.n) if c in gaps else ():
            filled[f"_f{j}_{k}"] = F.coalesce(F.col(f"`{places.get((c, k), c)}`").cast("double"), F.lit(float(median.get((c, k), 0.0))))
            places[c, k] = f"_f{j}_{k}"
    out = out.withColumns(filled) if filled else out
    where = {f: [places.get((cs[k] if len(cs) > 1 else cs[0], k), cs[k] if len(cs) > 1 else cs[0]) for k in range(folds.n)] for f, cs in use.items()}
    return out, {f: cs if len(set(cs)) > 1 else cs[:1] for f, cs in where.items()}


def label_index(train: DataFrame, target: str) -> DataFrame:
    """value, code: sorted distinct values as text, from 0. Codes come from ranges of the order, so there may be any number of values."""
    values = train.select(F.col(target).cast("string").alias("value")).filter("value is not null").distinct()
    return ranked(values, ["value"]).select("value", (F.col("rn") - 1).cast("int").alias("code"))
