"""Discovery: derived expressions, entity keys, expressions that stay near-constant within an entity, residual ICC."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr
from ..functions import grouped
from ..functions.order import group_percentiles
from ..functions.shared import stored
from ..functions.stats import INVARIANT_CV, MIN_GROUP, cardinality, icc, pair_cardinality, variances
from .profile import numeric_columns

MAX_DERIVED, MAX_KEYS, MAX_RAW, MAX_BASE = 50, 20, 50, 30
#: Distinct counts of one plan at most: each is a branch with an exchange of its own.
PER_JOB = 30


def expression_id(text: str) -> str:
    return "derived_" + hashlib.sha256(text.encode()).hexdigest()[:8]


def entity_id(columns: list[str]) -> str:
    return "entity_" + hashlib.sha256(repr(sorted(columns)).encode()).hexdigest()[:8]


def derived(df: DataFrame, tags: dict[str, list[str]] | None = None, most: int = MAX_DERIVED) -> DataFrame:
    """expr, variance of the derived expressions, largest variance first.

    Within each semantic tag (in the order of the schema) all numeric pairs give both differences and a ratio, temporal ones
    also differences of scaled columns. Without tags the MAX_BASE columns of largest variance are paired.
    """
    number = numeric_columns(df)
    made: dict[str, Column] = {}
    for tag, columns in (tags or {}).items():
        for a, b in combinations([c for c in number if c in columns], 2):
            made.setdefault(f"{a} - {b}", expr.difference(a, b))
            made.setdefault(f"{b} - {a}", expr.difference(b, a))
            made.setdefault(f"{a} / {b}", expr.quotient(a, b))
            if tag == "temporal":
                for x, y in ((a, b), (b, a)):
                    made.setdefault(f"{x}/86400 - {y}", expr.scaled_difference(x, y))
                    made.setdefault(f"floor({x}/86400) - {y}", expr.floored_difference(x, y))
    if sum(len(c) for c in (tags or {}).values()) < 3 or not made:
        base = [r["expr"] for r in variances(df, {c: F.col(c).cast("double") for c in number}).orderBy(F.desc("variance"), "expr").limit(MAX_BASE).collect()]
        for a, b in combinations([c for c in number if c in base], 2):
            made.setdefault(f"{a} - {b}", expr.difference(a, b))
            made.setdefault(f"{a} / {b}", expr.quotient(a, b))
    return variances(df, made).orderBy(F.desc("variance"), "expr").limit(most)


def raw(df: DataFrame, most: int = MAX_RAW) -> list[str]:
    """The numeric columns of largest variance."""
    number = {c: F.col(c).cast("double") for c in numeric_columns(df)}
    return [r["expr"] for r in variances(df, number).orderBy(F.desc("variance"), "expr").limit(most).collect()] if number else []


def entity_keys(df: DataFrame, categorical: list[str] | None = None, low: int = 50, high: int = 100_000) -> DataFrame:
    """columns (array), cardinality of single and paired keys, largest first."""
    spark = df.sparkSession
    names, floats = [], set()
    for f in df.schema.fields:
        if isinstance(f.dataType, T.FractionalType):
            floats.add(f.name)
        if f.name in (categorical or []) or isinstance(f.dataType, T.StringType | T.NumericType):
            names.append(f.name)
    rows = [r for s in range(0, len(names), PER_JOB) for r in cardinality(df, names[s : s + PER_JOB]).collect()]  # one for each column
    count, missing = {r["column"]: r["n_distinct"] for r in rows}, {r["column"]: r["n_missing"] for r in rows}
    for c in names:  # whole numbers with gaps are floats to the reference
        if isinstance(df.schema[c].dataType, T.IntegralType) and missing[c]:
            floats.add(c)
    single = [c for c in names if low <= count[c] <= high and (c in (categorical or []) or isinstance(df.schema[c].dataType, T.StringType) or count[c] < (1_000 if c in floats else 100_000))]
    # no pair has more values than the product of its columns'
    pairs = [p for p in combinations(single, 2) if all(count[c] <= 50_000 for c in p) and count[p[0]] * count[p[1]] >= 500]
    found = [([c], count[c]) for c in single]
    for s in range(0, len(pairs), PER_JOB):
        part = pair_cardinality(df, pairs[s : s + PER_JOB]).collect()  # one row for each pair
        found += [([r["col_a"], r["col_b"]], r["n_groups"]) for r in part if 500 <= r["n_groups"] <= 500_000]
    found.sort(key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame(found[:MAX_KEYS], "columns array<string>, cardinality bigint")


def invariants(df: DataFrame, keys: list[list[str]], expressions: dict[str, Column], references: dict[str, set[str]] | None = None, include_own: bool = False) -> DataFrame:
    """key, expr, median_cv, n_groups of expressions whose median cv within the key is below the limit.

    One scan for all keys and expressions (grouped.py). An expression of the key's columns alone is left out, as it is constant
    there by construction. A median below the limit needs half of the cvs below it, so only such pairs are put into order.
    """
    names = list(expressions)
    skip = {(i, j) for i, key in enumerate(keys) for j, t in enumerate(names) if not include_own and (references or {}).get(t, {t}) <= set(key)}
    if len(skip) == len(keys) * len(names):
        return df.sparkSession.createDataFrame([], "key string, expr string, median_cv double, n_groups bigint")
    long = stored(grouped.deviations(df, keys, list(expressions.values()), skip, MIN_GROUP), "invariant-cv")
    counts = long.groupBy("key", "expr").agg(F.count("*").alias("n_groups"), F.count("cv").alias("_n"), F.count_if(F.col("cv") < INVARIANT_CV).alias("_low"))
    counts = stored(counts.filter((F.col("_low") > 0) & (2 * F.col("_low") >= F.col("_n"))).select("key", "expr", "n_groups"), "invariant-pairs")
    some = F.broadcast(counts.select("key", "expr"))  # one row for each pair at most
    middle = group_percentiles(long.join(some, ["key", "expr"]), ["key", "expr"], F.col("cv"), [0.5]).select("key", "expr", F.col("q")[0].alias("median_cv"))
    got = middle.join(F.broadcast(counts), ["key", "expr"]).filter(F.col("median_cv") < INVARIANT_CV)
    said, shown = F.array(*[F.lit("_".join(k)) for k in keys]), F.array(*map(F.lit, names))
    return got.select(said[F.col("key")].alias("key"), shown[F.col("expr")].alias("expr"), "median_cv", "n_groups")


@dataclass
class Scan:
    """What a discovery finds: derived expressions and raw columns (expr, variance), entity keys, near-constant pairs; references by expression."""

    derived: DataFrame
    raw: list[str]
    keys: DataFrame
    references: dict[str, list[str]]
    steady: DataFrame


def scan(df: DataFrame, categorical: list[str] | None = None, tags: dict[str, list[str]] | None = None) -> Scan:
    """The whole discovery over df, which is written once: entity keys that are found, against expressions that are found and the raw columns of largest variance."""
    rows = stored(df, "discover-rows")
    found = derived(rows, tags).persist()
    keys, alone = entity_keys(rows, categorical), raw(rows)
    compiled = {r["expr"]: expr.compile_expression(r["expr"], rows) for r in found.select("expr").collect()}  # at most MAX_DERIVED
    made = {x: m.column for x, m in compiled.items()} | {x: F.col(f"`{x}`").cast("double") for x in alone}
    references = {x: sorted(m.references) for x, m in compiled.items()} | {x: [x] for x in alone}
    steady = invariants(rows, [list(r["columns"]) for r in keys.collect()], made, {x: set(r) for x, r in references.items()})  # at most MAX_KEYS
    return Scan(found, alone, keys, references, steady)


def residual_icc(df: DataFrame, residual: Column, keys: list[list[str]]) -> DataFrame:
    """key, residual_icc, for each key."""
    out = None
    for key in keys:
        part = icc(df, residual, key).select(F.lit("_".join(key)).alias("key"), F.col("icc").alias("residual_icc"))
        out = part if out is None else out.unionByName(part)
    return out


def clusters(columns: list[str], distance: dict[tuple[str, str], float], n_clusters: int) -> dict[str, int]:
    """Complete-linkage clusters of columns by pairwise distance, numbered by first member. There are as many items as columns."""
    groups = [[c] for c in columns]
    far = lambda x, y: max(distance[min(a, b, key=columns.index), max(a, b, key=columns.index)] for a in x for b in y)
    while len(groups) > max(1, n_clusters):
        i, j = min(combinations(range(len(groups)), 2), key=lambda p: (far(groups[p[0]], groups[p[1]]), p))
        groups[i] += groups.pop(j)
    return {c: k for k, g in enumerate(groups) for c in g}


def missingness_groups(df: DataFrame, columns: list[str], n_clusters: int = 10) -> DataFrame:
    """column, missingness_group of the columns with missing values."""
    from ..functions.stats import missingness

    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    some = [c for i, c in enumerate(columns) if row[f"m{i}"]]
    if len(some) < 2:
        return df.sparkSession.createDataFrame([], "column string, missingness_group int")
    distance = {(r["col_a"], r["col_b"]): r["distance"] for r in missingness(df, some).collect()}
    return df.sparkSession.createDataFrame(list(clusters(some, distance, min(n_clusters, len(some))).items()), "column string, missingness_group int")
