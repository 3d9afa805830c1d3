"""The four statistical queries on training rows: leakage-checked, limited in number, logged."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr, stats
from .ledger import Ledger
from .splits import training_rows

LIMIT = 20


class QueryLimit(RuntimeError):
    pass


def scope(df: DataFrame) -> DataFrame:
    """Training rows of the first fold."""
    return training_rows(df, 0)


def run_query(df: DataFrame, kind: str, target: str, ledger: Ledger | None = None, **kw) -> DataFrame:
    """A DataFrame with the result. Unknown kinds and missing columns give one row with `error`, which counts like a result."""
    names = [*kw.get("cols", []), *([kw["groupby"]] if isinstance(kw.get("groupby"), str) else kw.get("groupby", [])), *[kw[k] for k in ("col", "col_a", "col_b") if k in kw]]
    expr.check_leakage(target, names)
    compiled = expr.compile_expression(kw["expr"], df) if "expr" in kw else None
    expr.check_leakage(target, [], compiled)
    if ledger is not None and ledger.queries_asked() >= LIMIT:
        raise QueryLimit(f"{LIMIT} queries were asked already")
    rows = scope(df)
    missing = [c for c in names if c not in df.columns]
    if missing:
        out = rows.sparkSession.createDataFrame([(f"unknown columns: {', '.join(missing)}",)], "error string")
    elif kind == "within_group_variance":
        out = stats.variation(rows, compiled.column, list(kw["groupby"]) if not isinstance(kw["groupby"], str) else [kw["groupby"]])
    elif kind == "cardinality":
        out = stats.cardinality(rows, kw["cols"])
        if len(kw["cols"]) > 1:
            both = stats.combined_cardinality(rows, kw["cols"]).select(F.lit("+".join(kw["cols"])).alias("column"), F.col("n_groups").alias("n_distinct"), F.lit(None).cast("bigint").alias("n_missing"))
            out = out.unionByName(both)
    elif kind == "correlation":
        out = stats.correlation(rows, kw["col_a"], kw["col_b"])
    elif kind == "conditional_distribution":
        text = dict(df.dtypes)[kw["col"]] in ("string", "boolean")
        f = stats.conditional_top_values if text else stats.conditional_distribution
        out = f(rows, kw["col"], kw["groupby"], kw.get("n_groups", 5))
    else:
        out = rows.sparkSession.createDataFrame([(f"unknown query: {kind}",)], "error string")
    if ledger is not None:
        ledger.append("query_log", [(datetime.datetime.now(), kind)])
    return out
