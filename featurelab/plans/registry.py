"""All queries of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this package that hold QUERIES (name -> query) and SQL (name -> DuckDB SQL).
MODULES = ["statistics", "preparation", "discovery", "ledger", "models"]


def queries() -> dict[str, Query]:
    return {k: q for m in MODULES for k, q in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"{__package__}.{m}").SQL.items()}
