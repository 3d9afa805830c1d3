"""Small helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, places: int) -> DataFrame:
    """df with its doubles rounded."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
