"""Reading data sets: CSV text with the usual tokens for missing values, Parquet, and what identifies a data set."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts that mean a missing value in CSV files.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
PEEK = 200


def _missing(c: Column) -> Column:
    return F.when(c.isin(NA_TOKENS), None).otherwise(c)


def read_csv(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """All columns as text, missing tokens as NULL, then typed by what all values of a column can be: bigint, double, boolean
    (True / False) or text. One pass tells the types. Files are split among tasks unless a quoted value holds a line break."""
    broken = spark.read.text(path).filter((F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1)
    raw = spark.read.option("header", True).option("multiLine", bool(broken.head(1))).option("escape", '"').csv(path)
    raw = raw.drop(*(exclude or [])).select(*[_missing(F.col(f"`{c}`")).alias(c) for c in raw.columns if c not in (exclude or [])])
    checks = []
    for i, c in enumerate(raw.columns):
        v = F.col(f"`{c}`")
        whole = v.rlike(r"^\s*[+-]?\d{1,18}\s*$")
        number = v.rlike(r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?inf(inity)?)\s*$")
        checks += [F.count(v).alias(f"n{i}"), F.count_if(whole).alias(f"w{i}"), F.count_if(number).alias(f"f{i}"), F.count_if(v.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}")]
    row = raw.agg(*checks).first()
    out = []
    for i, c in enumerate(raw.columns):
        v, n = F.col(f"`{c}`"), row[f"n{i}"]
        if not n:
            out.append(v.cast("double").alias(c))
        elif row[f"w{i}"] == n:
            out.append(F.trim(v).cast("bigint").alias(c))
        elif row[f"f{i}"] == n:
            x = F.trim(v)
            out.append(F.when(F.lower(x).contains("inf"), None).otherwise(x).cast("double").alias(c))
        elif row[f"b{i}"] == n:
            out.append((F.lower(v) == "true").alias(c))
        else:
            out.append(v.alias(c))
    return raw.select(*out)


def read(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    if path.rstrip("/").endswith((".csv", ".csv.gz", ".tsv")):
        return read_csv(spark, path, exclude)
    return spark.read.parquet(path).drop(*(exclude or []))


def validate(df: DataFrame, target: str, date_col: str | None = None, categorical: list[str] | None = None) -> list[str]:
    """An error if target or date column is not there; warnings for categorical columns that are not."""
    for c in (target, date_col):
        if c and c not in df.columns:
            raise ValueError(f"column {c!r} is not in the data: {', '.join(df.columns)}")
    return [f"categorical column {c!r} is not in the data" for c in categorical or [] if c not in df.columns]


def peek(df: DataFrame) -> list[tuple[str, str]]:
    """Columns and types as the first rows tell them."""
    return df.limit(PEEK).dtypes


def suggested_metric(df: DataFrame, target: str) -> str:
    """By the distinct targets among the first rows: 2 auc, up to 20 f1, else rmse."""
    n = df.limit(PEEK).agg(F.count_distinct(target)).first()[0]
    return "auc" if n == 2 else "f1" if n <= 20 else "rmse"


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and modification time (microseconds) of each file of a data set, sorted; as Spark's scan sees them."""
    rows = read_plain(spark, path).select("_metadata.file_path", "_metadata.file_size", F.unix_micros("_metadata.file_modification_time").alias("t")).distinct()
    return sorted((r[0], r[1], r[2]) for r in rows.collect())  # one for each file


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """The files of a data set without types: lines of a text file."""
    return spark.read.text(path) if path.rstrip("/").endswith((".csv", ".csv.gz", ".tsv")) else spark.read.parquet(path)


def signature(df: DataFrame, config: dict, files: list[tuple[str, int, int]] | None = None) -> str:
    """SHA-256 of the sorted compact JSON of configuration, shape, columns, types and (name, size, time) of files."""
    what = {"config": config, "rows": df.count(), "columns": df.columns, "types": [t for _, t in df.dtypes], "files": files or []}
    return hashlib.sha256(json.dumps(what, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a node-link JSON file."""
    doc = spark.read.option("multiLine", True).json(path)
    edges = "links" if "links" in doc.columns else "edges"
    return doc.select(F.explode("nodes").alias("x")).select("x.*"), doc.select(F.explode(edges).alias("x")).select("x.*")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A node-link JSON file; a ledger's graph fits one file."""
    n = nodes.agg(F.collect_list(F.struct("*")).alias("nodes"))
    e = edges.agg(F.collect_list(F.struct("*")).alias("links"))
    n.crossJoin(e).coalesce(1).write.mode("overwrite").json(path)


# The columns of the results log.
RESULT_COLUMNS = ["commit", "timestamp", "experiment_id", "status", "metric", "cv_score", "cv_std", "delta", "n_features", "composite_score", "run_time", "description"]


def append_results(rows: DataFrame, path: str) -> None:
    """Tab-separated results; scores with four places."""
    four = {"cv_score", "cv_std", "delta", "composite_score"}
    rows.select(*[F.format_string("%.4f", F.col(c).cast("double")).alias(c) if c in four else F.col(c).cast("string").alias(c) for c in RESULT_COLUMNS]).coalesce(1).write.mode("append").option("sep", "\t").option("header", True).csv(path)
