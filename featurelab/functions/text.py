"""Reading experiment descriptions and column briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keyword of a description -> transform family, in the order in which they are tried.
FAMILY_KEYWORDS = [
    ("target_enc", "target_encoding"),
    ("onehot", "onehot"),
    ("frequency", "frequency_encoding"),
    ("ordinal", "ordinal"),
    ("kmeans", "clustering"),
    ("cluster", "clustering"),
    ("quantile", "binning"),
    ("bin", "binning"),
    ("log", "log"),
    ("sqrt", "sqrt"),
    ("clip", "clip"),
    ("power", "power"),
    ("aggregate", "geo_aggregate"),
    ("_mean", "geo_aggregate"),
    ("_std", "geo_aggregate"),
    ("ratio", "ratio"),
    ("product", "product"),
    ("interaction", "interaction"),
    ("difference", "difference"),
    ("drop", "feature_drop"),
    ("add", "feature_add"),
]

# Keywords that tag the columns of a line of the brief.
SEMANTIC_KEYWORDS = {
    "temporal": ["seconds", "timestamp", "timedelta", "days", "datetime", "time", "date", "elapsed"],
    "monetary": ["usd", "amount", "price", "cost", "dollar", "value", "fee", "payment"],
    "count": ["count", "frequency", "number of", "how many"],
    "distance": ["distance", "dist", "miles", "km", "meters"],
}


def part(description: Column, key: str) -> Column:
    """The text of the last "key=..." part, NULL if there is none."""
    pattern = rf"(?s)^(?:.*;)?\s*{key}\s*=([^;]*)"
    return F.when(F.regexp_like(description, F.lit(pattern)), F.trim(F.regexp_extract(description, pattern, 1)))


def readable(description: Column) -> Column:
    """"col -> op" if both are given, else the reason, else the text; cut at 80, underscores in values as blanks."""
    clean = lambda k: F.replace(part(description, k), F.lit("_"), F.lit(" "))
    both = F.when(clean("col").isNotNull() & clean("op").isNotNull(), F.concat(clean("col"), F.lit(" \u2192 "), clean("op")))
    return F.coalesce(both, F.substring(clean("reason"), 1, 80), F.substring(description, 1, 80))


def family(description: Column) -> Column:
    """The family of the first keyword contained in the first "op=" part, or in the whole text if there is none."""
    text, pattern = F.lower(description), r"(?:^|;)\s*op=([^;]*)"
    text = F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1)).otherwise(text)
    out = None
    for word, name in FAMILY_KEYWORDS:
        hit = F.contains(text, F.lit(word))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def named_columns(description: Column) -> Column:
    """The columns in the "col=" part, as an array."""
    return F.filter(F.transform(F.split(F.coalesce(part(description, "col"), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def tagged(spark: SparkSession, brief: str, columns: list[str]) -> dict[str, list[str]]:
    """Tag -> columns (in the order of the data set) by the lines of a brief; tags without columns too."""
    lines = spark.createDataFrame([(x,) for x in brief.splitlines()], "line string")
    got = {tuple(r) for r in semantic_tags(lines, spark.createDataFrame([(c,) for c in columns], "column string")).collect()}  # both are small
    return {tag: [c for c in columns if (tag, c) in got] for tag in SEMANTIC_KEYWORDS}


def semantic_tags(brief: DataFrame, columns: DataFrame) -> DataFrame:
    """tag, column: columns mentioned on a line (column `line`) of the brief that holds a keyword of the tag.

    ``columns`` has one row for each column of the data set (column `column`), ``brief`` one for each line: both are small.
    """
    line = F.lower("line")
    tags = F.array(*[F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(line, w)), F.lit(tag)) for tag, words in SEMANTIC_KEYWORDS.items()])
    tagged = brief.select("line", F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("tag"))
    c = F.col("column")
    mentioned = F.contains("line", F.concat(F.lit("`"), c, F.lit("`"))) | F.contains("line", F.concat(F.lit("| "), c, F.lit(" "))) | F.contains("line", F.concat(F.lit("|"), c, F.lit("|")))
    return tagged.join(columns.select("column"), mentioned).select("tag", "column").distinct()
