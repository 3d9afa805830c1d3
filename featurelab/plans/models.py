"""Queries on models, attribution and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import cut
from ..operators import discover, model, splits
from ..streaming import streams
from .common import read, rounded

FOLDS = 5


def _part(s, d):
    p = read(s, d, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice")
    li = read(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_extendedprice").alias("mean_price"), F.count("*").alias("n_sold"))
    both = cut(p.join(li, "p_partkey", "left"))  # later passes read no line items
    return splits.stratified_split(splits.strata(both, "p_retailprice"), "p_partkey", "stratum", FOLDS)


_FEATURES = ["p_size", "p_brand", "p_type", "mean_price", "n_sold"]


def _cv(s, d):
    r = model.cross_validate(_part(s, d), _FEATURES, "p_retailprice", "rmse", "p_partkey", FOLDS)
    return s.createDataFrame([(k, v) for k, v in enumerate(r["scores"])], "fold int, rmse double")


def _multiclass(s, d):
    o = read(s, d, "orders").withColumns({"month": F.month("o_orderdate"), "dow": F.weekday("o_orderdate")})
    df = splits.stratified_split(o, "o_orderkey", "o_orderstatus", FOLDS)
    r = model.cross_validate(df, ["o_totalprice", "month", "dow"], "o_orderstatus", "f1", "o_orderkey", FOLDS)
    return s.createDataFrame([(k, v) for k, v in enumerate(r["scores"])], "fold int, f1 double")


def _shap(s, d):
    r = model.cross_validate(_part(s, d), _FEATURES, "p_retailprice", "rmse", "p_partkey", FOLDS, shap=True)
    return s.createDataFrame([(f, v, r["shap_std"][f]) for f, v in r["shap"].items()], "feature string, value double, std double")


def _residual(s, d):
    df = read(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    got = model.residuals(df, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return rounded(discover.residual_icc(got, F.col("residual"), [["l_partkey"], ["l_suppkey"]]), 4)


def _residual_class(s, d):
    """Three labels: the residual is 1 - p of the order's own status."""
    df = read(s, d, "orders").select("o_orderstatus", "o_totalprice", F.month("o_orderdate").alias("month"), "o_orderpriority", F.weekday("o_orderdate").alias("dow"))
    left = model.entity_residuals(df, "o_orderstatus", "f1")
    return rounded(discover.residual_icc(left, F.col("residual"), [["o_orderpriority"], ["month", "dow"]]), 4)


def _stream(make, name):
    def query(s, d):
        schema = read(s, d, "events").schema
        got = streams.drained(make(streams.event_stream(s, f"{d}/events.parquet*", schema)), name)
        return got.withColumn("begin", F.col("begin").cast("timestamp_ntz"))  # as the table has it

    return query


QUERIES = {
    "gbt_cv_scores": _cv,
    "gbt_multiclass": _multiclass,
    "shap_by_fold": _shap,
    "model_residual_icc": _residual,
    "model_residual_icc_class": _residual_class,
    "stream_windows": lambda s, d: rounded(_stream(streams.windows, "windows")(s, d), 4),
    "stream_sessions": _stream(streams.sessions, "sessions"),
}

SQL = {
    "stream_windows": "SELECT event_type, date_trunc('day', ts) AS begin, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS begin, count(*) AS n FROM s GROUP BY user_id, k",
}
