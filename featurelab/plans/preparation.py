"""Queries on splits, the guard and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guard, splits
from ..operators import transforms as tf
from ..operators.fitted import FoldFeature, stacked
from ..operators.splits import Folds
from .common import read, rounded


def _folded(s, d):
    """Orders with split and fold, by priority."""
    return splits.stratified_split(read(s, d, "orders"), "o_orderkey", "o_orderpriority")


def _train(s, d):
    return _folded(s, d).filter("split = 'train'")


def _apply(transforms, keys, table, places=6):
    def query(s, d):
        df = read(s, d, table)
        train = df
        out = df
        for t in transforms:
            out = t.apply(train, out)
        return rounded(out.select(*keys, *[t.name for t in transforms]), places)

    return query


def _temporal(s, d):
    return splits.temporal_split(read(s, d, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "split", F.col("chunk").cast("bigint"))


def _temporal_folds(s, d):
    parts = splits.temporal_split(read(s, d, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")])
    return splits.fold_roles(parts).select(F.col("fold").cast("bigint"), "role", "o_orderkey")


def _ordinal(s, d):
    df = _folded(s, d).withColumn("status", F.when(F.col("o_orderkey") % 7 != 0, F.concat("o_orderstatus", F.col("o_custkey") % 40)))
    train = df.filter("split = 'train' and o_custkey % 40 <> 3")
    return guard.encode(df, "status", guard.ordinal_codes(train, "status", "o_orderkey")).select("o_orderkey", F.col("status").cast("double"))


def _impute(kind):
    def query(s, d):
        df = _folded(s, d).withColumns({"price": F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice")), "empty": F.lit(None).cast("double")})
        train, test = df.filter("split = 'train'"), df.filter("split = 'test'")
        g = guard.Guard(["price", "empty"], "o_orderkey", kind).fit(train)
        return rounded(g.transform(test).select("o_orderkey", "price", "empty"), 4)

    return query


def _onehot(s, d):
    df = _folded(s, d)
    train = df.filter("split = 'train'")
    ts = tf.onehot_all(train, "o_orderstatus")
    for t in ts:
        df = t.apply(train, df)
    return df.select("o_orderkey", *[F.col(t.name) for t in ts])


def _categories(s, d):
    df, train = _folded(s, d), _train(s, d)
    df = tf.count_encoding(train, df, "o_orderpriority", "n")
    df = tf.frequency_encoding(train, df, "o_orderpriority", "freq")
    df = tf.label_encoding(train, df, "o_orderpriority", "label")
    df = tf.ordinal("o_orderstatus", ["O", "P", "F"], "ordinal").apply(train, df)
    return rounded(df.select("o_orderkey", "n", "freq", "label", "ordinal"), 9)


def _target(s, d):
    df = _folded(s, d)
    return rounded(tf.target_encoding(df.filter("split = 'train'"), df, "o_custkey", "o_totalprice", "value").select("o_orderkey", "value"), 7)


def _oof(s, d):
    return rounded(tf.target_encoding_oof(_train(s, d), "o_custkey", "o_totalprice", "fold", "value").select("o_orderkey", "fold", "value"), 7)


def _cells(s, d):
    li = read(s, d, "lineitem").withColumns({"cell_a": F.floor(F.col("l_quantity") / 10), "cell_b": F.floor(F.col("l_discount") * 50)})
    return rounded(tf.group_aggregate(li, li, ["cell_a", "cell_b"], "l_tax").select("l_orderkey", "l_linenumber", "l_tax_mean", "l_tax_std"), 6)


def _clusters(s, d):
    df = read(s, d, "customer").join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return tf.clustering(df, df, ["c_acctbal", "n_regionkey"], 5).groupBy("cluster").agg(F.count("*").alias("n"))


def _by_fold(spec, table, key, target, places, temporal=False):
    """The feature of every fold, for all rows that a fold reads."""
    def query(s, d):
        df = splits.temporal_split(read(s, d, "orders"), [F.col("o_orderdate"), F.col("o_orderkey")]) if temporal else _folded(s, d)
        folds = Folds.of(df, 5)
        got, where = stacked(df.filter("split = 'train'").filter(folds.part().isNotNull()), [FoldFeature.parse(spec)], target, folds)
        long = got.select(key, F.posexplode(F.array(*[F.col(c).cast("double") for c in where[spec]])).alias("k", "value"))
        return rounded(long.select(key, F.col("k").cast("bigint").alias("fold"), "value"), places)

    return query


_MATH = [tf.log("l_extendedprice", "t_log"), tf.sqrt("l_quantity", "t_sqrt"), tf.power("l_discount", 3.0, "t_power"), tf.reciprocal("l_tax", "t_reciprocal"), tf.absolute("l_discount", "t_abs")]
_DATE = [tf.day_of_week("l_shipdate", "t_dow"), tf.month("l_shipdate", "t_month"), tf.year("l_shipdate", "t_year"), tf.time_since("l_shipdate", "1995-01-01", "t_since"), tf.is_weekend("l_shipdate", "t_weekend"), tf.season("l_shipdate", "t_season")]
_INTER = [tf.product("l_quantity", "l_tax", "t_product"), tf.quotient("l_tax", "l_discount", "t_ratio"), tf.difference("l_tax", "l_discount", "t_difference"), tf.total("l_tax", "l_discount", "t_sum")]
_BINS = [tf.quantile_bin("p_retailprice", 10, "t_quantile"), tf.equal_width_bin("p_retailprice", 7, "t_width"), tf.custom_bin("p_size", [5, 10, 25], "t_custom")]
_ROW = ["l_orderkey", "l_linenumber"]

QUERIES = {
    "temporal_split": _temporal,
    "temporal_folds": _temporal_folds,
    "stratified_folds": lambda s, d: _folded(s, d).select("o_orderkey", "split", F.col("fold").cast("bigint")),
    "quantile_strata": lambda s, d: splits.strata(read(s, d, "part"), "p_retailprice").select("p_partkey", "stratum"),
    "hash_sample": lambda s, d: splits.hash_sample(read(s, d, "orders"), "o_orderkey", 1000).select("o_orderkey"),
    "guard_ordinal": _ordinal,
    "guard_impute_train": _impute("train"),
    "guard_impute_self": _impute("self"),
    "t_mathematical": _apply(_MATH, _ROW, "lineitem"),
    "t_clip": _apply([tf.clip("l_extendedprice", 0.05, 0.9, "t_clip")], _ROW, "lineitem", 4),
    "t_normalize": _apply([tf.zscore("l_extendedprice", "t_z"), tf.minmax("l_extendedprice", "t_unit")], _ROW, "lineitem"),
    "t_datetime": _apply(_DATE, _ROW, "lineitem"),
    "t_interaction": _apply(_INTER, _ROW, "lineitem", 9),
    "t_bins": _apply(_BINS, ["p_partkey"], "part"),
    "t_onehot": _onehot,
    "t_categories": _categories,
    "t_target_mean": _target,
    "t_target_out_of_fold": _oof,
    "fold_target_encoding": _by_fold("target:o_custkey", "orders", "o_orderkey", "o_totalprice", 6),
    "fold_target_out_of_fold": _by_fold("oof:o_custkey", "orders", "o_orderkey", "o_totalprice", 6),
    "fold_clip": _by_fold("clip:o_totalprice:0.05:0.9", "orders", "o_orderkey", "o_shippriority", 4),
    "fold_zscore": _by_fold("zscore:o_totalprice", "orders", "o_orderkey", "o_shippriority", 6),
    "fold_labels": _by_fold("label:o_custkey", "orders", "o_orderkey", "o_totalprice", 1),
    "fold_group_std": _by_fold("group_std:o_totalprice:o_orderpriority:o_orderstatus", "orders", "o_orderkey", "o_shippriority", 5),
    "chunk_target_encoding": _by_fold("target:o_custkey", "orders", "o_orderkey", "o_totalprice", 6, True),
    "chunk_frequency": _by_fold("frequency:o_orderpriority", "orders", "o_orderkey", "o_totalprice", 9, True),
    "t_geo_aggregate": _cells,
    "t_clustering": _clusters,
}

_FOLDED = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey) AS rn,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
  o AS (SELECT * EXCLUDE (rn, n), CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split, CASE WHEN rn > round(n * 0.2) THEN CAST((rn - round(n * 0.2) - 1) % 5 AS BIGINT) END AS fold FROM r)"""

_CHUNKED = """WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, CAST(floor(count(*) OVER () * 0.8) AS BIGINT) AS pool FROM orders),
  tr AS (SELECT *, (rn - 1) // (pool // 6) + 1 AS part FROM r WHERE rn <= pool AND (rn - 1) // (pool // 6) + 1 <= 6), f AS (SELECT k AS fold FROM range(5) t(k)), ok AS (SELECT * FROM tr JOIN f ON part <= fold + 1)"""
_BY_FOLD = _FOLDED + ", tr AS (SELECT *, fold AS part FROM o WHERE split = 'train'), f AS (SELECT k AS fold FROM range(5) t(k)), ok AS (SELECT tr.* EXCLUDE (fold), f.fold FROM tr JOIN f ON part <> f.fold)"
_MEANS = ", g AS (SELECT fold, avg(o_totalprice) AS g FROM ok GROUP BY 1), t AS (SELECT fold, o_custkey, avg(o_totalprice) AS v FROM ok GROUP BY 1, 2) SELECT o_orderkey, g.fold, round(coalesce(v, g), 6) AS value FROM tr CROSS JOIN g LEFT JOIN t ON t.fold = g.fold AND t.o_custkey = tr.o_custkey"

SQL = {
    "fold_target_encoding": _BY_FOLD + _MEANS,
    "chunk_target_encoding": _CHUNKED + _MEANS,
    "fold_target_out_of_fold": _BY_FOLD + """, g AS (SELECT fold, avg(o_totalprice) AS g FROM ok GROUP BY 1), p AS (SELECT o_custkey AS c, part, sum(o_totalprice) AS s, count(*) AS n FROM tr GROUP BY 1, 2),
        w AS (SELECT o_orderkey, g.fold, any_value(g) AS g, sum(s) AS s, sum(n) AS n FROM tr CROSS JOIN g LEFT JOIN p ON c = o_custkey AND p.part <> g.fold AND p.part <> tr.part GROUP BY 1, 2)
        SELECT o_orderkey, fold, round(coalesce(s / n, g), 6) AS value FROM w""",
    "fold_clip": _BY_FOLD + ", q AS (SELECT fold, quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.9) AS hi FROM ok GROUP BY 1) SELECT o_orderkey, q.fold, round(least(greatest(o_totalprice, lo), hi), 4) AS value FROM tr CROSS JOIN q",
    "fold_zscore": _BY_FOLD + ", q AS (SELECT fold, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM ok GROUP BY 1) SELECT o_orderkey, q.fold, round((o_totalprice - m) / sd, 6) AS value FROM tr CROSS JOIN q",
    "fold_labels": _BY_FOLD + """, l AS (SELECT fold, o_custkey, row_number() OVER (PARTITION BY fold ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS code FROM (SELECT DISTINCT fold, o_custkey FROM ok))
        SELECT o_orderkey, f.fold, CAST(coalesce(code, -1) AS DOUBLE) AS value FROM tr CROSS JOIN f LEFT JOIN l ON l.fold = f.fold AND l.o_custkey = tr.o_custkey""",
    "fold_group_std": _BY_FOLD + """, q AS (SELECT fold, o_orderpriority AS p, o_orderstatus AS t, stddev_samp(o_totalprice) AS sd FROM ok GROUP BY 1, 2, 3)
        SELECT o_orderkey, f.fold, round(sd, 5) AS value FROM tr CROSS JOIN f LEFT JOIN q ON q.fold = f.fold AND p = o_orderpriority AND t = o_orderstatus""",
    "chunk_frequency": _CHUNKED + """, n AS (SELECT fold, count(*) AS n FROM ok GROUP BY 1), q AS (SELECT fold, o_orderpriority AS p, count(*) AS c FROM ok GROUP BY 1, 2)
        SELECT o_orderkey, n.fold, round(coalesce(c, 0) / CAST(n AS DOUBLE), 9) AS value FROM tr CROSS JOIN n LEFT JOIN q ON q.fold = n.fold AND p = o_orderpriority""",
    "temporal_split": """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, CAST(floor(count(*) OVER () * 0.8) AS BIGINT) AS pool FROM orders),
        c AS (SELECT *, (rn - 1) // (pool // 6) + 1 AS chunk FROM r)
        SELECT o_orderkey, CASE WHEN rn > pool THEN 'test' ELSE 'train' END AS split, CASE WHEN rn <= pool AND chunk <= 6 THEN chunk END AS chunk FROM c""",
    "temporal_folds": """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, CAST(floor(count(*) OVER () * 0.8) AS BIGINT) AS pool FROM orders),
        f AS (SELECT o_orderkey, rn, pool // 6 AS size, k FROM r, range(5) t(k) WHERE rn <= pool)
        SELECT k AS fold, CASE WHEN rn <= size * (k + 1) THEN 'train' ELSE 'validation' END AS role, o_orderkey FROM f WHERE rn <= size * (k + 2)""",
    "stratified_folds": _FOLDED + " SELECT o_orderkey, split, fold FROM o",
    "quantile_strata": "WITH e AS (SELECT " + ", ".join(f"quantile_cont(p_retailprice, {i / 10}) AS q{i}" for i in range(1, 10)) + " FROM part) SELECT p_partkey, CAST(" + " + ".join(f"CASE WHEN p_retailprice > q{i} THEN 1 ELSE 0 END" for i in range(1, 10)) + " AS VARCHAR) AS stratum FROM part, e",
    "hash_sample": "SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|42'), 1, 8) AS BIGINT) % 10 = 0",
    "guard_ordinal": _FOLDED + """, x AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus || CAST(o_custkey % 40 AS VARCHAR) END AS st FROM o),
        f AS (SELECT st, min(o_orderkey) AS k FROM x WHERE split = 'train' AND o_custkey % 40 <> 3 AND st IS NOT NULL GROUP BY st),
        c AS (SELECT st, row_number() OVER (ORDER BY k, st) - 1 AS code FROM f)
        SELECT o_orderkey, CASE WHEN x.st IS NOT NULL THEN CAST(coalesce(code, -1) AS DOUBLE) END AS status FROM x LEFT JOIN c ON x.st = c.st""",
    "guard_impute_train": _FOLDED + """, m AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM o WHERE split = 'train' AND o_custkey % 5 <> 0)
        SELECT o_orderkey, round(CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice ELSE m END, 4) AS price, 0.0::DOUBLE AS empty FROM o, m WHERE split = 'test'""",
    "guard_impute_self": _FOLDED + """, m AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM o WHERE split = 'test' AND o_custkey % 5 <> 0)
        SELECT o_orderkey, round(CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice ELSE m END, 4) AS price, 0.0::DOUBLE AS empty FROM o, m WHERE split = 'test'""",
    "t_mathematical": "SELECT l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 6) AS t_log, round(sqrt(l_quantity), 6) AS t_sqrt, round(pow(l_discount, 3), 6) AS t_power, round(CASE WHEN l_tax <> 0 THEN 1 / l_tax END, 6) AS t_reciprocal, round(abs(l_discount), 6) AS t_abs FROM lineitem",
    "t_clip": "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.05) AS lo, quantile_cont(l_extendedprice, 0.9) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, lo), hi), 4) AS t_clip FROM lineitem, q",
    "t_normalize": "WITH q AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_extendedprice - m) / sd, 6) AS t_z, round((l_extendedprice - lo) / (hi - lo), 6) AS t_unit FROM lineitem, q",
    "t_datetime": "SELECT l_orderkey, l_linenumber, CAST(isodow(l_shipdate) - 1 AS INT) AS t_dow, CAST(month(l_shipdate) AS INT) AS t_month, CAST(year(l_shipdate) AS INT) AS t_year, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INT) AS t_since, CAST(isodow(l_shipdate) >= 6 AS INT) AS t_weekend, CAST((month(l_shipdate) % 12) // 3 AS INT) AS t_season FROM lineitem",
    "t_interaction": "SELECT l_orderkey, l_linenumber, round(l_quantity * l_tax, 9) AS t_product, round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END, 9) AS t_ratio, round(l_tax - l_discount, 9) AS t_difference, round(l_tax + l_discount, 9) AS t_sum FROM lineitem",
    "t_bins": "WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, " + ", ".join(f"quantile_cont(p_retailprice, {i / 10}) AS q{i}" for i in range(1, 10)) + " FROM part) SELECT p_partkey, CAST(" + " + ".join(f"CASE WHEN p_retailprice > q{i} THEN 1 ELSE 0 END" for i in range(1, 10)) + " AS INT) AS t_quantile, CAST(least(floor((p_retailprice - lo) * 7 / (hi - lo)), 6) AS INT) AS t_width, CAST((p_size > 5)::INT + (p_size > 10)::INT + (p_size > 25)::INT AS INT) AS t_custom FROM part, e",
    "t_onehot": "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS o_orderstatus_is_F, CAST(o_orderstatus = 'O' AS INT) AS o_orderstatus_is_O, CAST(o_orderstatus = 'P' AS INT) AS o_orderstatus_is_P FROM orders",
    "t_categories": _FOLDED + """, t AS (SELECT o_orderpriority AS p, count(*) AS n FROM o WHERE split = 'train' GROUP BY 1), l AS (SELECT *, row_number() OVER (ORDER BY p) - 1 AS label, sum(n) OVER () AS tot FROM t)
        SELECT o_orderkey, coalesce(n, 0) AS n, round(coalesce(n, 0) / CAST(tot AS DOUBLE), 9) AS freq, CAST(coalesce(label, -1) AS INT) AS label, CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE -1 END AS INT) AS ordinal FROM o LEFT JOIN l ON o_orderpriority = p""",
    "t_target_mean": _FOLDED + """, g AS (SELECT avg(o_totalprice) AS g FROM o WHERE split = 'train'), t AS (SELECT o_custkey AS c, avg(o_totalprice) AS v FROM o WHERE split = 'train' GROUP BY 1)
        SELECT o_orderkey, round(coalesce(v, g), 7) AS value FROM o CROSS JOIN g LEFT JOIN t ON o_custkey = c""",
    "t_target_out_of_fold": _FOLDED + """, tr AS (SELECT * FROM o WHERE split = 'train'), g AS (SELECT avg(o_totalprice) AS g FROM tr),
        p AS (SELECT o_custkey AS c, fold AS f, sum(o_totalprice) AS s, count(*) AS n FROM tr GROUP BY 1, 2), w AS (SELECT c, sum(s) AS bs, sum(n) AS bn FROM p GROUP BY 1)
        SELECT o_orderkey, fold, round(coalesce(CASE WHEN bn > n THEN (bs - s) / (bn - n) END, g), 7) AS value FROM tr CROSS JOIN g JOIN p ON o_custkey = c AND fold = f JOIN w ON w.c = p.c""",
    "t_geo_aggregate": "SELECT l_orderkey, l_linenumber, round(avg(l_tax) OVER w, 6) AS l_tax_mean, round(stddev_samp(l_tax) OVER w, 6) AS l_tax_std FROM lineitem WINDOW w AS (PARTITION BY floor(l_quantity / 10), floor(l_discount * 50))",
}
