"""Queries on columns: expressions, cardinality, correlation, variation within groups, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr, stats
from ..operators import profile as prof
from .common import read, rounded

_ITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_NULLS = {"a": "nullif(l_linenumber, 1)", "b": "nullif(l_returnflag, 'N')", "c": "nullif(l_quantity, 7)", "d": "case when l_linenumber = 1 or l_quantity > 45 then null else l_tax end"}


def _expression(spark, d):
    li = read(spark, d, "lineitem")
    texts = {"unit_price": "l_extendedprice / l_quantity", "logged": "log1p(l_extendedprice) - log(l_quantity)", "rooted": "sqrt(abs(l_discount - l_tax)) ** 2", "parts": "floor(l_quantity / 7) + l_quantity % 7", "flag": "(l_discount > l_tax) & (l_quantity <= 25)", "undefined": "1 / (l_discount * 0)"}
    return li.select("l_orderkey", "l_linenumber", *[F.round(expr.compile_expression(t, li).column, 9).alias(n) for n, t in texts.items()])


def _differences(spark, d):
    li = read(spark, d, "lineitem").withColumn("secs", F.unix_timestamp(F.col("l_shipdate").cast("timestamp")))
    return li.select(
        "l_orderkey", "l_linenumber", F.round(expr.difference("l_discount", "l_tax"), 6).alias("diff"), F.round(expr.quotient("l_tax", "l_discount"), 6).alias("quot"),
        F.round(expr.scaled_difference("secs", "l_quantity"), 6).alias("scaled"), expr.floored_difference("secs", "l_quantity").alias("floored"),
    )


def _variation(spark, d):
    li = read(spark, d, "lineitem")
    return rounded(stats.variation(li, expr.compile_expression("l_extendedprice / l_quantity", li).column, ["l_partkey"]), 6)


def _invariant(spark, d):
    li = read(spark, d, "lineitem")
    got = stats.most_invariant(li, expr.compile_expression("l_extendedprice / l_quantity", li).column, ["l_partkey"])
    return rounded(got, 4)


def _nulled(spark, d):
    return read(spark, d, "lineitem").select(*[F.expr(e).alias(k) for k, e in _NULLS.items()])


def _typed(spark, d):
    return rounded(prof.kinds(read(spark, d, "lineitem")), 6)


_GAPS = {"p_size": "p_size", "p_retailprice": "p_retailprice", "p_brand": "p_brand", "a": "nullif(p_size, 1)", "b": "nullif(p_brand, 'Brand#11')"}


def _extended(spark, d):
    got = prof.extended(read(spark, d, "part").selectExpr(*[f"{e} as {c}" for c, e in _GAPS.items()]))
    return rounded(got.withColumns({"top5_values": F.array_join("top5_values", "|"), "top5_counts": F.array_join(F.col("top5_counts").cast("array<string>"), "|")}), 4)


def _profile(table):
    return lambda spark, d: rounded(prof.profile(read(spark, d, table)), 4)


QUERIES = {
    "safe_expression": _expression,
    "derived_differences": _differences,
    "within_group_variance": _variation,
    "most_invariant_groups": _invariant,
    "cardinality": lambda s, d: stats.cardinality(_nulled(s, d), ["a", "b", "c", "d"]),
    "cardinality_pair": lambda s, d: stats.combined_cardinality(_nulled(s, d), ["a", "c"]),
    "correlation": lambda s, d: rounded(stats.correlation(_nulled(s, d).withColumn("e", F.col("c") * F.col("c") + F.col("a")), "c", "e"), 6),
    "correlated_pairs": lambda s, d: stats.correlated_pairs(read(s, d, "lineitem").selectExpr(*_ITEM, "l_extendedprice * (1 - l_discount) as net", "l_quantity * 2 + l_tax as load"), [*_ITEM, "net", "load"]),
    "non_null_pairs": lambda s, d: _nulled(s, d).agg(F.count_if(stats.present(F.col("a"), F.col("b"))).alias("ab"), F.count_if(stats.present(F.col("c"), F.col("d"))).alias("cd")),
    "column_kinds": _typed,
    "profile_customer": _profile("customer"),
    "profile_part": _profile("part"),
    "profile_quantiles": lambda s, d: rounded(prof.quantiles(read(s, d, "part").select("p_size", "p_retailprice")), 4),
    "profile_extended": _extended,
    "profile_top_values": lambda s, d: prof.top5(read(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]),
    "conditional_distribution": lambda s, d: rounded(stats.conditional_distribution(read(s, d, "events"), "value", "event_type", 3), 6),
    "conditional_top_values": lambda s, d: stats.conditional_top_values(read(s, d, "orders"), "o_orderstatus", "o_orderpriority", 3),
    "icc_by_key": lambda s, d: rounded(stats.icc(read(s, d, "lineitem"), F.col("l_extendedprice"), ["l_suppkey"]), 6),
    "icc_by_pair": lambda s, d: rounded(stats.icc(_nulled(s, d), F.col("c"), ["a", "b"]), 6),
    "missingness_correlation": lambda s, d: rounded(stats.missingness(_nulled(s, d), ["a", "b", "c", "d"]), 6),
    "infinite_to_missing": lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_linenumber", expr.finite(F.when(F.col("l_discount") == 0, float("inf")).when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_discount"))).alias("value")),
}

_N = ", ".join(f"{e} AS {k}" for k, e in _NULLS.items())
_CORR = "CASE WHEN stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) > 0 AND stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) * stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL)) END"


def _union(parts):
    return " UNION ALL ".join(parts)


def _pairs(names):
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def _profile_sql(table, columns):
    num = lambda c, f: f"coalesce({f}(CAST({c} AS DOUBLE)), 0.0)"
    return _union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS cardinality, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 4) AS missingness_rate, round({num(c, 'avg') if n else '0.0'}, 4)::DOUBLE AS mean, round({num(c, 'stddev_samp') if n else '0.0'}, 4)::DOUBLE AS std FROM {table}" for c, n in columns])


def _extended_sql():
    """A column with missing values is a group of its own here, as there are no more than ten."""
    def number(c):
        if c in ("p_brand", "b"):
            return ", ".join(f"NULL::DOUBLE AS {n}" for n in ("p5", "p25", "p75", "p95", "skewness"))
        return ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 4) AS {n}" for p, n in ((0.05, "p5"), (0.25, "p25"), (0.75, "p75"), (0.95, "p95"))) + f", round(skewness(CAST({c} AS DOUBLE)), 4) AS skewness"

    own = _union([f"SELECT {i} AS i, '{c}' AS \"column\", {number(c)}, count(*) - count({c}) AS gaps FROM t" for i, c in enumerate(_GAPS)])
    top = _union([f"SELECT {i} AS i, string_agg(v, '|' ORDER BY n DESC, v) AS top5_values, string_agg(CAST(n AS VARCHAR), '|' ORDER BY n DESC, v) AS top5_counts FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5)" for i, c in enumerate(_GAPS)])
    return f"""WITH t AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _GAPS.items())} FROM part), o AS ({own}), p AS ({top}),
        g AS (SELECT i, CAST(row_number() OVER (ORDER BY i) - 1 AS INT) AS missingness_group, count(*) OVER () AS many FROM o WHERE gaps > 0)
        SELECT "column", p5, p25, p75, p95, skewness, top5_values, top5_counts, missingness_group FROM o JOIN p USING (i) LEFT JOIN (SELECT * FROM g WHERE many > 1) USING (i)"""


_GROUPS = "WITH g AS (SELECT l_partkey, avg(v) AS mean, stddev_samp(v) AS std, count(v) AS n FROM (SELECT l_partkey, CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS v FROM lineitem) WHERE l_partkey IS NOT NULL AND v IS NOT NULL GROUP BY l_partkey HAVING count(v) >= 10), c AS (SELECT *, CASE WHEN abs(mean) > 0 THEN std / abs(mean) END AS cv FROM g)"
_LINE = {"l_orderkey": 1, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 1, "l_extendedprice": 1, "l_discount": 1, "l_tax": 1, "l_returnflag": 0, "l_linestatus": 0, "l_shipdate": 0}
_ICC = """SELECT round(CASE WHEN k >= 2 AND n > k AND msb + (n / k - 1) * msw > 0 THEN (msb - msw) / (msb + (n / k - 1) * msw) ELSE 0 END, 6) AS icc FROM (
SELECT n, k, (q - n * gm * gm) / nullif(k - 1, 0) AS msb, ssw / nullif(n - k, 0) AS msw FROM (
SELECT sum(n) AS n, CAST(count(*) AS DOUBLE) AS k, sum(n * m) / sum(n) AS gm, sum(n * m * m) AS q, sum(n * s2) AS ssw FROM (
SELECT g, CAST(count(v) AS DOUBLE) AS n, avg(v) AS m, var_pop(v) AS s2 FROM ({rows}) WHERE v IS NOT NULL GROUP BY g)))"""

SQL = {
    "safe_expression": """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END, 9) AS unit_price,
        round(ln(1 + l_extendedprice) - ln(l_quantity), 9) AS logged, round(pow(sqrt(abs(l_discount - l_tax)), 2), 9) AS rooted,
        round(floor(l_quantity / 7) + (l_quantity - 7 * floor(l_quantity / 7)), 9) AS parts,
        round(CASE WHEN l_discount > l_tax AND l_quantity <= 25 THEN 1.0 ELSE 0.0 END, 9)::DOUBLE AS flag, NULL::DOUBLE AS undefined FROM lineitem""",
    "derived_differences": """SELECT l_orderkey, l_linenumber, round(l_discount - l_tax, 6) AS diff, round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END, 6) AS quot,
        round(epoch(l_shipdate)::BIGINT::DOUBLE / 86400.0::DOUBLE - l_quantity, 6) AS scaled, floor(epoch(l_shipdate)::BIGINT::DOUBLE / 86400.0::DOUBLE) - l_quantity AS floored FROM lineitem""",
    "within_group_variance": _GROUPS + " SELECT round(quantile_cont(cv, 0.5), 6) AS median_cv, round(avg(cv), 6) AS mean_cv, count(*) AS n_groups, count(*) FILTER (WHERE cv < 0.1) AS n_invariant FROM c",
    "most_invariant_groups": _GROUPS + " SELECT l_partkey, round(mean, 4) AS mean, round(std, 4) AS std, n, round(cv, 4) AS cv FROM c WHERE cv IS NOT NULL ORDER BY c.cv, l_partkey LIMIT 5",
    "cardinality": f"WITH t AS (SELECT {_N} FROM lineitem) " + _union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM t" for c in "abcd"]),
    "cardinality_pair": f"WITH t AS (SELECT {_N} FROM lineitem) SELECT count(*) AS n_groups FROM (SELECT DISTINCT a, c FROM t WHERE a IS NOT NULL AND c IS NOT NULL)",
    "correlation": f"""WITH t AS (SELECT *, c * c + a AS e FROM (SELECT {_N} FROM lineitem)), p AS (SELECT c, e FROM t WHERE c IS NOT NULL AND e IS NOT NULL),
        r AS (SELECT rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0::DOUBLE AS rc, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0::DOUBLE AS re FROM p)
        SELECT round((SELECT corr(c, e) FROM p), 6) AS pearson, (SELECT count(*) FROM p) AS n_complete, round((SELECT corr(rc, re) FROM r), 6) AS spearman""",
    "correlated_pairs": "WITH t AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net, l_quantity * 2 + l_tax AS load FROM lineitem), r AS ("
    + _union([f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_CORR.format(a=a, b=b)} AS r FROM t" for a, b in _pairs([*_ITEM, "net", "load"])])
    + ") SELECT col_a, col_b, round(r, 4) AS correlation FROM r WHERE abs(r) > 0.8",
    "non_null_pairs": f"WITH t AS (SELECT {_N} FROM lineitem) SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS ab, count(*) FILTER (WHERE c IS NOT NULL AND d IS NOT NULL) AS cd FROM t",
    "column_kinds": _union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, " + (f"CASE WHEN count(DISTINCT {c}) >= 20 THEN 'numeric' ELSE 'categorical' END" if n else "'categorical'") + " AS kind FROM lineitem" for c, n in _LINE.items()]),
    "profile_customer": _profile_sql("customer", [("c_custkey", 1), ("c_name", 0), ("c_nationkey", 1), ("c_acctbal", 1), ("c_mktsegment", 0)]),
    "profile_part": _profile_sql("part", [("p_partkey", 1), ("p_name", 0), ("p_brand", 0), ("p_type", 0), ("p_size", 1), ("p_retailprice", 1)]),
    "profile_quantiles": _union([f"SELECT '{c}' AS \"column\", " + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 4) AS {n}" for p, n in ((0.05, "p5"), (0.25, "p25"), (0.75, "p75"), (0.95, "p95"))) + f", round(skewness(CAST({c} AS DOUBLE)), 4) AS skewness FROM part" for c in ("p_size", "p_retailprice")]),
    "profile_extended": _extended_sql(),
    "profile_top_values": "WITH l AS (" + _union([f"SELECT '{c}' AS \"column\", {t} AS v FROM lineitem" for c, t in (("l_returnflag", "l_returnflag"), ("l_linestatus", "l_linestatus"), ("l_linenumber", "CAST(l_linenumber AS VARCHAR)"), ("l_quantity", "CAST(l_quantity AS VARCHAR)"))]) + "), n AS (SELECT \"column\", v AS value, count(*) AS n FROM l GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS place FROM n) SELECT * FROM p WHERE place <= 5",
    "conditional_distribution": """WITH b AS (SELECT event_type FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
        SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75
        FROM events WHERE event_type IN (SELECT event_type FROM b) GROUP BY 1 HAVING count(value) > 0""",
    "conditional_top_values": """WITH b AS (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), n AS (SELECT o_orderpriority, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM b) GROUP BY 1, 2)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, value) AS place FROM n) WHERE place <= 5""",
    "icc_by_key": _ICC.format(rows="SELECT coalesce(CAST(l_suppkey AS VARCHAR), '-999') AS g, l_extendedprice AS v FROM lineitem"),
    "icc_by_pair": _ICC.format(rows=f"SELECT coalesce(CAST(a AS VARCHAR), '-999') || '_' || coalesce(b, '-999') AS g, c AS v FROM (SELECT {_N} FROM lineitem)"),
    "missingness_correlation": f"WITH t AS (SELECT " + ", ".join(f"CAST({k} IS NULL AS INT) AS {k}" for k in "abcd") + f" FROM (SELECT {_N} FROM lineitem)) " + _union([f"SELECT '{x}' AS col_a, '{y}' AS col_b, round(coalesce({_CORR.format(a=x, b=y)}, 0), 6) AS correlation, round((1 - coalesce({_CORR.format(a=x, b=y)}, 0)) / 2, 6) AS distance FROM t" for x, y in _pairs("abcd")]),
    "infinite_to_missing": "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 OR l_tax = 0 THEN NULL ELSE l_discount END AS value FROM lineitem",
}
