"""Queries on discovery: derived expressions, entity keys, near-constant expressions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import expr, text
from ..operators import discover
from ..operators.splits import hash_sample
from .common import read, rounded

_KEYS = [["l_partkey"], ["o_custkey"], ["l_suppkey"], ["l_suppkey", "l_linenumber"]]
_EXPRESSIONS = ["p_retailprice", "c_acctbal", "p_size", "l_extendedprice / l_quantity", "l_quantity - l_discount", "l_suppkey / l_linenumber"]
_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def joined(s, d):
    li, o, p, c = (read(s, d, t) for t in ("lineitem", "orders", "part", "customer"))
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))


def _log_variance(df):
    return df.select("expr", F.round(F.ln("variance"), 6).alias("log_variance"))


def _scan(s, d):
    df = joined(s, d)
    made = {t: expr.compile_expression(t, df) for t in _EXPRESSIONS}
    return rounded(discover.invariants(df, _KEYS, {t: m.column for t, m in made.items()}, {t: set(m.references) for t, m in made.items()}), 6)


def _ids(s, d):
    df = discover.derived(read(s, d, "lineitem").select(*_NUMERIC))
    return df.select("expr", F.concat(F.lit("derived_"), F.substring(F.sha2("expr", 256), 1, 8)).alias("id"))


def _tagged(s, d):
    df = read(s, d, "lineitem").withColumn("secs", F.unix_timestamp(F.col("l_shipdate").cast("timestamp")))
    return _log_variance(discover.derived(df, {"monetary": ["l_extendedprice", "l_tax"], "temporal": ["secs", "l_quantity"]}))


#: What a user says of the columns.
_BRIEF = """| `l_extendedprice` | price of all pieces |
| `l_tax` | a fee on top |
| `secs` | seconds since 1970 |
| l_quantity | elapsed days, for the sake of the query |
| `l_comment` | what else there is to say |"""


def _by_brief(s, d):
    df = read(s, d, "lineitem").withColumn("secs", F.unix_timestamp(F.col("l_shipdate").cast("timestamp")))
    return _log_variance(discover.derived(df, text.tagged(s, _BRIEF, df.columns)))


_FOUND = {"l_partkey": 0, "o_custkey": 0, "l_quantity": 1, "p_retailprice": 1, "p_size": 0, "c_acctbal": 1}  # number -> fractional
_TEXT = ["c_name", "p_brand"]


def _found(s, d):
    """All of discovery on the joined tables: keys and expressions are those that are found."""
    return rounded(discover.scan(joined(s, d).select(*_FOUND, *_TEXT)).steady, 6)


QUERIES = {
    "invariant_scan_found": _found,
    "derived_variance": lambda s, d: _log_variance(discover.derived(read(s, d, "lineitem").select(*_NUMERIC))),
    "derived_tagged": _tagged,
    "derived_by_brief": _by_brief,
    "derived_ids": _ids,
    "entity_keys": lambda s, d: discover.entity_keys(read(s, d, "lineitem")).select(F.array_join("columns", "_").alias("key"), "cardinality"),
    "invariant_scan": _scan,
    "residual_icc": lambda s, d: rounded(discover.residual_icc(read(s, d, "lineitem"), F.col("l_extendedprice") - F.col("l_quantity") * 1000, [["l_suppkey"], ["l_partkey"], ["l_suppkey", "l_linenumber"]]), 6),
    "missingness_groups": lambda s, d: discover.missingness_groups(read(s, d, "lineitem").selectExpr("nullif(l_linenumber, 1) as a", "nullif(l_linenumber, 1) * 2 as b", "nullif(l_returnflag, 'N') as c", "l_tax as e"), ["a", "b", "c", "e"], 2),
    "sampled_scan": lambda s, d: rounded(hash_sample(read(s, d, "orders"), "o_orderkey", 1000).groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("mean"), F.count("*").alias("n")), 4),
}


def _u(parts):
    return " UNION ALL ".join(parts)


def _derived(pairs, both, source, order=True):
    made = []
    for a, b in pairs:
        made.append((f"{a} - {b}", f"CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE)"))
        if both:
            made.append((f"{b} - {a}", f"CAST({b} AS DOUBLE) - CAST({a} AS DOUBLE)"))
        made.append((f"{a} / {b}", f"CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"))
    return made


def _variances(made, source):
    return "WITH s AS (" + source + "), v AS (SELECT " + ", ".join(f"var_samp({e}) AS v{i}" for i, (_, e) in enumerate(made)) + " FROM s), x AS (" + _u([f"SELECT '{t}' AS expr, v{i} AS variance FROM v" for i, (t, _) in enumerate(made)]) + "), t AS (SELECT * FROM x WHERE variance > 0 AND isfinite(variance) ORDER BY variance DESC, expr LIMIT 50)"


_BASE = _variances(_derived(list(combinations(_NUMERIC, 2)), False, ""), "SELECT * FROM lineitem")
_TAGGED = _derived([("l_extendedprice", "l_tax"), ("l_quantity", "secs")], True, "")
for _a, _b in (("l_quantity", "secs"), ("secs", "l_quantity")):
    _TAGGED += [(f"{_a}/86400 - {_b}", f"CAST({_a} AS DOUBLE) / 86400.0::DOUBLE - {_b}"), (f"floor({_a}/86400) - {_b}", f"floor(CAST({_a} AS DOUBLE) / 86400.0::DOUBLE) - {_b}")]

_J = "j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey)"
_E = {"p_retailprice": ("p_retailprice", {"p_retailprice"}), "c_acctbal": ("c_acctbal", {"c_acctbal"}), "p_size": ("CAST(p_size AS DOUBLE)", {"p_size"}), "l_extendedprice / l_quantity": ("CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END", {"l_extendedprice", "l_quantity"}), "l_quantity - l_discount": ("l_quantity - l_discount", {"l_quantity", "l_discount"}), "l_suppkey / l_linenumber": ("CASE WHEN l_linenumber <> 0 THEN CAST(l_suppkey AS DOUBLE) / l_linenumber END", {"l_suppkey", "l_linenumber"})}
_SCAN = f"WITH {_J}, r AS (" + _u([f"SELECT '{'_'.join(k)}' AS \"key\", '{t}' AS expr, quantile_cont(CASE WHEN abs(m) > 0 THEN sd / abs(m) END, 0.5) AS median_cv, count(*) AS n_groups FROM (SELECT avg({e}) AS m, stddev_samp({e}) AS sd FROM j GROUP BY {', '.join(k)} HAVING count({e}) >= 10)" for k in _KEYS for t, (e, refs) in _E.items() if not refs <= set(k)]) + ') SELECT "key", expr, round(median_cv, 6) AS median_cv, n_groups FROM r WHERE median_cv < 0.1'

_ALL = [*_NUMERIC, "l_returnflag", "l_linestatus"]
_CARD = "WITH c AS (" + _u([f"SELECT {i} AS i, '{c}' AS c, count(DISTINCT {c}) AS n, {'1000' if c in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax') else '100000' if c in _NUMERIC else '1000000000'} AS cap FROM lineitem" for i, c in enumerate(_ALL)]) + "), s AS (SELECT * FROM c WHERE n BETWEEN 50 AND 100000 AND n < cap), p AS (" + _u([f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n FROM (SELECT DISTINCT {a}, {b} FROM lineitem)" for a, b in combinations(_ALL, 2)]) + """), f AS (SELECT c AS "key", n AS cardinality, [c] AS l FROM s
 UNION ALL SELECT a || '_' || b, n, [a, b] FROM p WHERE n BETWEEN 500 AND 500000 AND a IN (SELECT c FROM s WHERE n <= 50000) AND b IN (SELECT c FROM s WHERE n <= 50000))
 SELECT "key", cardinality FROM f ORDER BY cardinality DESC, l LIMIT 20"""

_ICC = """SELECT '{key}' AS "key", round(CASE WHEN k >= 2 AND n > k AND msb + (n / k - 1) * msw > 0 THEN (msb - msw) / (msb + (n / k - 1) * msw) ELSE 0 END, 6) AS residual_icc FROM (
 SELECT n, k, (q - n * gm * gm) / nullif(k - 1, 0) AS msb, ssw / nullif(n - k, 0) AS msw FROM (
 SELECT sum(n) AS n, CAST(count(*) AS DOUBLE) AS k, sum(n * m) / sum(n) AS gm, sum(n * m * m) AS q, sum(n * s2) AS ssw FROM (
 SELECT CAST(count(*) AS DOUBLE) AS n, avg(l_extendedprice - l_quantity * 1000) AS m, var_pop(l_extendedprice - l_quantity * 1000) AS s2 FROM lineitem GROUP BY {cols})))"""

def _found_sql():
    columns = [*_FOUND, *_TEXT]
    made = [(t, e, [a, b]) for a, b in combinations(_FOUND, 2) for t, e in ((f"{a} - {b}", f"CAST({a} AS DOUBLE) - {b}"), (f"{a} / {b}", f"CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / {b} END"))]
    made += [(c, f"CAST({c} AS DOUBLE)", [c]) for c in _FOUND]
    cap = {c: "1000000000" if c in _TEXT else "1000" if _FOUND[c] else "100000" for c in columns}
    singles = _u([f"SELECT '{c}' AS c, count(DISTINCT {c}) AS n, {cap[c]} AS cap FROM j" for c in columns])
    both = _u([f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n FROM (SELECT DISTINCT {a}, {b} FROM j)" for a, b in combinations(columns, 2)])
    every = [[c] for c in columns] + [list(p) for p in combinations(columns, 2)]
    kv = ", ".join(f"{{'k': '{'_'.join(k)}', 'l': {k}, 'g': " + " || '|' || ".join(f"{c}::VARCHAR" for c in k) + "}" for k in every)
    sums = ", ".join(f"count(e{i}) AS n{i}, avg(e{i}) AS m{i}, stddev_samp(e{i}) AS s{i}" for i in range(len(made)))
    long = _u([f"SELECT k, l, '{t}' AS expr, {refs} AS refs, CASE WHEN abs(m{i}) > 0 THEN s{i} / abs(m{i}) END AS cv FROM g WHERE n{i} >= 10" for i, (t, _, refs) in enumerate(made)])
    return f"""WITH {_J}, v AS (SELECT {", ".join(f"var_samp({e}) AS v{i}" for i, (_, e, _) in enumerate(made))} FROM j),
      x AS ({_u([f"SELECT '{t}' AS expr, {len(refs)} AS parts, v{i} AS variance FROM v" for i, (t, _, refs) in enumerate(made)])}),
      t AS (SELECT expr FROM (SELECT *, row_number() OVER (PARTITION BY parts ORDER BY variance DESC, expr) AS place FROM x WHERE variance > 0 AND isfinite(variance)) WHERE place <= 50),
      c AS ({singles}), s AS (SELECT * FROM c WHERE n BETWEEN 50 AND 100000 AND n < cap), p AS ({both}),
      f AS (SELECT c AS k, n AS cardinality, [c] AS l FROM s UNION ALL SELECT a || '_' || b, n, [a, b] FROM p
        WHERE n BETWEEN 500 AND 500000 AND a IN (SELECT c FROM s WHERE n <= 50000) AND b IN (SELECT c FROM s WHERE n <= 50000)),
      keys AS (SELECT k FROM f ORDER BY cardinality DESC, l LIMIT 20),
      kv AS (SELECT unnest([{kv}]) AS kv, {", ".join(f"{e} AS e{i}" for i, (_, e, _) in enumerate(made))} FROM j),
      g AS MATERIALIZED (SELECT kv.k AS k, kv.l AS l, kv.g AS g, {sums} FROM kv WHERE kv.k IN (SELECT k FROM keys) GROUP BY ALL), u AS ({long}),
      r AS (SELECT k, expr, quantile_cont(cv, 0.5) AS median_cv, count(*) AS n_groups FROM u WHERE expr IN (SELECT expr FROM t) AND NOT list_has_all(l, refs) GROUP BY 1, 2)
      SELECT k AS "key", expr, round(median_cv, 6) AS median_cv, n_groups FROM r WHERE median_cv < 0.1"""


# three columns in two groups: the two of least distance are one, the first such pair on ties
_GROUPED = """WITH t AS (SELECT l_linenumber = 1 AS a, l_linenumber = 1 AS b, l_returnflag = 'N' AS c FROM lineitem),
 d AS (SELECT (1 - coalesce(corr(a::INT, b::INT), 0)) / 2 AS ab, (1 - coalesce(corr(a::INT, c::INT), 0)) / 2 AS ac, (1 - coalesce(corr(b::INT, c::INT), 0)) / 2 AS bc FROM t),
 w AS (SELECT CASE WHEN ab <= ac AND ab <= bc THEN [0, 0, 1] WHEN ac <= bc THEN [0, 1, 0] ELSE [0, 1, 1] END AS g FROM d)
 SELECT unnest(['a', 'b', 'c']) AS "column", unnest(g)::INT AS missingness_group FROM w"""


SQL = {
    "invariant_scan_found": _found_sql(),
    "derived_variance": _BASE + " SELECT expr, round(ln(variance), 6) AS log_variance FROM t",
    "derived_tagged": _variances(_TAGGED, "SELECT *, epoch(l_shipdate)::BIGINT AS secs FROM lineitem") + " SELECT expr, round(ln(variance), 6) AS log_variance FROM t",
    "missingness_groups": _GROUPED,
    "derived_by_brief": _variances(_TAGGED, "SELECT *, epoch(l_shipdate)::BIGINT AS secs FROM lineitem") + " SELECT expr, round(ln(variance), 6) AS log_variance FROM t",
    "derived_ids": _BASE + " SELECT expr, 'derived_' || substr(sha256(expr), 1, 8) AS id FROM t",
    "entity_keys": _CARD,
    "invariant_scan": _SCAN,
    "residual_icc": _u([_ICC.format(key="_".join(k), cols=", ".join(k)) for k in (["l_suppkey"], ["l_partkey"], ["l_suppkey", "l_linenumber"])]),
    "sampled_scan": "SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '|42'), 1, 8) AS BIGINT) % 10 = 0 GROUP BY 1",
}
