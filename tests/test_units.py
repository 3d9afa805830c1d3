import datetime
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelab.functions import expr, metrics, stats, text
from featurelab.operators import discover, graph, guard, ledger, model, query, reports, splits
from featurelab.operators import transforms as tf
from featurelab.sources import config, tables


def test_expressions_refuse_everything_else(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, `b c` double")
    for bad in ("__import__('os')", "a.real", "exp(a)", "a if a else a", "[a]", "a; a", "lambda: a", "zzz + 1", "'x'"):
        with pytest.raises(expr.ExpressionError):
            expr.compile_expression(bad, df)
    c = expr.compile_expression("a / `b c` + log(`b c`)", df)
    assert c.references == {"a", "b c"} and df.select(c.column).first()[0] is None


@pytest.mark.parametrize("text_, want", [("7 % -3", -2.0), ("-7 // 2", -4.0), ("2 ** 3", 8.0), ("sqrt(-1)", None), ("log1p(-1)", None), ("(1 < 2) & (2 > 3)", 0.0), ("~(1 > 2)", 1.0)])
def test_expression_values(spark, text_, want):
    df = spark.range(1)
    assert df.select(expr.compile_expression(text_, df).column).first()[0] == want


def test_leakage(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, y double")
    expr.check_leakage("y", ["a"], expr.compile_expression("a + 1", df))
    for names, e in ((["y"], "a"), ([], "a + y")):
        with pytest.raises(ValueError):
            expr.check_leakage("y", names, expr.compile_expression(e, df))


def test_constants_are_undefined_not_errors(spark):
    df = spark.createDataFrame([(1.0, float(i), None) for i in range(12)], "k double, v double, n double")
    row = stats.correlation(df, "k", "v").first()
    assert row["pearson"] is None and row["spearman"] is None and row["n_complete"] == 12
    assert stats.variation(df, F.col("k") * 0, ["k"]).first()["n_groups"] == 1
    assert df.agg(stats.skewness(F.col("k"))).first()[0] == 0.0 and df.agg(stats.skewness(F.col("n"))).first()[0] is None
    assert stats.icc(df, F.col("v"), ["k"]).first()["icc"] == 0.0


def test_groups_below_ten_and_null_keys_do_not_count(spark):
    df = spark.createDataFrame([("a", 1.0)] * 9 + [("b", 2.0)] * 10 + [(None, 3.0)] * 20, "k string, v double")
    assert [r["k"] for r in stats.group_stats(df, F.col("v"), ["k"]).collect()] == ["b"]


def test_null_key_is_a_group_for_icc(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.1), (None, 5.0), (None, 5.1)], "k string, v double")
    assert stats.icc(df, F.col("v"), ["k"]).first()["icc"] > 0.9


@pytest.mark.parametrize("description, family_, text_, columns", [("col=a_b, c;op=log_ratio;reason=x", "log", "a b, c → log ratio", ["a_b", "c"]), ("reason=why_not", "other", "why not", []), ("combine geological", "binning", "combine geological", []), ("col=a; op=drop", "feature_drop", "a → drop", ["a"])])
def test_descriptions(spark, description, family_, text_, columns):
    d = spark.createDataFrame([(description,)], "d string")
    assert tuple(d.select(text.family(F.col("d")), text.readable(F.col("d")), text.named_columns(F.col("d"))).first()) == (family_, text_, columns)


def test_stratified_split_is_balanced_and_complete(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(103)], "id bigint, s string")
    rows = splits.stratified_split(df, "id", "s").collect()
    assert len({r["id"] for r in rows}) == 103 and all((r["split"] == "test") == (r["fold"] is None) for r in rows)
    for s in "abc":
        folds = [sum(r["s"] == s and r["fold"] == k for r in rows) for k in range(5)]
        assert max(folds) - min(folds) <= 1


def test_temporal_split_goes_forward(spark):
    df = spark.createDataFrame([(i, (i * 7) % 100) for i in range(100)], "id bigint, t bigint")
    rows = splits.temporal_split(df, [F.col("t"), F.col("id")]).collect()
    assert min(r["t"] for r in rows if r["split"] == "test") == 80
    chunks = [[r["t"] for r in rows if r["chunk"] == k] for k in range(1, 7)]
    assert all(len(c) == 13 for c in chunks) and all(max(a) < min(b) for a, b in itertools.pairwise(chunks))


def test_out_of_fold_encoding_ignores_own_label(spark):
    base = [(1, "x", 0, 1.0), (2, "x", 1, 3.0), (3, "x", 0, 5.0), (4, "lonely", 1, 7.0)]
    df = lambda y: spark.createDataFrame([(i, c, f, y if i == 1 else v) for i, c, f, v in base], "id int, c string, fold int, y double")
    a, b = ({r["id"]: r["v"] for r in tf.target_encoding_oof(df(y), "c", "y", "fold", "v").collect()} for y in (1.0, 100.0))
    assert a[1] == b[1] == 3.0 and a[2] == 3.0 and a[4] == 4.0 and b[4] != 4.0


def test_guard(spark):
    train = spark.createDataFrame([(1, "b", 1.0), (2, "a", float("inf")), (3, None, 3.0), (4, "b", None)], "id int, c string, v double")
    new = spark.createDataFrame([(5, "a", None), (6, "zzz", 9.0), (7, None, float("nan"))], "id int, c string, v double")
    g = guard.Guard(["c", "v"], "id").fit(train)
    got = {r["id"]: (r["c"], r["v"]) for r in g.transform(new).collect()}
    assert got == {5: (1.0, 2.0), 6: (-1.0, 9.0), 7: (0.0, 2.0)}
    own = guard.Guard(["c", "v"], "id", "self").fit(train).transform(new)
    assert {r["id"]: r["v"] for r in own.collect()} == {5: 9.0, 6: 9.0, 7: 9.0}


def test_transforms_check_their_inputs(spark):
    df = spark.range(3).withColumn("v", F.col("id") * 1.0)
    with pytest.raises(ValueError):
        tf.log("w").apply(df, df)
    assert tf.lineage([tf.product("a", "b", "p")]) == [("p", "a"), ("p", "b")]
    assert [r[0] for r in tf.zscore("v", "z").apply(df, df).select("z").collect()] == [-1.0, 0.0, 1.0]


def test_discovery_finds_what_is_constant_within_an_entity(spark):
    rows = [(e, float(86400 * (e * 10 + k)), float(k)) for e in range(20) for k in range(12)] + [(99, 1.0, 5.0)] * 9
    df = spark.createDataFrame(rows, "e int, secs double, day double")
    c = expr.compile_expression("secs / 86400 - day", df)
    got = discover.invariants(df.filter("e > 0"), [["e"]], {"first day": c.column, "day": F.col("day"), "e": F.col("e") * 1.0}, {"e": {"e"}}).collect()
    assert [(r["expr"], r["n_groups"]) for r in got] == [("first day", 19)]


def test_cluster_linkage():
    d = {("a", "b"): 0.1, ("a", "c"): 0.9, ("b", "c"): 0.8}
    assert discover.clusters(["a", "b", "c"], d, 2) == {"a": 0, "b": 0, "c": 1}
    assert discover.entity_id(["b", "a"]) == discover.entity_id(["a", "b"])


def test_keep_rule_and_ledger(spark, tmp_path):
    got = ledger.replay(spark.createDataFrame([(1, 1.0), (2, 0.5), (3, 1.0005), (4, 2.0)], "exp_id bigint, score double"), 0.001).collect()
    assert [r["kept"] for r in got] == [True, False, False, True] and math.isclose(got[2]["delta"], 0.0005)
    L = ledger.Ledger(spark, str(tmp_path))
    now = datetime.datetime(2024, 1, 1)
    assert L.record(0.7, 0.1, ["a"], "col=a;op=log", True, 0.001, now)["kept"]
    second = L.record(0.5, 0.1, ["a", "b"], "col=b;op=bin", True, 0.001, now)
    assert second["exp_id"] == 2 and not second["kept"]
    assert L.register_type("MINE", "Feature", ["Feature"]) and not L.register_type("USED_IN", "x", [])
    h = L.add_hypothesis("it helps", now)
    L.resolve(h, 2, False, -0.2)
    out = ledger.resolved(L.table("hypothesis"), L.table("resolution")).first()
    assert out["rel"] == "CONTRADICTS"


def test_later_edges_win_and_attributes_merge(spark):
    e = spark.createDataFrame([("a", "b", "X", 1, 0.5, None), ("a", "b", "Y", 2, None, 3)], "src string, dst string, rel string, seq int, delta double, overlap bigint")
    assert tuple(ledger.collapsed(e).first()) == ("a", "b", "Y", 0.5, 3)


def test_session_gap_of_exactly_an_hour_belongs_together(spark):
    at = lambda m, s=0: datetime.datetime(2024, 1, 1, m // 60, m % 60, s)
    df = spark.createDataFrame([(1, at(0)), (1, at(60)), (1, at(120, 1)), (2, at(0))], "u int, ts timestamp")
    assert sorted((r["u"], r["n"]) for r in reports.sessions(df, "u", "ts").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_traversals(spark):
    path = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    star = spark.createDataFrame([("x", "m"), ("y", "m"), ("m", "p"), ("m", "q")], "src string, dst string")
    assert graph.longest_path(path) == graph.longest_path(path, 1) == 3
    c = {r["node"]: r["centrality"] for r in graph.betweenness(path).collect()}
    assert c == {"a": 0.0, "b": pytest.approx(2 / 6), "c": pytest.approx(2 / 6), "d": 0.0}
    assert {r["node"]: r["centrality"] for r in graph.betweenness(star).collect()}["m"] == pytest.approx(4 / 12)
    cycle = path.unionByName(spark.createDataFrame([("d", "a")], "src string, dst string"))
    for small in (1, 100):
        with pytest.raises(ValueError):
            graph.longest_path(cycle, small)
    got = graph.closure(cycle, spark.createDataFrame([("a",)], "node string")).collect()
    assert {(r["node"], r["depth"]) for r in got} == {("b", 1), ("c", 2), ("d", 3)}
    both = path.unionByName(spark.createDataFrame([("a", "d")], "src string, dst string"))
    assert [r["path"] for r in graph.simple_paths(both, "a", "d").collect()] == [["a", "d"], ["a", "b", "c", "d"]]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert metrics.auc(df, "y", "p").first()[0] == pytest.approx(0.875)
    assert metrics.auc(df.filter("y = 1"), "y", "p").first()[0] is None
    assert df.agg(metrics.logloss(F.lit(0.0))).first()[0] == pytest.approx(-math.log(1e-15))
    three = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    assert metrics.f1(three, "y", "p").first()[0] == pytest.approx((2 / 3 * 2 + 0.5) / 4)


def test_shap_adds_up_and_equals_the_definition():
    tree = [(1.0, [(0, -np.inf, 0.5, 0.6), (1, -np.inf, 2.0, 0.25)]), (5.0, [(0, -np.inf, 0.5, 0.6), (1, 2.0, np.inf, 0.75)]), (-2.0, [(0, 0.5, np.inf, 0.4), (0, 0.8, np.inf, 0.5)]), (3.0, [(0, 0.5, np.inf, 0.4), (0, -np.inf, 0.8, 0.5)])]
    x = np.array([[0.1, 1.0], [0.7, 9.0], [0.9, 0.0]])
    got, base = model.tree_shap([tree], x)
    margin = np.array([next(v for v, p in tree if all(lo < r[f] <= hi for f, lo, hi, _ in p)) for r in x])
    assert np.allclose(got.sum(axis=1) + base, margin)

    def worth(row, known):
        return sum(v * np.prod([(float(lo < row[f] <= hi) if f in known else s) for f, lo, hi, s in p]) for v, p in tree)

    for r, g in zip(x, got, strict=True):
        for i, other in ((0, 1), (1, 0)):
            want = 0.5 * (worth(r, {i}) - worth(r, set())) + 0.5 * (worth(r, {0, 1}) - worth(r, {other}))
            assert g[i] == pytest.approx(want)


def test_model_and_attribution(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), float(3 * a + (b > 0)), "abc"[int(a * 3) % 3]) for i, (a, b) in enumerate(zip(rng.random(240), rng.normal(size=240), strict=True))]
    df = splits.stratified_split(spark.createDataFrame(rows, "id int, a double, b double, y double, k string").withColumn("s", F.lit("x")), "id", "s", 2)
    r = model.cross_validate(df, ["a", "b"], "y", "rmse", "id", 2, 5, shap=True)
    assert len(r["scores"]) == 2 and r["shap"]["a"] > r["shap"]["b"] > 0
    c = model.cross_validate(df, ["a", "b"], "k", "accuracy", "id", 2, 3)
    assert c["cv_score"] > 0.8


def test_csv_types_and_missing_tokens(spark, tmp_path):
    (tmp_path / "x.csv").write_text('i,f,b,t,e,g\n1,1.5,True,x,,1\n2,NA,False,nan,,NA\n,inf,,"a,b",null,3\n')
    df = tables.read(spark, str(tmp_path / "x.csv"), ["g"])
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "t": "string", "e": "double"}
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, True, "x", None), (2, None, False, None, None), (None, None, None, "a,b", None)]
    with pytest.raises(ValueError):
        tables.validate(df, "nope")
    assert tables.validate(df, "i", None, ["zz"]) and tables.suggested_metric(df, "b") == "auc"
    assert tables.signature(df, {"a": 1}) == tables.signature(df, {"a": 1}) != tables.signature(df, {"a": 2})


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("data_path: x.csv\ntarget: y # the label\nmetric: auc\nexclude_columns:\n  - a\n  - b\ncategorical_columns: [c, d]\nn_folds: 3\n")
    c = config.load(str(tmp_path / "c.yaml"))
    assert (c.target, c.exclude_columns, c.categorical_columns, c.n_folds, c.higher_is_better) == ("y", ("a", "b"), ("c", "d"), 3, True)
    for bad in ({"metric": "nope"}, {"n_folds": 1}):
        with pytest.raises(ValueError):
            config.from_mapping({"data_path": "x", "target": "y", **bad})


def test_graph_file_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "Column"), ("b", "Feature")], "id string, node_type string")
    edges = spark.createDataFrame([("b", "a", "DERIVED_FROM")], "source string, target string, rel string")
    tables.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = tables.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 2 and e.first()["rel"] == "DERIVED_FROM"


def test_results_log(spark, tmp_path):
    row = ("abc", "t", 1, "keep", "rmse", 0.123456, 0.1, 0.0, 3, 0.12, 1.5, "text")
    df = spark.createDataFrame([row], "commit string, timestamp string, experiment_id int, status string, metric string, cv_score double, cv_std double, delta double, n_features int, composite_score double, run_time double, description string")
    tables.append_results(df, str(tmp_path / "r"))
    tables.append_results(df, str(tmp_path / "r"))
    got = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "r"))
    assert got.count() == 2 and got.first()["cv_score"] == "0.1235"


def test_run_query(spark, tmp_path, sf):
    df = splits.stratified_split(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey", "o_orderpriority")
    L = ledger.Ledger(spark, str(tmp_path))
    assert query.run_query(df, "correlation", "o_totalprice", L, col_a="o_custkey", col_b="o_orderkey").first()["n_complete"] > 0
    assert "error" in query.run_query(df, "nope", "o_totalprice", L).columns
    assert "error" in query.run_query(df, "cardinality", "o_totalprice", L, cols=["zz"]).columns
    with pytest.raises(ValueError):
        query.run_query(df, "cardinality", "o_totalprice", L, cols=["o_totalprice"])
    assert L.table("query_log").count() == 3
    for kind, kw in (("cardinality", {"cols": ["o_custkey", "o_orderstatus"]}), ("conditional_distribution", {"col": "o_orderstatus", "groupby": "o_orderpriority"}), ("within_group_variance", {"expr": "o_orderkey / o_custkey", "groupby": "o_orderstatus"})):
        assert query.run_query(df, kind, "o_totalprice", None, **kw).count()
    L.append("query_log", [(datetime.datetime.now(), "x")] * 20)
    with pytest.raises(query.QueryLimit):
        query.run_query(df, "cardinality", "o_totalprice", L, cols=["o_custkey"])
