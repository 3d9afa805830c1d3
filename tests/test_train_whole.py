"""Training from the command line with fitted features, typed edges, file signatures, directions; sums over pairs and groups."""

import datetime
import json
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelab import cli
from featurelab.functions import gram, grouped, order
from featurelab.operators import discover
from featurelab.operators.ledger import Ledger
from featurelab.sources import tables

NOW = datetime.datetime(2026, 1, 1)


@pytest.fixture()
def run(spark, tmp_path, monkeypatch, capsys):
    rows = "\n".join(f"c{i % 17},{i * 37 % 101},{i * 37 % 101 * 2 + i % 3},{(i % 17) * 3 + (i * 37 % 101) / 50}" for i in range(400))
    (tmp_path / "d.csv").write_text(f"city,b,b2,y\n{rows}\n")
    (tmp_path / "c.yaml").write_text(f"data_path: {tmp_path / 'd.csv'}\ntarget: y\nmetric: rmse\n")
    monkeypatch.setattr(cli, "session", lambda: spark)

    def call(*args):
        assert cli.main(["--config", str(tmp_path / "c.yaml"), "--ledger", str(tmp_path / "l"), *args]) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    call.ledger, call.folder = Ledger(spark, str(tmp_path / "l")), tmp_path
    return call


def test_training_writes_features_and_edges(run):
    run("prepare")
    one = run("train", "--features", "b", "b2", "--trees", "2")[-1]
    two = run("train", "--features", "b", "b2", "target:city", "--trees", "12", "--description", "op=target;col=city")[-1]
    assert one["kept"] and two["kept"] and two["composite_score"] < one["composite_score"]  # a smaller error is better
    edges = {(r["src"], r["dst"], r["rel"]) for r in run.ledger.table("edge").collect()}
    assert {("feat_b", "feat_b2", "CORRELATED_WITH"), ("exp_2", "exp_1", "OUTPERFORMS")} == edges
    assert {r["seq"] for r in run.ledger.table("edge").collect()} == {1, 2, 3}
    assert [(r["src"], r["dst"], r["overlap"]) for r in run("inspect", "outperforms")] == [(2, 1, 2)]
    assert run("inspect", "correlations")[0]["correlation"] > 0.99
    assert ("target:city", "city") in {tuple(r) for r in run.ledger.table("derived_from").collect()}
    assert "target:city" in {r["feature"] for r in run("inspect", "shap")}
    with pytest.raises(ValueError, match="read the target"):
        run("train", "--features", "zscore:y")


def test_files_that_changed_in_place_begin_a_new_ledger(run, spark):
    run("prepare")
    run.ledger.append("query_log", [(NOW, "x")])
    run("prepare")
    assert run.ledger.table("query_log").count() == 1
    path = run.folder / "d.csv"
    path.write_text(path.read_text().replace("c3,", "c4,"))
    os.utime(path, (2e9, 2e9))
    run("prepare")
    assert run.ledger.table("query_log").count() == 0
    assert [(n.rsplit("/", 1)[1], size) for n, size, _ in tables.files(spark, str(path))] == [("d.csv", path.stat().st_size)]


def test_folds_do_not_depend_on_the_order_of_rows(run, spark):
    from featurelab.sources import config

    c = config.load(str(run.folder / "c.yaml"))
    seen = []
    for _ in range(2):
        seen.append(sorted((r["city"], r["b"], r["b2"], r["y"], r["split"], str(r["fold"])) for r in cli.prepared(spark, c).collect()))
        head, *lines = (run.folder / "d.csv").read_text().splitlines()
        (run.folder / "d.csv").write_text("\n".join([head, *reversed(lines)]) + "\n")
    assert seen[0] == seen[1]


def test_edges_need_nodes_and_get_numbers_of_their_own(spark, tmp_path):
    L = Ledger(spark, str(tmp_path / "l"))
    L.append("used_in", [(1, "a"), (1, "b")])
    edge = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string, correlation double")
    with pytest.raises(ValueError, match="feat_nope"):
        L.add_edges("NEW", edge(("feat_a", "feat_nope", 1.0)))
    with pytest.raises(ValueError, match="two nodes"):
        L.add_edges("NEW", edge(("feat_a", None, 1.0)))
    assert L.add_edges("NEW", edge(("feat_a", "feat_b", 0.9), ("feat_b", "feat_a", 0.9))) == 2 and L.add_edges("NEW", edge()) == 0
    kinds = {r["rel_type"]: (r["source_type"], list(r["target_type"]), r["category"]) for r in L.types().collect()}
    assert kinds["NEW"] == ("Feature", ["Feature"], "auto")
    got, threads = [], [threading.Thread(target=lambda: got.extend(Ledger(spark, L.path).next_seq() for _ in range(5))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(set(got)) == 20 and min(got) == 2


def test_pairs_equal_numpy_and_ignore_rounding(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 5)) * [1, 1e-3, 1e6, 1, 1] + [0, 1e3, 1e9, 0, 0]
    x[:, 4] = 0.1
    hole = rng.random(x.shape) < 0.2
    df = spark.createDataFrame([tuple(None if h else float(v) for v, h in zip(r, hs, strict=True)) for r, hs in zip(x, hole, strict=True)], "a double, b double, c double, d double, e double").repartition(7)
    got = {(r["col_a"], r["col_b"]): (r["n"], r["r"]) for r in gram.pairs(df, {c: F.col(c) for c in df.columns}).collect()}
    assert len(got) == 10
    for (a, b), (n, r) in got.items():
        i, j = "abcde".index(a), "abcde".index(b)
        both = ~hole[:, i] & ~hole[:, j]
        assert n == both.sum() and (r is None if "e" in (a, b) else r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9))
    alone = {r["name"]: r for r in gram.moments(df, {c: F.col(c) for c in df.columns}).collect()}
    for i, c in enumerate("abcd"):
        assert alone[c]["variance"] == pytest.approx(x[~hole[:, i], i].var(ddof=1), rel=1e-9)
    assert alone["e"]["variance"] == 0


def test_many_columns_are_one_scan(spark, tmp_path):
    spark.range(50).select(*[(F.col("id") * k % 17).alias(f"c{k}") for k in range(200)]).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    plan = gram.pairs(df, {c: F.col(c) for c in df.columns})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert gram.pairs(df, {c: F.col(c) for c in df.columns}).count() == 199 * 100


@pytest.mark.parametrize("chunk", [1, 1 << 26])
def test_deviations_within_groups(spark, monkeypatch, chunk):
    monkeypatch.setattr(grouped, "CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        df = spark.range(3000).selectExpr("if(id % 3 = 0, 1, id % 40) as k", "if(id % 50 = 0, null, cast(id % 7 as string)) as s", "if(id % 11 = 0, null, cast(id % 13 as double)) as x", "1e9 + id % 2 as y", "0.0D as z").repartition(5).persist()
        keys, exprs = [["k"], ["k", "s"], ["s"]], ["x", "y", "z", "k"]
        got = {}
        for r in grouped.deviations(df, keys, [F.col(e) for e in exprs], {(0, 3)}, 10).collect():
            got.setdefault((r["key"], exprs[r["expr"]]), []).append(r["cv"])
        for i, key in enumerate(keys):
            for e in exprs:
                want = [r["cv"] for r in df.dropna(subset=key).groupBy(*key).agg((F.stddev_samp(e) / F.nullif(F.abs(F.avg(e)), F.lit(0.0))).alias("cv"), F.count(e).alias("n")).filter("n >= 10").collect()]
                none = lambda v: (v is None, v or 0.0)
                assert ((i, e) == (0, "k") and (i, e) not in got) or [v if v is None else pytest.approx(v, abs=1e-12) for v in sorted(want, key=none)] == sorted(got[i, e], key=none)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_group_percentiles_over_range_borders(spark):
    df = spark.range(4000).selectExpr("if(id % 4 < 3, 'hot', concat('g', id % 9)) as g", "if(id % 5 = 0, null, cast(id * 7919 % 4001 as double)) as v").repartition(6)
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: (r["n"], list(r["q"])) for r in order.group_percentiles(df, ["g"], F.col("v"), at).collect()}
    want = {r["g"]: (r["n"], list(r["q"])) for r in df.groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, at))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(got[g][0] == want[g][0] and got[g][1] == pytest.approx(want[g][1], rel=1e-12) for g in want)
    one = order.group_percentiles(df, [], F.col("v"), [0.5]).collect()
    assert [r["q"][0] for r in one] == [df.agg(F.percentile("v", F.lit(0.5))).first()[0]] and order.group_percentiles(df.limit(0), ["g"], F.col("v"), at).count() == 0


def test_no_expression_of_keys_alone(spark):
    df = spark.range(100).selectExpr("id % 5 as k", "id % 5 * 2.0D as x")
    assert discover.invariants(df, [["k"]], {"x": F.col("x")}, {"x": {"k"}}).columns == ["key", "expr", "median_cv", "n_groups"]
    assert [r["key"] for r in discover.invariants(df, [["k"]], {"x": F.col("x")}, {"x": {"x"}}).collect()] == ["k"]
