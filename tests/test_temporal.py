"""Folds over time learn from the past only; labels and values are not lost on the way."""

import json

import pytest
from pyspark.sql import functions as F

from featurelab import cli
from featurelab.functions.order import percentiles
from featurelab.operators import graph, model, query, splits


def test_temporal_folds_learn_from_the_past(spark):
    df = splits.temporal_split(spark.range(150).repartition(7), [F.col("id")], 5)
    got = {}
    for r in splits.fold_roles(df).collect():
        got.setdefault((r["fold"], r["role"]), set()).add(r["id"])
    for k in range(5):  # 120 rows before the test part, in 6 chunks of 20
        assert got[k, "train"] == set(range(20 * (k + 1))) and got[k, "validation"] == set(range(20 * (k + 1), 20 * (k + 2)))
    assert {r["id"] for r in query.scope(df).collect()} == set(range(20))


def test_training_with_dates_from_the_command_line(spark, tmp_path, monkeypatch, capsys):
    rows = "\n".join(f"2024-{1 + i // 28 % 12:02d}-{1 + i % 28:02d},{i},{i * 37 % 101},{i % 9 + i / 50}" for i in range(300))
    (tmp_path / "d.csv").write_text(f"day,seq,b,y\n{rows}\n")
    (tmp_path / "c.yaml").write_text(f"data_path: {tmp_path / 'd.csv'}\ntarget: y\nmetric: rmse\ndate_col: day\n")
    monkeypatch.setattr(cli, "session", lambda: spark)
    seen, real = [], model.boost.fit

    def fit(df, features, target, row_id, folds, *a):
        seen.extend(df.filter(folds.trains(k, folds.part())).agg(F.count("*"), F.max("seq")).first() for k in range(folds.n))
        return real(df, features, target, row_id, folds, *a)

    monkeypatch.setattr(model.boost, "fit", fit)
    base = ["--config", str(tmp_path / "c.yaml"), "--ledger", str(tmp_path / "l")]
    assert cli.main([*base, "prepare"]) == 0
    assert cli.main([*base, "train", "--features", "seq", "b", "--trees", "2"]) == 0
    assert [tuple(map(int, x)) for x in seen] == [(40 * k, 40 * k - 1) for k in range(1, 6)]
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert {(r["chunk"], r["count"]) for r in out if r.get("split") == "train"} == {(k, 40) for k in range(1, 7)}


def test_a_label_that_is_not_trained_on_is_an_error(spark):
    df = spark.range(40).selectExpr("id as row_id", "'train' as split", "cast(id % 5 as int) as fold", "cast(id % 3 as double) as x", "if(id = 5, 'rare', if(id % 2 = 0, 'a', 'b')) as y")
    with pytest.raises(ValueError, match="rare"):
        model.cross_validate(df, ["x"], "y", "accuracy", "row_id", 5, 1)


def test_percentiles_are_exact(spark):
    df = spark.range(1000).selectExpr("id % 37 * 1.5 as a", "if(id % 3 = 0, null, cast(id * 7919 % 1009 as double)) as b", "cast(null as double) as c", "if(id = 5, 2.5, null) as d").repartition(5)
    at = [0.0, 0.05, 0.25, 0.5, 0.77, 1.0]
    got = percentiles(df, {c: F.col(c) for c in df.columns}, at)
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, at))).alias(c) for c in df.columns]).first()
    for c in "abd":
        assert got[c] == pytest.approx(list(want[c]), rel=1e-12)
    assert got["c"] == [None] * 6


def test_paths_of_any_length_are_found(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(24)], "src string, dst string").coalesce(1)
    assert [r["path"] for r in graph.simple_paths(chain, "n0", "n24").collect()] == [[f"n{i}" for i in range(25)]]


def test_temporal_split_compares_rows_with_the_ends_of_chunks(spark):
    rows = [(i, None if i % 10 == 0 else i % 7, f"r{i:03}") for i in range(100)]
    df = spark.createDataFrame(rows, "id bigint, t bigint, s string").repartition(5)
    got = {r["id"]: (r["split"], r["chunk"]) for r in splits.temporal_split(df, [F.col("t"), F.col("s")], 3).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert got == {r[0]: ("train", k // 20 + 1) if k < 80 else ("test", None) for k, r in enumerate(order)}
    ties = splits.temporal_split(df, [F.col("t")], 3).select("t", "split", "chunk").distinct()
    assert ties.count() == 8
    assert [r["split"] for r in splits.temporal_split(df.limit(1), [F.col("id")], 3).collect()] == ["test"]
    assert splits.temporal_split(df.limit(0), [F.col("id")], 3).count() == 0
