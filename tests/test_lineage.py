"""Inputs of columns from the analysed plan, and feature files that leak."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featurelab import cli
from featurelab.operators import lineage
from featurelab.operators.ledger import Ledger


@pytest.fixture()
def tables(spark, tmp_path):
    spark.range(20).selectExpr("id as k", "id * 2.0D as a", "id % 3 as b", "cast(id as string) as s", "array(id, id + 1) as xs", "id % 5 as y").write.parquet(str(tmp_path / "one"))
    spark.range(5).selectExpr("id as b2", "id * 3 as w").write.parquet(str(tmp_path / "two"))
    return spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "two"))


def test_inputs_follow_aliases_and_nesting(spark, tables):
    one, two = tables
    one.createOrReplaceTempView("one")
    df = one.select("k", (F.col("a") + 1).alias("a"), "b", "s").select("k", (F.col("a") * F.col("b")).alias("b"), F.col("a").alias("c"), "s").withColumn("d", F.col("b") - F.col("c") * 0 + F.length("s"))
    assert lineage.inputs(df) == {"k": ["k"], "b": ["a", "b"], "c": ["a"], "s": ["s"], "d": ["a", "b", "s"]}
    joined = one.join(two, one["b"] == two["b2"], "left").withColumn("m", F.avg("w").over(Window.partitionBy("s").orderBy("a")))
    assert lineage.inputs(joined, ["m", "w", "a"]) == {"m": ["a", "s", "w"], "w": ["w"], "a": ["a"]}
    per = one.groupBy("b").agg(F.max(F.col("a") + F.col("k")).alias("top"))
    assert lineage.inputs(one.join(per, "b"), ["top"]) == {"top": ["a", "k"]}
    assert lineage.inputs(one.select("k", F.explode("xs").alias("x")).withColumn("z", F.col("x") + 1), ["z"]) == {"z": ["xs"]}
    both = one.select("a").unionByName(one.select(F.col("b").cast("double").alias("a")))
    assert lineage.inputs(both) == {"a": ["a", "b"]}
    assert lineage.inputs(spark.sql("select q + 1 as r from (select a * 2 as q, s from one where b > 1) t")) == {"r": ["a"]}


def test_python_functions_depend_on_what_they_get(tables):
    one, _ = tables
    out = one.select("a", "b").mapInPandas(lambda it: it, "a double, n bigint")
    assert lineage.inputs(out, ["n"]) == {"n": ["a", "b"]}


def test_undeclared_inputs_are_an_error(tables):
    df = tables[0].withColumn("f", F.col("a") / F.col("b"))
    lineage.check(df, {"f": ["a", "b"]})
    with pytest.raises(ValueError, match=r"\{'f': \['b'\]\}"):
        lineage.check(df, {"f": ["a"]})


def test_a_feature_file(spark, tmp_path, monkeypatch, capsys):
    rows = "\n".join(f"{i % 60},{i * 37 % 101},{(i % 60) * 2 + (i * 37 % 101) / 50}" for i in range(300))
    (tmp_path / "d.csv").write_text(f"a,b,y\n{rows}\n")
    (tmp_path / "c.yaml").write_text(f"data_path: {tmp_path / 'd.csv'}\ntarget: y\nmetric: rmse\n")
    monkeypatch.setattr(cli, "session", lambda: spark)
    base = ["--config", str(tmp_path / "c.yaml"), "--ledger", str(tmp_path / "l")]
    cli.main([*base, "prepare"])
    made = "import pyspark.sql.functions as F\n\n\ndef engineer_features(df):\n    return df.withColumn('t', F.col('a') + 1).withColumn('u', F.col('t') * F.col({}))\n"
    (tmp_path / "good.py").write_text(made.format("'b'"))
    cli.main([*base, "train", "--features", "a", "--module", str(tmp_path / "good.py"), "--trees", "2"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["kept"]
    assert {tuple(r) for r in Ledger(spark, str(tmp_path / "l")).table("derived_from").collect()} == {("a", "a"), ("t", "a"), ("u", "a"), ("u", "b")}
    (tmp_path / "leak.py").write_text(made.format("'y'"))
    with pytest.raises(ValueError, match="read the target"):
        cli.main([*base, "train", "--features", "a", "--module", str(tmp_path / "leak.py"), "--trees", "2"])
    (tmp_path / "drop.py").write_text("def engineer_features(df):\n    return df.limit(3)\n")
    with pytest.raises(ValueError, match="add nor drop"):
        cli.main([*base, "train", "--features", "a", "--module", str(tmp_path / "drop.py"), "--trees", "2"])
