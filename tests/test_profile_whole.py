"""Extended profile, tags from a brief, residual ICC with labels, set-up, CSV files with line breaks, configuration files."""

import json
import math
from functools import partial

import numpy as np
import pandas as pd
import pytest

from featurelab import cli
from featurelab.functions.text import tagged
from featurelab.operators import discover, model, profile
from featurelab.operators import transforms as tf
from featurelab.operators.guard import label_index
from featurelab.operators.ledger import Ledger
from featurelab.sources import config, tables

ROWS = [(1, 0.0, "x", True, None), (2, -0.0, "y", None, None), (None, 2.5, "x", False, b"\x00"), (4, None, None, None, b"\x00"), (4, 1.5, "", True, b"\xff")]
SCHEMA = "n int, v double, `s.t` string, ok boolean, raw binary"


def test_profile_counts_values_of_all_kinds(spark):
    got = {r["column"]: r for r in profile.profile(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert {c: r["cardinality"] for c, r in got.items()} == {"n": 3, "v": 3, "s.t": 3, "ok": 2, "raw": 2}  # both zeros are one value, "" is one
    assert got["raw"]["missingness_rate"] == 0.4 and got["n"]["mean"] == 2.75 and got["s.t"]["std"] == 0.0
    empty = {r["column"]: r for r in profile.profile(spark.createDataFrame([], SCHEMA)).collect()}
    assert empty["v"]["cardinality"] == 0 and empty["v"]["missingness_rate"] is None


def test_extended_profile_equals_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=300).round(1) + 0.0, "b": rng.integers(0, 4, 300).astype(float), "c": rng.choice(list("uvwxyz"), 300), "d": rng.random(300) < 0.3})
    pdf.loc[:40, "a"] = np.nan
    pdf.loc[:40, "b"] = np.nan
    pdf.loc[250:, "c"] = None
    rows = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in pdf.itertuples(index=False)]
    got = {r["column"]: r for r in profile.extended(spark.createDataFrame(rows, "a double, b double, c string, d boolean")).collect()}
    assert list(got) == list("abcd")
    for c in "ab":
        want = pdf[c].quantile([0.05, 0.25, 0.75, 0.95])
        assert [got[c][p] for p in ("p5", "p25", "p75", "p95")] == pytest.approx(list(want)) and got[c]["skewness"] == pytest.approx(pdf[c].skew())
    assert got["d"]["skewness"] == pytest.approx(pdf["d"].astype(float).skew()) and got["c"]["p5"] is None
    for c in "abcd":
        counts = pdf[c].dropna().astype(str).str.replace("True", "true").str.replace("False", "false").value_counts()
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert list(zip(got[c]["top5_values"], got[c]["top5_counts"], strict=True)) == want
    assert [got[c]["missingness_group"] for c in "abcd"] == [0, 1, 2, None]


def test_extended_profile_of_odd_frames(spark):
    got = {r["column"]: r for r in profile.extended(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got["raw"]["top5_values"] == ["AA==", "/w=="] and got["s.t"]["top5_values"] == ["x", "", "y"] and got["v"]["top5_counts"] == [2, 1, 1]
    empty = profile.extended(spark.createDataFrame([], SCHEMA)).collect()
    assert [(r["column"], r["p5"], r["top5_values"], r["missingness_group"]) for r in empty] == [(c, None, [], None) for c in ("n", "v", "s.t", "ok", "raw")]
    assert profile.extended(spark.createDataFrame([], "a int").select()).collect() == []


def test_tags_come_from_the_lines_that_name_a_column(spark):
    brief = "| `fee_x` | payment |\n| plain | seconds |\nplain is worth many dollars\n|tight| miles |\n`other` how many days"
    got = tagged(spark, brief, ["tight", "plain", "fee_x", "other"])
    assert got == {"temporal": ["plain", "other"], "monetary": ["fee_x"], "count": ["other"], "distance": ["tight"]}
    assert not any(tagged(spark, "", ["a"]).values())


def _labelled(spark, labels):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        k = int(rng.integers(0, 8))
        y = labels[(k + int(rng.random() < 0.3)) % len(labels)]
        rows.append((i, None if k == 0 else k, float(rng.normal()) if i % 7 else None, None if i == 5 else y))
    return spark.createDataFrame(rows, "id int, k int, x double, y string")


@pytest.mark.parametrize("labels", [["no", "yes"], ["a", "b", "c"]])
def test_residuals_of_labels_keep_the_entity_keys(spark, labels):
    df = _labelled(spark, labels)
    left = model.entity_residuals(df.select("id", "k", "x", "y"), "y", "auc", trees=3)
    assert left.columns == ["id", "k", "x", "y", "residual"] and left.count() == 399
    rows = left.toPandas()
    if len(labels) == 2:
        assert ((rows["residual"] > 0) == (rows["y"] == "yes")).all() and rows["residual"].abs().max() < 1
    else:
        assert rows["residual"].between(0, 1, inclusive="neither").all()
    assert rows["k"].isna().sum() and rows["x"].isna().sum()  # the columns themselves are not filled
    g = rows.assign(g=rows["k"].map(lambda v: "-999" if pd.isna(v) else str(int(v)))).groupby("g")["residual"]
    n, groups = len(rows), g.ngroups
    between = sum(len(v) * (v.mean() - rows["residual"].mean()) ** 2 for _, v in g) / (groups - 1)
    within = sum(((v - v.mean()) ** 2).sum() for _, v in g) / (n - groups)
    want = (between - within) / (between + (n / groups - 1) * within)
    got = discover.residual_icc(left, left["residual"], [["k"]]).first()
    assert got["residual_icc"] == pytest.approx(want, abs=1e-9)


def test_binary_residual_is_label_less_probability(spark):
    """One tree of one split on a column that tells the labels: its leaf values follow from the formula of the margin."""
    df = spark.createDataFrame([(float(i % 2), "yes" if i % 2 else "no") for i in range(200)], "x double, y string")
    rows = model.entity_residuals(df, "y", "logloss", trees=1).toPandas()
    p = 1 / (1 + math.exp(-0.05 * (100 * 0.5) / (100 * 0.25 + 1)))  # rate * gradient / (Hessian + 1), from a margin of 0
    assert rows.loc[rows["y"] == "yes", "residual"].unique() == pytest.approx([1 - p]) and rows.loc[rows["y"] == "no", "residual"].unique() == pytest.approx([-(1 - p)])


def test_codes_are_places_in_sorted_order(spark):
    got = {r["value"]: r["code"] for r in label_index(spark.createDataFrame([(x,) for x in ("b", "a", None, "c", "a", "Z")], "v string"), "v").collect()}
    assert got == {"Z": 0, "a": 1, "b": 2, "c": 3}


def test_too_many_categories_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(tf, "MOST_COLUMNS", 2)
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    assert [t.name for t in tf.onehot_all(df, "c")] == ["c_is_a", "c_is_b"]
    with pytest.raises(ValueError, match="more than 2"):
        tf.onehot_all(df.union(spark.createDataFrame([("z",)], "c string")), "c")


@pytest.mark.parametrize(("text", "want"), [
    ("a,b\n1,x\n2,y\n", [(1, "x"), (2, "y")]),
    ('a,b\n1,"x\ny"\n2,z\n', [(1, "x\ny"), (2, "z")]),
    ('a,b\n1,"say ""x"", y"\nNA,z\n', [(1, 'say "x", y'), (None, "z")]),
])
def test_csv_with_and_without_line_breaks(spark, tmp_path, text, want):
    (tmp_path / "d.csv").write_text(text)
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "d.csv")).collect()), key=str) == sorted(want, key=str)


def test_a_large_plain_csv_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,b\n" + "1,x\n" * 200_000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        df = tables.read_csv(spark, str(tmp_path / "d.csv"))
        assert df.rdd.getNumPartitions() > 1 and df.count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_configuration_goes_there_and_back(tmp_path):
    values = {"data_path": "a #1: b.csv", "target": "it's", "metric": "f1", "date_col": None, "exclude_columns": ["x", "y # z"], "n_folds": 3, "min_delta": 0.01}
    (tmp_path / "c.yaml").write_text(config.dump(values))
    c = config.load(str(tmp_path / "c.yaml"))
    assert (c.data_path, c.target, c.metric, c.date_col, c.exclude_columns, c.n_folds, c.min_delta) == ("a #1: b.csv", "it's", "f1", None, ("x", "y # z"), 3, 0.01)
    (tmp_path / "d.yaml").write_text('# head\ndata_path: "p #2" # said\ntarget: y # what\nmetric: auc\n')
    c = config.load(str(tmp_path / "d.yaml"))
    assert (c.data_path, c.target, c.metric) == ("p #2", "y", "auc")


def test_setup_then_discover_with_tags_and_labels(spark, tmp_path, monkeypatch, capsys):
    rng = np.random.default_rng(5)
    lines = [f"{i % 60},{i % 60 * 7 + 3},{rng.random():.4f},{'yes' if rng.random() < 0.4 + 0.01 * (i % 60) / 2 else 'no'}" for i in range(1500)]
    (tmp_path / "d.csv").write_text("shop,price,fee,y\n" + "\n".join(lines) + "\n")
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setattr(cli.model, "entity_residuals", partial(model.entity_residuals, trees=2))
    base = ["--config", str(tmp_path / "c.yaml"), "--ledger", str(tmp_path / "l")]
    monkeypatch.setattr("builtins.input", lambda _: "3")
    assert cli.main([*base, "setup", str(tmp_path / "d.csv")]) == 0
    c = config.load(str(tmp_path / "c.yaml"))
    assert (c.target, c.metric, c.n_folds) == ("y", "auc", 5)
    brief = tmp_path / "program.md"
    assert "| `price` |" in brief.read_text()
    brief.write_text("| `price` | price in usd |\n| `fee` | fee in usd |\n")
    assert cli.main([*base, "setup", str(tmp_path / "d.csv"), "--target", "y", "--metric", "f1"]) == 0
    assert "usd" in brief.read_text() and config.load(str(tmp_path / "c.yaml")).metric == "f1"  # a brief stays
    capsys.readouterr()
    assert cli.main([*base, "discover"]) == 0
    out = capsys.readouterr().out
    assert "monetary: price, fee" in out
    shown = [json.loads(x) for x in out.splitlines() if x.startswith("{")]
    assert {"shop"} <= {x["key"] for x in shown if "residual_icc" in x} and any(x.get("expr") == "price" for x in shown)
    L = Ledger(spark, str(tmp_path / "l"))
    assert {r["expr"] for r in L.last_run("derived_column").collect()} >= {"price - fee", "fee - price", "price / fee"}
    assert all(r["residual_icc"] is not None for r in L.last_run("entity_key").collect())
    assert cli.main([*base, "inspect", "profile"]) == 0
    rows = {x["column"]: x for x in (json.loads(y) for y in capsys.readouterr().out.splitlines() if y.startswith("{"))}
    assert set(rows) == {"shop", "price", "fee"} and len(rows["shop"]["top5_values"]) == 5 and rows["price"]["p25"] < rows["price"]["p75"]
    with pytest.raises(ValueError, match="not in the data"):
        cli.main([*base, "setup", str(tmp_path / "d.csv"), "--target", "none"])
