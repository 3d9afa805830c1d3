"""Discovery, lineage and the signature gate in the ledger, from the command line and by themselves."""

import datetime
import json
from functools import partial

from featurelab import cli
from featurelab.operators.ledger import Ledger
from featurelab.operators.query import LIMIT


def test_a_run_fills_the_ledger(spark, tmp_path, monkeypatch, capsys):
    rows = "\n".join(f"{i % 60},{(i % 60) * 7 + 3},{i * 37 % 101},{(i % 60) * 2 + (i * 37 % 101) / 50}" for i in range(1200))
    (tmp_path / "d.csv").write_text(f"k,price,b,y\n{rows}\n")
    (tmp_path / "c.yaml").write_text(f"data_path: {tmp_path / 'd.csv'}\ntarget: y\nmetric: rmse\n")
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setattr(cli.model, "residuals", partial(cli.model.residuals, trees=3))  # the number of trees is tested in test_whole.py
    base = ["--config", str(tmp_path / "c.yaml"), "--ledger", str(tmp_path / "l")]
    said = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    cli.main([*base, "prepare"])
    cli.main([*base, "discover"])
    cli.main([*base, "discover"])
    cli.main([*base, "train", "--features", "k", "price / b", "--trees", "2", "--description", "col=k;op=ratio"])
    said()
    L = Ledger(spark, str(tmp_path / "l"))
    assert {r["column"] for r in L.columns().collect()} == {"k", "price", "b"}
    assert {r["run"] for r in L.last_run("derived_column").collect()} == {2}
    assert {tuple(r) for r in L.table("derived_from").collect()} == {("k", "k"), ("price / b", "price"), ("price / b", "b")}
    cli.main([*base, "inspect", "invariants"])
    assert {("price", ("k",)), ("k", ("price",))} <= {(r["expr"], tuple(r["columns"])) for r in said()}
    cli.main([*base, "inspect", "discovery"])
    assert {tuple(r["columns"]) for r in said()} >= {("k",), ("price",)}
    cli.main([*base, "inspect", "lineage"])
    assert {"feature": "price / b", "direct": "b,price", "all_columns": "b,price"} in said()
    cli.main([*base, "inspect", "column", "--column", "b"])
    assert said() == [{"node": "feat_price / b", "hop": 1}, {"node": "exp_1", "hop": 2}]
    for report in cli.REPORTS:
        assert cli.main([*base, "inspect", report, "--column", "b"]) == 0


def test_queries_count_from_the_last_discovery(spark, tmp_path):
    L, now = Ledger(spark, str(tmp_path / "l")), datetime.datetime(2026, 1, 1)
    L.append("query_log", [(now, "x")] * LIMIT)
    assert L.queries_asked() == LIMIT
    L.append("discovery", [(1, now + datetime.timedelta(seconds=1))])
    L.append("query_log", [(now + datetime.timedelta(seconds=2), "x")])
    assert L.queries_asked() == 1


def test_other_data_begin_a_new_ledger(spark, tmp_path):
    L, now = Ledger(spark, str(tmp_path / "l")), datetime.datetime(2026, 1, 1)
    assert not L.gate("one", now) and not L.gate("one", now)
    L.append("query_log", [(now, "x")])
    assert L.gate("two", now) and L.table("query_log").count() == 0 and not L.gate("two", now)
    assert Ledger(spark, f"{tmp_path / 'l'}-before-{now:%Y%m%d%H%M%S%f}").table("query_log").count() == 1
