from functools import partial

from featurelab import cli


def test_discover_reports_raw_columns_constant_within_an_entity(spark, tmp_path, monkeypatch, capsys):
    df = spark.range(1200).selectExpr("cast(id % 60 as int) as k", "cast(id % 60 as double) * 7 + 3 as price", "cast(rand(1) as double) as x", "cast(rand(2) as double) as y")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    (tmp_path / "c.yaml").write_text(f"data_path: {tmp_path / 'd'}\ntarget: y\nmetric: rmse\n")
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setattr(cli.model, "entity_residuals", partial(cli.model.entity_residuals, trees=1))
    cli.main(["--config", str(tmp_path / "c.yaml"), "--ledger", str(tmp_path / "l"), "discover"])
    assert '"expr": "price"' in capsys.readouterr().out
    cli.show(spark.range(70))
    assert len(capsys.readouterr().out.split("\n")) == 71
