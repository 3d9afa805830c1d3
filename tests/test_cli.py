import json

from featurelab import cli


def test_a_run_from_the_command_line(spark, tmp_path, capsys):
    rows = "\n".join(f"{i % 60},{i * 37 % 101},{(i % 60) * 2 + (i * 37 % 101) / 50}" for i in range(1200))
    (tmp_path / "d.csv").write_text(f"a,b,y\n{rows}\n")
    base = ["--config", str(tmp_path / "c.yaml"), "--ledger", str(tmp_path / "ledger")]
    cli.main([*base, "init", str(tmp_path / "d.csv"), "y"])
    assert "metric: rmse" in (tmp_path / "c.yaml").read_text()
    for command in (["prepare"], ["query", "correlation", "--col-a", "a", "--col-b", "b"], ["train", "--features", "a", "a / b", "--trees", "3", "--description", "col=a;op=ratio"], ["status"], ["inspect", "success"], ["inspect", "history"]):
        assert cli.main([*base, *command]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert any(x.get("kept") is True and x.get("exp_id") == 1 for x in out)
    assert {"family": "ratio", "total": 1, "kept": 1, "rate": 1.0} in out
