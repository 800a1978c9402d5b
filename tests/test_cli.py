"""Each command on small files."""

import json

import pytest

from tessera import cli

GOLD = {"name": "f", "universe": "CSI300", "frequency": "daily", "neutralization": "none", "rebalance": "weekly", "expr": "RANK($close / TS_MEAN($close, 5))", "windows": [5]}


@pytest.fixture
def run(spark, tmp_path, capsys):
    rows = [{"case_id": f"c{i}", "report": "5 days", "gold": GOLD, "split": "holdout" if i == 2 else "train", "group_id": f"g{i}"} for i in range(3)]
    (tmp_path / "gold.jsonl").write_text("\n".join(map(json.dumps, rows)))

    def call(*argv):
        cli.main([a.format(t=tmp_path, gold=f"{tmp_path}/gold.jsonl") for a in argv], spark)
        return json.loads(capsys.readouterr().out)

    return call


def test_cases(run, spark, tmp_path):
    assert run("score", "--gold", "{gold}")["mean_reward"] == pytest.approx(0.9)
    assert all(r["intact"] for r in run("check-case", "--gold", "{gold}"))
    report = run("holdout-report", "--gold", "{gold}", "--out", "{t}/hold")
    assert [r["level"] for r in report] == ["group", "median", "pooled"] and spark.read.json(f"{tmp_path}/hold").count() == 3
    assert run("inject", "--gold", "{gold}", "--out", "{t}/inject")["n"] == 18
    assert run("build-sft", "--gold", "{gold}", "--out", "{t}/sft") == {"wrote": f"{tmp_path}/sft", "n": 2, "stage": "extract"}
    assert run("build-grpo", "--gold", "{gold}", "--out", "{t}/rl", "--stage", "evolve")["n"] == 2
    assert run("dry-run", "--gold", "{gold}", "--out", "{t}/dry")["gate_pass_rate"] == 1.0
    assert spark.read.json(f"{tmp_path}/dry/case_id=c1").first().passed
    with pytest.raises(SystemExit, match="no cases"):
        run("score", "--gold", "{t}/none.jsonl")


def test_reports(run, tmp_path):
    for name, rate in (("a", 0.25), ("b", 0.75)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"pooled": {"task_success_rate": rate, "n": 4}}))
    got = {r["metric"]: r for r in run("compare-metrics", "--before", "{t}/a.json", "--after", "{t}/b.json")}
    assert got["task_success_rate"]["delta_pp"] == 50.0 and got["illegal_tool_call_rate"]["after"] == 0.0
    (tmp_path / "run/scores").mkdir(parents=True)
    lines = [{"case_id": "a", "reward": r, "tool_calls": 2, "illegal_tool_calls": 1} for r in (0.2, 0.9)]
    (tmp_path / "run/scores/x.json").write_text("\n".join(map(json.dumps, lines)))
    assert run("route-probe", "--input", "{t}/run/scores", "--out", "{t}/pools")["counts"] == {"rl_main": 1}
    assert run("summarize-run", "--run-dir", "{t}/run", "--out", "{t}/report")["illegal_tool_call_rate"] == 0.5
    (tmp_path / "samples.jsonl").write_text(json.dumps({"rollout_log_probs": [0.0, 0.0], "training_log_probs": [0.1, 0.0], "response_mask": [1, 0]}))
    assert run("diagnose-correction", "--input", "{t}/samples.jsonl")["recommended"]


def test_backtests(run, spark, tmp_path):
    from test_service import market
    from pyspark.sql import functions as F

    from tessera.sources import sinks

    members = spark.createDataFrame([("CSI300", f"s{i}") for i in range(4)], "universe string, instrument string").withColumn("date", F.to_date(F.lit("2024-01-01")))
    sinks.export_panel(market(spark), members, f"{tmp_path}/panel", "test", "2024-01-01", "2024-12-31")
    out = run("backtest-smoke", "--panel", "{t}/panel", "--expr", "RANK($close)", "--universe", "CSI300")
    assert out["diagnostics"]["rows"] == 48 and len(out["portfolio"]["nav"]) == 12
    (tmp_path / "pairs.jsonl").write_text(json.dumps({"case_id": "a", "seed": GOLD, "evolved": GOLD}))
    report = run("eval-window-report", "--input", "{t}/pairs.jsonl", "--endpoint", "http://127.0.0.1:9/backtest", "--log", "{t}/log")
    assert (report["n"], report["n_scored"], report["median_delta"]) == (1, 0, None)
