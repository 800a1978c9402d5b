"""The commands: ``python -m tessera.cli COMMAND ...``; each prints one JSON document."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import probes as P
from .operators import records as R
from .operators import training as T
from .plans import backtest as B
from .plans.engine import BacktestEngine, exported
from .session import on_workers, session
from .sources import files, service, sinks, vendor


def _show(found) -> None:
    rows = [r.asDict(recursive=True) for r in found.collect()] if isinstance(found, DataFrame) else found
    print(json.dumps(rows[0] if isinstance(rows, list) and len(rows) == 1 else rows, ensure_ascii=False, indent=2, default=str))


def _cases(spark: SparkSession, path: str) -> DataFrame:
    rows = files.cases(spark, path)
    if rows.isEmpty():
        raise SystemExit(f"no cases in {path}")
    return rows


def _written(rows: DataFrame, path: str, **more) -> None:
    sinks.write_json(rows, path)
    _show({"wrote": path, "n": rows.sparkSession.read.text(path).count()} | more)


def score(spark, a) -> None:
    cases = _cases(spark, a.gold)
    _show(R.summarized(R.scored(cases.withColumn("pred", F.col("gold")))))
    R.assert_no_leak(cases, "case_id")


def holdout_report(spark, a) -> None:
    found = T.holdout_report(_cases(spark, a.gold), a.split).orderBy("level", "group").cache()
    if a.out:
        sinks.write_one(found, a.out)
    _show(found)


def compare_metrics(spark, a) -> None:
    def read(path: str) -> DataFrame:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        found = found.get("pooled", found)
        return spark.createDataFrame([(k, float(v)) for k, v in found.items() if isinstance(v, (int, float))], "metric string, value double")

    _show(R.compared(read(a.before), read(a.after)))


def eval_window_report(spark, a) -> None:
    client, (start, end) = service.ServiceClient(spark, a.log, service.ClientConfig(endpoint=a.endpoint), namespace="eval_window"), R.PERIODS["eval"]
    out = []
    for r in files.pairs(spark, a.input).toLocalIterator():  # a call of the service for each record
        for side in ("seed", "evolved"):
            got = client.evaluate(r[side].asDict(), r.case_id, "eval", start, end)
            out.append((r.case_id, side, got["ok"], got["metric"], got["error"]))
    rows = R.eval_pairs(spark.createDataFrame(out, "case_id string, side string, ok boolean, metric double, error string")).cache()
    if a.out:
        sinks.write_one(rows, a.out)
    _show(R.eval_window(rows))


def inject(spark, a) -> None:
    rows = R.scored(R.injected(_cases(spark, a.gold)))
    sinks.write_json(rows.select("case_id", "kind", "reward", "caps", "pred"), a.out)
    _show(R.injection_gap(rows))


def build_sft(spark, a) -> None:
    _written(T.sft_rows(_cases(spark, a.gold), a.stage), a.out, stage=a.stage)


def build_grpo(spark, a) -> None:
    _written(T.grpo_rows(_cases(spark, a.gold), a.stage), a.out)


def dry_run(spark, a) -> None:
    rows = T.dry_run(_cases(spark, a.gold), a.gate).cache()
    sinks.write_by_case(rows, a.out)
    _show(R.summarized(rows))


def route_probe(spark, a) -> None:
    metrics = R.group_metrics(files.json_rows(spark, a.input, files.ROLLOUTS))
    routed = metrics.withColumn("r", R.routed(F.lit("train"), F.lit(True))).select("*", "r.*").drop("r")
    _show({"out": a.out, "counts": {r.route: r.n for r in sinks.write_pools(routed, a.out).collect()}})


def summarize_run(spark, a) -> None:
    _show(sinks.write_run_report(files.json_rows(spark, f"{a.run_dir}/scores", files.ROLLOUTS), a.out))


def diagnose_correction(spark, a) -> None:
    _show(R.correction_report(files.samples(spark, a.input), a.threshold, a.enable_delta))


def prepare_market_data(spark, a) -> None:
    client = importlib.import_module(a.client)
    _show(vendor.prepared(vendor.VendorSource(spark, lambda: client, a.client), a.dir, a.start, a.end, a.universes))


def serve_backtest(spark, a) -> None:
    service.serve(BacktestEngine(exported(spark, a.panel, a.start, a.end), source=a.panel, span=(a.start, a.end)), a.host, a.port).serve_forever()


def backtest_smoke(spark, a) -> None:
    engine = BacktestEngine(exported(spark, a.panel, a.start, a.end))
    given = {"update_freq": a.update_freq, "stock_pool": a.universe, "shift_bars": a.shift_bars, "shuffle_cross_section": a.shuffle}
    _show(engine.backtest(exprs={a.name: a.expr}, backtest_start_time=a.start, backtest_end_time=a.end, **given))


def check_case(spark, a) -> None:
    _show(P.integrity(_cases(spark, a.gold)).select("case_id", "gold_reward", "errors", "intact"))


_GOLD = {"--gold": {"required": True}}
_OUT = {"--out": {"required": True}}
_STAGE = {"--stage": {"choices": T.STAGES, "default": "extract"}}
_PANEL = {"--panel": {"required": True}, "--start": {"default": "2024-01-01"}, "--end": {"default": "2024-12-31"}}
COMMANDS = {
    score: _GOLD,
    check_case: _GOLD,
    holdout_report: _GOLD | {"--split": {"choices": ("train", "holdout"), "default": "holdout"}, "--out": {"default": ""}},
    compare_metrics: {"--before": {"required": True}, "--after": {"required": True}},
    eval_window_report: {"--input": {"required": True}, "--endpoint": {"default": service.ClientConfig.endpoint}, "--log": {"required": True}, "--out": {"default": ""}},
    inject: _GOLD | _OUT,
    build_sft: _GOLD | _OUT | _STAGE,
    build_grpo: _GOLD | _OUT | _STAGE,
    dry_run: _GOLD | _OUT | {"--gate": {"type": float, "default": 0.7}},
    route_probe: {"--input": {"required": True}} | _OUT,
    summarize_run: {"--run-dir": {"required": True}} | _OUT,
    diagnose_correction: {"--input": {"required": True}, "--threshold": {"type": float, "default": 2.0}, "--enable-delta": {"type": float, "default": 0.02}},
    prepare_market_data: {"--dir": {"required": True}, "--client": {"default": "baostock"}, "--start": {"default": "2017-01-01"}, "--end": {"default": "2024-12-31"}, "--universes": {"nargs": "+", "default": list(B.UNIVERSES)}},
    serve_backtest: _PANEL | {"--host": {"default": "127.0.0.1"}, "--port": {"type": int, "default": 8001}},
    backtest_smoke: _PANEL
    | {"--name": {"default": "factor"}, "--expr": {"default": "-TS_PCTCHANGE($close, 20)"}, "--universe": {"choices": B.UNIVERSES, "default": "CSI500"}}
    | {"--update-freq": {"type": int, "default": 5}, "--shift-bars": {"type": int, "default": 0}, "--shuffle": {"action": "store_true"}},
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    for run, options in COMMANDS.items():
        own = commands.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        for name, how in options.items():
            own.add_argument(name, **how)
        own.set_defaults(run=run)
    given = parser.parse_args(argv)
    given.run(on_workers(spark or session("tessera")), given)


if __name__ == "__main__":
    main()
