"""Logs read as streams give what they give as tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import records as R
from tessera.sources import files, sinks
from tessera.streaming import logs


def some(spark, *rewards, case="c"):
    rows = [(case, r, ["spec_drift_cap"] if r < 0.3 else [], 2, 1, {"unknown_tool": 1}, 0, 0, False, False, False, False, False) for r in rewards]
    return spark.createDataFrame(rows, files.ROLLOUTS)


def test_metrics_of_cases_go_on(spark, tmp_path):
    log, out, at = (str(tmp_path / x) for x in ("log", "out", "at"))
    for batch in ((0.1, 0.9), (0.5,)):
        sinks.write_rollouts(some(spark, *batch), log)
        sinks.write_rollouts(some(spark, 0.7, case=f"own{len(batch)}"), log)
        logs.keep_latest(logs.case_metrics(logs.rollouts(spark, log)), out, at).awaitTermination()
    got = logs.latest(spark, out, "case_id")
    want = R.group_metrics(files.json_rows(spark, log, files.ROLLOUTS))
    shown = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in want.dtypes]  # sums in another order differ in their last digits
    assert sorted(map(str, got.select(*shown).collect())) == sorted(map(str, want.select(*shown).collect()))


def test_windows_close(spark, tmp_path):
    log, out, at = (str(tmp_path / x) for x in ("log", "out", "at"))
    minutes = [[0, 30, 70], [65, 400], [5, 900]]  # the last 5 is too late
    schema = f"{files.ROLLOUTS}, at timestamp"
    for batch in minutes:
        rows = some(spark, *[0.5] * len(batch)).coalesce(1).withColumn("_n", F.monotonically_increasing_id())
        rows = rows.withColumn("at", F.timestamp_seconds(F.element_at(F.array(*[F.lit(m * 60) for m in batch]), (F.col("_n") + 1).cast("int")))).drop("_n")
        sinks.write_json(rows, log, "append")
        stream = spark.readStream.schema(schema).json(log)
        logs.keep(logs.window_metrics(stream, "at"), out, at).awaitTermination()
    got = {int(r.start.timestamp()) // 3600: (r.n, r.mean_reward, r.illegal_tool_call_rate) for r in spark.read.parquet(out).collect()}
    assert got[0] == (2, 0.5, 0.5) and got[1] == (2, 0.5, 0.5) and got[6] == (1, 0.5, 0.5)


def test_a_broken_line_ends_the_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.json").write_text("{broken\n")
    with pytest.raises(Exception):
        logs.keep_latest(logs.case_metrics(logs.rollouts(spark, str(tmp_path / "log"))), str(tmp_path / "o"), str(tmp_path / "at")).awaitTermination()
