"""Evolution trajectories, replayed from their calls: candidates, budget, faults and rewards of all at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expression import listed
from ..functions.text import candidate
from . import records as R
from .training import EVOLVE_TOOLS, tool_names


def replayed(calls: DataFrame, seeds: DataFrame, results: DataFrame, max_rounds: int = 4) -> DataFrame:
    """The calls that count, with candidate, evaluation, ok, source, error, drifted, legal, metric and illegal_kind.

    ``calls`` have trajectory, step, turn (their order), name and arguments
    (JSON); ``seeds`` trajectory and seed (a record); ``results`` of evaluations
    trajectory, turn, ok, metric and error_source.  A trajectory ends with the
    step of its evaluation ``max_rounds`` and after three times as many steps;
    later calls of that step are over the budget.
    """
    check, run = tool_names(EVOLVE_TOOLS)
    rows = calls.where(F.col("step") < 3 * max_rounds).join(seeds.select("trajectory", "seed"), "trajectory")
    rows = rows.withColumns({"candidate": candidate(F.col("arguments"), F.col("seed")), "unparsable": F.try_parse_json("arguments").isNull()})
    asked = (F.col("name") == run) & F.col("candidate").isNotNull()
    own = W.partitionBy("trajectory")
    number = F.count_if(asked).over(own.orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("evaluation", F.when(asked, number))
    last = F.min(F.when(F.col("evaluation") >= max_rounds, F.col("step"))).over(own)
    rows = rows.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("step") <= F.col("_last"))).drop("_last")
    spent = F.col("evaluation") > max_rounds
    given = results.select("trajectory", "turn", F.col("ok").alias("_ok"), F.col("metric").alias("_metric"), F.col("error_source").alias("_source"))
    rows = rows.join(given, ["trajectory", "turn"], "left")
    legal = listed(F.col("candidate.expr"))["ok"]
    done = F.col("evaluation").isNotNull() & ~spent
    error = (
        F.when(F.col("candidate").isNull(), "invalid FactorSpec")
        .when(spent, "max evaluation rounds reached")
        .when(~F.col("name").isin(check, run), F.concat(F.lit("unknown tool: "), F.col("name")))
    )
    rows = rows.withColumns(
        {
            "legal": F.coalesce(legal, F.lit(False)),
            "error": error,
            "drifted": F.col("candidate").isNotNull() & (F.size(R.spec_drift(F.col("seed"), F.col("candidate"))) > 0),
            "metric": F.when(done & F.coalesce("_ok", F.lit(False)), F.col("_metric")),
        }
    )
    ok = F.when(F.col("error").isNotNull(), False).when(done, F.coalesce("_ok", F.lit(False))).otherwise(F.col("legal"))
    rows = rows.withColumns({"ok": ok, "source": F.when(done, F.coalesce("_source", F.lit("model"))).otherwise("model")}).drop("_ok", "_metric", "_source")
    return R.classified(rows, [check, run])


def rewarded(replay: DataFrame, seeds: DataFrame, max_rounds: int = 4) -> DataFrame:
    """(trajectory, subscores, raw, caps, reward) of every seed; ``seeds`` have baseline and robustness, null where not known.

    A trajectory without a candidate has no valid, novel or successful one, and
    the performance of its seed.
    """
    rows = replay.join(seeds.select("trajectory", "baseline", "robustness"), "trajectory")
    plain = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))
    rows = rows.withColumn("crowded", F.count("*").over(W.partitionBy("trajectory", "step")) > 1)
    crowded = rows.groupBy("trajectory").agg(F.max("crowded").alias("_crowded"))
    turns = rows.where(F.col("evaluation") <= max_rounds).withColumn("novel", plain("candidate.expr") != plain("seed.expr"))
    scores = R.evolution_scores(R.best_so_far(turns)).select("trajectory", *R.EVOLVE_WEIGHTS)
    found = seeds.select("trajectory", F.col("robustness").alias("_robust")).join(crowded, "trajectory", "left").join(scores, "trajectory", "left")
    default = {"validity": 0.0, "no_drift": 1.0, "backtest_success": 0.0, "performance": 0.5, "novelty": 0.0}
    whole = {c: F.coalesce(c, F.lit(v)) for c, v in default.items()}
    whole["robustness"] = F.coalesce("robustness", R.clamped(F.coalesce("_robust", F.lit(0.5))))
    whole["protocol"] = F.when(F.coalesce("_crowded", F.lit(False)), 0.0).otherwise(1.0)
    out = found.withColumn("_proposed", F.col("validity").isNotNull()).withColumns(whole)
    return R.evolution_reward(out, F.col("_proposed")).select("trajectory", *R.EVOLVE_WEIGHTS, "raw", "caps", "reward")
