"""Rule-based scoring of predicted records, audits, groups, routes and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expression import listed
from ..functions.text import blank, normal_expression, numbers, numbers_meant

#: Weights of the parts of a score, and what each fault caps it at.
WEIGHTS = {"schema_ok": 0.25, "executable": 0.25, "fields": 0.40, "grounding": 0.10}
CAPS = {"invalid_json_cap": 0.0, "illegal_expr_cap": 0.15, "invalid_citation_cap": 0.20, "hallucinated_expr_cap": 0.35}
EVOLVE_WEIGHTS = {"validity": 0.15, "no_drift": 0.15, "protocol": 0.10, "backtest_success": 0.10, "performance": 0.35, "robustness": 0.10, "novelty": 0.05}
EVOLVE_CAPS = {"multi_tool_per_step_cap": 0.0, "illegal_expr_cap": 0.15, "spec_drift_cap": 0.30}
SAME_FIELDS = ("universe", "frequency", "neutralization", "rebalance")
TERM_RANK = {"daily": 0, "weekly": 1, "monthly": 2}
FREQUENCY_FLIP = {"daily": "monthly", "weekly": "daily", "monthly": "weekly"}
STEP_BARS = {"daily": 1, "weekly": 5, "monthly": 20}


def lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def capped(raw: Column, caps: Column, table: dict) -> Column:
    return F.least(raw, F.coalesce(F.array_min(F.transform(caps, lambda c: lookup(table, c))), F.lit(1.0)))


def compacted(*flags: tuple[str, Column]) -> Column:
    """The names whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags]))


def settled(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with columns that are computed once, however often what follows uses them.

    They come out of a generator, which the optimizer does not fold into the
    expressions that read them, so plans stay as long as they are written.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parameters(spec: Column) -> Column:
    return F.array_union(spec["windows"].cast("array<bigint>"), numbers(spec["expr"]))


def held(wanted: Column, present: Column) -> Column:
    """The share of the wanted numbers that are present; 1 if none is wanted."""
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.array_intersect(wanted, present)) / F.size(wanted))


def field_score(pred: Column, gold: Column) -> Column:
    hits = sum(((pred[f] == gold[f]).cast("double") for f in SAME_FIELDS), F.lit(0.0))
    return (hits + (normal_expression(pred["expr"]) == normal_expression(gold["expr"])).cast("double")) / 5


def declaration_issues(spec: Column) -> Column:
    has = F.contains(F.upper(spec["expr"]), F.lit("INDUSTRY_NEUTRALIZE"))
    return compacted(
        ("neutralization_missing_in_expr", spec["neutralization"].isin("industry", "industry_size") & ~has),
        ("neutralize_in_expr_but_field_none", (spec["neutralization"] == "none") & has),
        ("rebalance_faster_than_frequency", lookup(TERM_RANK, spec["rebalance"]) < lookup(TERM_RANK, spec["frequency"])),
    )


def undeclared(spec: Column) -> Column:
    """Numbers of the expression that the windows do not declare."""
    return F.array_except(numbers(spec["expr"]), spec["windows"].cast("array<bigint>"))


def quotes(spec: Column) -> Column:
    return F.array_join(F.transform(spec["evidence"], lambda e: e["quote"]), "\n")


def uncited(spec: Column) -> Column:
    """Numbers of the expression or the windows that no quotation holds."""
    return F.array_except(parameters(spec), numbers_meant(quotes(spec)))


def unlocated(spec: Column) -> Column:
    bad = F.filter(spec["evidence"], lambda e: blank(e["chunk_id"]) | (e["page_start"].isNull() & e["char_start"].isNull()))
    return F.transform(bad, lambda e: F.coalesce(F.nullif(e["chunk_id"], F.lit("")), F.lit("<no chunk_id>")))


def citation_faults(evidence: Column, report: Column) -> Column:
    """Messages of quotations that the report does not hold, then of those without a chunk."""
    lost = F.filter(evidence, lambda e: blank(e["quote"]) | ~F.contains(report, e["quote"]))
    loose = F.filter(evidence, lambda e: blank(e["chunk_id"]))
    return F.concat(
        F.transform(lost, lambda e: F.concat(e["chunk_id"], F.lit(": quote not found"))),
        F.transform(loose, lambda e: F.lit("<no chunk_id>: citation is not anchored to a chunk")),
    )


def scored(cases: DataFrame) -> DataFrame:
    """Adds schema_ok, executable, fields, grounding, caps, cap_reasons, raw and reward to (report, gold, pred).

    gold and pred are structs of the record's fields; a NULL pred was not
    parsed.  Numbers count in digits and in Chinese numerals.  A column
    report_numbers, if there is one, saves looking for those of the report.
    """
    pred, gold = F.col("pred"), F.col("gold")
    evidence = F.coalesce(pred["evidence"], F.filter(pred["evidence"], lambda e: F.lit(False)))
    present = F.col("report_numbers") if "report_numbers" in cases.columns else numbers_meant(F.col("report"))
    parts = {
        "_check": listed(pred["expr"]),
        "_faults": citation_faults(evidence, F.col("report")),
        "_same": normal_expression(pred["expr"]) == normal_expression(gold["expr"]),
        "_wanted": parameters(pred),
        "_present": present,
        "_quoted": numbers_meant(quotes(pred)),
        "_cites": F.size(evidence) > 0,
        "_hits": field_score(pred, gold),
    }
    out = ("schema_ok", "executable", "fields", "grounding", "caps", "cap_reasons", "raw", "reward")
    kept = [c for c in cases.columns if c not in out]
    rows = settled(cases.select(*[F.col(f"`{c}`") for c in kept]), parts)
    legal, faults, found = F.col("_check.ok"), F.col("_faults"), pred.isNotNull()
    invented = ~F.col("_same") & legal & ((pred["universe"] != gold["universe"]) | (held(F.col("_wanted"), F.col("_present")) < 0.3))
    grounding = F.when(~F.col("_cites"), 0.0).otherwise(held(F.col("_wanted"), F.col("_quoted")))
    raised = (
        ("invalid_json_cap", ~found, F.lit("could not parse FactorSpec JSON")),
        ("illegal_expr_cap", found & ~legal, F.col("_check.reason")),
        ("invalid_citation_cap", found & (F.size(faults) > 0), F.array_join(faults, "; ")),
        ("hallucinated_expr_cap", found & invented, F.lit("expr ungrounded vs report/gold")),
    )
    reasons = F.array(*[F.when(c, F.struct(F.lit(n).alias("key"), r.alias("value"))) for n, c, r in raised])
    given = lambda c: F.when(found, c).otherwise(0.0)
    scores = {
        "schema_ok": found.cast("double"),
        "executable": given(legal.cast("double")),
        "fields": given(F.col("_hits")),
        "grounding": given(grounding),
        "caps": compacted(*[r[:2] for r in raised]),
        "cap_reasons": F.map_from_entries(F.array_compact(reasons)),
    }
    rows = settled(rows, scores).drop(*parts)
    raw = sum((F.col(part) * weight for part, weight in WEIGHTS.items()), F.lit(0.0))
    return rows.withColumn("raw", F.when(found, raw).otherwise(0.0)).withColumn("reward", capped(F.col("raw"), F.col("caps"), CAPS))


def passes_gate(reward: Column, caps: Column, legal: Column, least: float = 0.7) -> Column:
    return (reward >= least) & (F.size(caps) == 0) & legal


def task_success() -> Column:
    return (F.size("caps") == 0) & (F.col("reward") >= 0.7) & (F.col("fields") >= 1) & (F.col("executable") >= 1)


def evidence_grounded() -> Column:
    return (F.col("grounding") >= 1) & ~F.array_contains("caps", "invalid_citation_cap")


def share(condition: Column) -> Column:
    return F.coalesce(F.avg(F.when(condition, 1.0).otherwise(0.0)), F.lit(0.0))


def summary_columns() -> dict[str, Column]:
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    has = lambda c: F.array_contains("caps", c)
    return {
        "n": F.count("*"),
        "mean_reward": zero("reward"),
        "parse_ok": share(~has("invalid_json_cap")),
        "field_mean": zero("fields"),
        "grounding_mean": zero("grounding"),
        "gate_pass_rate": share((F.col("reward") >= 0.7) & (F.size("caps") == 0)),
        "hallucination_rate": share(has("hallucinated_expr_cap")),
        "task_success_rate": share(task_success()),
        "evidence_grounding_rate": share(evidence_grounded()),
    }


def summarized(results: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """One row of figures; with ``audits`` (as :func:`audited` gives them) also of the tool calls."""
    out = results.agg(*[c.alias(n) for n, c in summary_columns().items()])
    if audits is None:
        return out
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    calls = audits.agg(zero("tool_calls").alias("tool_calls"), zero("illegal_tool_calls").alias("illegal_tool_calls"))
    rate = F.coalesce(F.try_divide("illegal_tool_calls", "tool_calls"), F.lit(0.0))
    return out.crossJoin(F.broadcast(calls.withColumn("illegal_tool_call_rate", rate)))  # one row each


#: The rates whose medians over the groups are shown, and those that are compared.
MEDIANS = ("task_success_rate", "evidence_grounding_rate", "mean_reward")
HEADLINE = ("task_success_rate", "evidence_grounding_rate", "illegal_tool_call_rate")


def exact_medians(rows: DataFrame, *columns: str, accuracy: int = 1000) -> DataFrame:
    """One row: the exact median of each column, nulls left out; null where there is none.

    Two passes, neither of which brings all values together.  The first counts
    them and brackets the middle by a sketch; the second counts what is below
    the bracket and, value by value, what is within, some ``2 / accuracy`` of
    the values at most, and equal values are one.
    """
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("e")).select("e.*").where("v is not null")
    near = F.percentile_approx("v", F.array(F.lit(max(0.0, 0.5 - 0.5 / accuracy)), F.lit(min(1.0, 0.5 + 0.5 / accuracy))), 4 * accuracy)
    bounds = each.groupBy("i").agg(F.count("*").alias("n"), near.alias("b")).select("i", "n", F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"))
    held = each.join(F.broadcast(bounds), "i").where("v <= hi")  # a row a column
    counts = held.groupBy("i", "n", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(W.partitionBy("i").orderBy(F.col("v").asc_nulls_first()))
    placed = counts.withColumns({"z": upto, "a": upto - F.col("m")})
    at = lambda place: F.max(F.when((F.col("a") < place) & (F.col("z") >= place), F.col("v")))
    both = placed.groupBy("i").agg(at(F.floor((F.col("n") + 1) / 2)).alias("x"), at(F.floor(F.col("n") / 2) + 1).alias("y"))
    middle = F.col("x") * 0.5 + F.col("y") * 0.5
    return both.agg(*[F.max(F.when(F.col("i") == i, middle)).alias(c) for i, c in enumerate(columns)])


def summarized_by_group(results: DataFrame, group: Column) -> DataFrame:
    """(level, group, n, figures): a row for each group, one for all rows (pooled), one of the groups' medians.

    A row without a group is a group of its own, its case_id.  The row of
    medians counts the groups in n and holds the medians of ``MEDIANS`` alone.
    """
    names = list(summary_columns())
    rows = results.withColumn("group", F.coalesce(group, F.col("case_id")))
    sums = rows.rollup("group").agg(F.grouping("group").alias("_all"), *[c.alias(n) for n, c in summary_columns().items()])
    each = sums.select(F.when(F.col("_all") == 1, "pooled").otherwise("group").alias("level"), "group", *names)
    own = each.where("level = 'group'")
    middle = own.agg(F.count("*").alias("n")).crossJoin(F.broadcast(exact_medians(own, *MEDIANS)))  # one row each
    shown = [F.col(n) if n in ("n", *MEDIANS) else F.lit(None).cast("double").alias(n) for n in names]
    return each.unionByName(middle.select(F.lit("median").alias("level"), F.lit(None).cast("string").alias("group"), *shown))


def compared(before: DataFrame, after: DataFrame, metrics: tuple[str, ...] = HEADLINE) -> DataFrame:
    """(metric, before, after, delta_pp) in percentage points; a metric that one side lacks counts as 0."""
    points = lambda c: F.bround(c * 100, 1)
    b, a = (df.where(F.col("metric").isin(*metrics)).select("metric", F.col("value").alias(n)) for df, n in ((before, "b"), (after, "a")))
    asked = before.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    both = asked.join(b, "metric", "left").join(a, "metric", "left").na.fill(0, ["b", "a"])
    return both.select("metric", points(F.col("b")).alias("before"), points(F.col("a")).alias("after"), points(F.col("a") - F.col("b")).alias("delta_pp"))


def injection_gap(rows: DataFrame) -> DataFrame:
    """(n, gold_mean, inject_mean) of scored ``injected`` rows."""
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("reward"))), F.lit(0.0))
    gold = F.col("kind") == "gold"
    return rows.agg(F.count("*").alias("n"), mean(gold).alias("gold_mean"), mean(~gold).alias("inject_mean"))


def leaked(rows: DataFrame, key: str) -> DataFrame:
    """Keys that both the train and the holdout split hold."""
    return rows.where("split = 'train'").select(key).intersect(rows.where("split = 'holdout'").select(key))


def assert_no_leak(rows: DataFrame, key: str) -> None:
    found = [r[0] for r in leaked(rows, key).orderBy(key).limit(5).collect()]
    if found:
        raise ValueError(f"{key} in both train and holdout: {found}")


def group_key(explicit: Column, institution: Column, series: Column, doc_id: Column, case_id: Column) -> Column:
    """The first that there is: explicit, institution::series (one of them is enough), document, case."""
    bare = lambda c: F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))
    given = lambda c: F.nullif(c, F.lit(""))
    named = [F.coalesce(bare(c), F.lit("unknown")) for c in (institution, series)]
    source = F.when(F.coalesce(bare(institution), bare(series)).isNotNull(), F.concat_ws("::", *named))
    return F.coalesce(given(explicit), source, given(doc_id), case_id)


INJECTIONS = ("drop_neutralization", "wrong_frequency", "wrong_window", "hallucinated_expr", "illegal_expr")


def injected(golds: DataFrame) -> DataFrame:
    """``gold`` and five damaged copies, as (kind, pred); the report's numbers are sought once, before it is copied."""
    gold, kind = F.col("gold"), F.col("kind")
    if "report" in golds.columns:
        golds = settled(golds.drop("report_numbers"), {"report_numbers": numbers_meant(F.col("report"))})
    rows = golds.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in ("gold", *INJECTIONS)])))
    windows = F.when(F.size(gold["windows"]) > 0, gold["windows"]).otherwise(F.array(F.lit(20)))
    tripled = F.transform(windows, lambda w: F.when(w == 0, 60).otherwise(w * 3).cast("int"))
    swapped = F.when(F.size(gold["windows"]) > 0, F.replace(gold["expr"], gold["windows"][0].cast("string"), tripled[0].cast("string"))).otherwise(gold["expr"])
    pred = (
        F.when(kind == "drop_neutralization", gold.withField("neutralization", F.lit("none")))
        .when(kind == "wrong_frequency", gold.withField("frequency", lookup(FREQUENCY_FLIP, gold["frequency"])))
        .when(kind == "wrong_window", gold.withField("windows", tripled).withField("expr", swapped))
        .when(kind == "hallucinated_expr", gold.withField("expr", F.lit("RANK($close)")).withField("windows", F.array().cast("array<int>")).withField("universe", F.lit("UNKNOWN")))
        .when(kind == "illegal_expr", gold.withField("expr", F.lit("import os; os.system('x')")))
        .otherwise(gold)
    )
    return settled(rows.drop("pred"), {"pred": pred})


#: What can be wrong with a tool call.
ILLEGAL_KINDS = ("unknown_tool", "unparsable_arguments", "schema_invalid", "budget_exceeded", "frozen_field_mutation", "multi_tool_per_step")


def classified(calls: DataFrame, allowed: list[str]) -> DataFrame:
    """Adds illegal_kind: the first rule that a call breaks, then more calls than one in a step.

    A boolean column ``drifted``, if there is one, tells calls whose record
    changes frozen fields.
    """
    error = F.coalesce("error", F.lit(""))
    fault = (
        F.when(~F.col("name").isin(allowed), "unknown_tool")
        .when(F.col("unparsable"), "unparsable_arguments")
        .when(F.col("ok") | (F.col("source") == "environment"), None)
        .when(error.contains("max evaluation rounds"), "budget_exceeded")
        .when(error.contains("invalid FactorSpec"), "schema_invalid")
    )
    drifted = F.when(F.col("drifted"), "frozen_field_mutation") if "drifted" in calls.columns else F.lit(None)
    crowded = F.count("*").over(W.partitionBy("trajectory", "step")) > 1
    return calls.withColumn("illegal_kind", F.coalesce(fault, drifted, F.when(crowded, "multi_tool_per_step")))


def tally(names: tuple[str, ...], hit) -> Column:
    """An aggregate: a map of the names that occur to how often ``hit(name)`` holds."""
    counts = F.create_map(*[x for n in names for x in (F.lit(n), F.count_if(hit(n)))])
    return F.map_filter(counts, lambda k, v: v > 0)


def audited(calls: DataFrame) -> DataFrame:
    """Counts of each trajectory's calls, of the illegal ones by kind and of failures of the environment."""
    illegal = F.count("illegal_kind")
    return calls.groupBy("trajectory").agg(
        F.count("*").alias("tool_calls"),
        illegal.alias("illegal_tool_calls"),
        F.coalesce(F.try_divide(illegal, F.count("*")), F.lit(0.0)).alias("illegal_tool_call_rate"),
        tally(ILLEGAL_KINDS, lambda n: F.col("illegal_kind") == n).alias("illegal_by_kind"),
        F.count_if(~F.col("ok") & (F.col("source") == "environment")).alias("environment_failures"),
    )


def histogram(rows: DataFrame, key: str, *by: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count("*").alias("n"))


def group_metrics(records: DataFrame, high: float = 0.8) -> DataFrame:
    """By case: number and spread of rewards, success and error rates."""
    caps = F.coalesce("active_caps", F.array())
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    any_cap = lambda *names: F.arrays_overlap(caps, F.array(*[F.lit(n) for n in names]))
    won = F.avg(F.when(F.col("reward") >= high, 1.0).otherwise(0.0))
    return records.groupBy("case_id").agg(
        F.count("*").alias("k"),
        F.min("reward").alias("min_reward"),
        F.max("reward").alias("max_reward"),
        F.avg("reward").alias("mean_reward"),
        F.stddev_pop("reward").alias("reward_std"),
        (F.max("reward") - F.min("reward")).alias("reward_spread"),
        won.alias("success_at_k"),
        (won > 0).alias("any_success"),
        share(flag("parse_error") | any_cap("invalid_json_cap")).alias("parse_error_rate"),
        share(flag("grounding_error") | any_cap("invalid_citation_cap", "hallucinated_expr_cap")).alias("grounding_error_rate"),
        F.coalesce(F.try_divide(F.sum(number("illegal_tool_calls")), F.sum(number("tool_calls"))), F.lit(0.0)).alias("illegal_tool_call_rate"),
        share(number("tool_error_model") > 0).alias("tool_error_rate"),
        share(number("tool_error_environment") > 0).alias("environment_error_rate"),
        share(flag("spec_drift") | any_cap("spec_drift_cap")).alias("spec_drift_rate"),
        share(flag("backtest_failed")).alias("backtest_failure_rate"),
        share(flag("max_step_hit")).alias("max_step_hit_rate"),
        tally(tuple(CAPS | EVOLVE_CAPS), lambda n: F.array_contains(caps, n)).alias("hard_cap_distribution"),
    )


def routed(split: Column, intact: Column, errors: Column | None = None, high: float = 0.8, low: float = 0.3, spread_min: float = 0.3, calm: float = 0.1, often: float = 0.5) -> Column:
    """Struct (route, reason) of a case's metrics by the first rule that holds; ``errors`` are what is wrong with a case that is not intact."""
    rate = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    broken = F.coalesce(F.nullif(F.array_join(errors, ","), F.lit("")), F.lit("integrity_failed")) if errors is not None else F.lit("integrity_failed")
    steady = rate("reward_spread") <= calm
    #: The routes in their order, with their reasons.
    rules = (
        (split == "holdout", "heldout_eval", F.lit("holdout is never promoted into training pools")),
        (~intact, "quarantine", broken),
        (rate("environment_error_rate") >= often, "backtest_gap", F.lit("environment/backtest errors dominate")),
        (rate("parse_error_rate") >= often, "sft_format", F.lit("high JSON parse error rate")),
        (rate("grounding_error_rate") >= often, "sft_grounding", F.lit("high grounding/citation error rate")),
        (rate("tool_error_rate") >= often, "sft_tool", F.lit("high model-caused tool error rate")),
        ((rate("min_reward") >= high) & steady, "all_high_eval", F.lit("already solved with low rollout variance")),
        (F.col("any_success") & (rate("reward_spread") >= spread_min), "rl_main", F.lit("learnable within-group reward variation")),
        (rate("max_step_hit_rate") >= often, "long_trajectory", F.lit("frequent max-step termination")),
        ((rate("max_reward") < high) & steady, "sft_curriculum", F.lit("consistently weak but structurally clean")),
        (rate("max_reward") < low, "more_probe", F.lit("all-low group needs diagnosis")),
        (F.lit(True), "more_probe", F.lit("insufficient evidence for promotion")),
    )
    return F.coalesce(*[F.when(c, F.struct(F.lit(n).alias("route"), r.alias("reason"))) for c, n, r in rules])


def route(split: Column, intact: Column, **bounds: float) -> Column:
    return routed(split, intact, **bounds)["route"]


def best_so_far(results: DataFrame) -> DataFrame:
    """Adds delta: a success's metric over the best before it and the baseline; else 0."""
    good = F.col("ok") & F.col("metric").isNotNull() & F.col("baseline").isNotNull()
    before = F.max(F.when(good, F.col("metric"))).over(W.partitionBy("trajectory").orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
    delta = F.col("metric") - F.greatest(F.col("baseline"), before)
    return results.withColumn("delta", F.when(good, delta).otherwise(0.0))


def clamped(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def evolution_scores(turns: DataFrame) -> DataFrame:
    """(trajectory, subscores, raw, caps, reward) of turns with delta, ok, metric, legal, drifted, novel, crowded, robustness."""
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    s = turns.groupBy("trajectory").agg(
        F.avg(yes(F.col("legal"))).alias("validity"),
        (1 - F.max(yes(F.col("drifted")))).alias("no_drift"),
        (1 - F.max(yes(F.col("crowded")))).alias("protocol"),
        F.avg(yes(F.col("ok") & F.col("metric").isNotNull())).alias("backtest_success"),
        clamped(0.5 + F.max("delta") / 2).alias("performance"),
        clamped(F.coalesce(F.max("robustness"), F.lit(0.5))).alias("robustness"),
        F.avg(yes(F.col("novel"))).alias("novelty"),
    )
    return evolution_reward(s, F.lit(True))


def evolution_reward(subscores: DataFrame, proposed: Column) -> DataFrame:
    """Adds raw, caps and reward; ``proposed`` tells whether there was a candidate, without which none was illegal."""
    raw = sum((F.col(k) * w for k, w in EVOLVE_WEIGHTS.items()), F.lit(0.0))
    caps = compacted(("multi_tool_per_step_cap", F.col("protocol") == 0), ("illegal_expr_cap", proposed & (F.col("validity") < 1)), ("spec_drift_cap", F.col("no_drift") == 0))
    s = subscores.withColumns({"raw": raw, "caps": caps})
    return s.withColumn("reward", capped(F.col("raw"), F.col("caps"), EVOLVE_CAPS))


def robustness(metric: Column, lagged: Column, dealt: Column) -> Column:
    """How little a lag moves the metric and how little a random signal scores; a contrast that failed counts 0, no metric 0.5."""
    scale = F.greatest(F.abs(metric), F.lit(0.1))
    part = lambda c: F.coalesce(F.when(c.isNotNull(), F.greatest(F.lit(0.0), 1 - c)), F.lit(0.0))
    return F.when(metric.isNull(), 0.5).otherwise((part(F.abs(metric - lagged) / scale) + part(F.abs(dealt) / scale)) / 2)


def spec_drift(seed: Column, now: Column, fields: tuple = ("universe", "frequency", "neutralization")) -> Column:
    return compacted(*[(f, seed[f] != now[f]) for f in fields])


def eval_window(pairs: DataFrame) -> DataFrame:
    """Medians of pairs (seed, evolved) that both have a metric, and the share of them that improved."""
    scored_ = F.col("seed").isNotNull() & F.col("evolved").isNotNull()
    own = pairs.select(*[F.when(scored_, c).alias(n) for n, c in (("median_seed_metric", F.col("seed")), ("median_evolved_metric", F.col("evolved")), ("median_delta", F.col("evolved") - F.col("seed")))])
    delta = F.col("median_delta")
    out = own.agg(F.count("*").alias("n"), F.count(delta).alias("n_scored"), F.coalesce(F.avg((delta > 0).cast("double")), F.lit(0.0)).alias("improved_share"))
    out = out.crossJoin(F.broadcast(exact_medians(own, *own.columns)))  # one row each
    return out.select("n", "n_scored", *own.columns, "improved_share")


#: The periods of search, score and evaluation.
PERIODS = {"search": ("2018-01-01", "2021-12-31"), "score": ("2022-01-01", "2023-12-31"), "eval": ("2024-01-01", "2024-12-31")}


def eval_pairs(results: DataFrame) -> DataFrame:
    """(case_id, seed, evolved, delta, ok, error) of results (case_id, side, ok, metric, error), side seed or evolved."""
    side = lambda name, c: F.max(F.when(F.col("side") == name, c))
    good = F.when(F.col("ok"), F.col("metric"))
    rows = results.groupBy("case_id").agg(
        side("seed", good).alias("seed"), side("evolved", good).alias("evolved"), side("seed", F.col("error")).alias("_a"), side("evolved", F.col("error")).alias("_b")
    )
    errors = [F.nullif(F.col(c), F.lit("")) for c in ("_a", "_b")]
    delta = F.col("evolved") - F.col("seed")
    return rows.select("case_id", "seed", "evolved", delta.alias("delta"), delta.isNotNull().alias("ok"), F.concat_ws("; ", *errors).alias("error"))


def latest_success(log: DataFrame, keys: list[str]) -> DataFrame:
    """The newest good entry of each key of a run log."""
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("entry_id")))
    return log.where("ok").withColumn("_n", newest).where("_n = 1").drop("_n")


def response_mask(segments: Column) -> tuple[Column, Column]:
    """(token ids, mask) of segments: 1 for the model's own tokens."""
    ids = F.flatten(F.transform(segments, lambda s: s["token_ids"]))
    own = F.flatten(F.transform(segments, lambda s: F.transform(s["token_ids"], lambda _: F.when(s["type"] == "model", 1).otherwise(0))))
    return ids, own


def valid_mask(ids: Column, mask: Column, *logs: Column) -> Column:
    """Whether a response mask fits: equal lengths, not empty, only 0 and 1, some 1."""
    good = (F.size(mask) > 0) & (F.size(ids) == F.size(mask)) & F.forall(mask, lambda m: m.isin(0, 1)) & F.exists(mask, lambda m: m == 1)
    for c in logs:
        good &= F.size(c) == F.size(mask)
    return F.coalesce(good, F.lit(False))


def truncated(values: Column, most: int) -> Column:
    """The first ``most`` entries."""
    return F.slice(values, 1, most)


def sequence_correction(rollout: Column, training: Column, mask: Column, threshold: float = 2.0) -> Column:
    """Struct (log_ratio, raw_ratio, clipped_ratio, was_clipped, mean_abs_logprob_delta) over masked tokens.

    Rows whose mask does not fit the log-probabilities are an error.
    """
    if threshold <= 1:
        raise ValueError("the threshold must be greater than 1")
    rows = F.filter(F.arrays_zip(rollout.alias("r"), training.alias("t"), mask.alias("m")), lambda z: z["m"] == 1)
    each = F.transform(rows, lambda z: z["t"] - z["r"])
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    raw = F.exp(F.least(F.lit(50.0), F.greatest(F.lit(-50.0), total)))
    clipped = F.least(F.lit(float(threshold)), F.greatest(F.lit(1 / threshold), raw))
    mean = F.try_divide(F.aggregate(each, F.lit(0.0), lambda a, x: a + F.abs(x)), F.size(each))
    found = F.struct(
        total.alias("log_ratio"), raw.alias("raw_ratio"), clipped.alias("clipped_ratio"), (clipped != raw).alias("was_clipped"), mean.alias("mean_abs_logprob_delta")
    )
    return F.when(valid_mask(rollout, mask, training), found).otherwise(F.raise_error(F.lit("the response mask does not fit the log-probabilities")))


def correction_report(samples: DataFrame, threshold: float = 2.0, enable: float = 0.02) -> DataFrame:
    """Sample count, mean change, clip rate and whether a correction is advised, with the reason."""
    c = samples.select(sequence_correction(F.col("rollout_log_probs"), F.col("training_log_probs"), F.col("response_mask"), threshold).alias("c"))
    mean = F.coalesce(F.avg("c.mean_abs_logprob_delta"), F.lit(0.0))
    clip = F.coalesce(F.avg(F.col("c.was_clipped").cast("double")), F.lit(0.0))
    out = c.agg(F.count("*").alias("sample_count"), mean.alias("mean_abs_logprob_delta"), clip.alias("clip_rate"))
    advised = (F.col("sample_count") > 0) & (F.col("mean_abs_logprob_delta") >= enable)
    reason = F.when(advised, "systematic rollout/training log-prob gap").otherwise("gap below enable threshold")
    return out.withColumns({"threshold": F.lit(float(threshold)), "recommended": advised, "reason": reason})
