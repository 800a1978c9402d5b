"""Checks of labelled cases, probes of rollouts, citations, run summaries and tool results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expression import listed
from . import records as R


def none_of(rows: DataFrame, key: str, message: str) -> None:
    """An error that names the first five keys, if there are rows."""
    found = [str(r[0]) for r in rows.select(key).orderBy(key).limit(5).collect()]
    if found:
        raise ValueError(f"{message} {', '.join(found)}")


def case_group() -> Column:
    """The group of a case as ``files.cases`` reads it."""
    d = F.col("document")
    return R.group_key(F.col("group_id"), d["institution"], d["series"], d["doc_id"], F.col("case_id"))


def _listed(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(values), lambda v: v.cast("string")), ", "), F.lit("]"))


#: The messages about a label, which are results; a list follows but the first.
EVIDENCE, DECLARED, CITED, PLACED = "no evidence span", "expression parameters not declared in windows: ", "parameters without a citation: ", "spans without chunk/page locator: "


def missing_requirements(spec: Column) -> Column:
    """What a label lacks, as messages: evidence, declared windows, citations, places."""
    declared, cited, placed = R.undeclared(spec), R.uncited(spec), R.unlocated(spec)
    quoted = F.concat(F.lit("['"), F.array_join(placed, "', '"), F.lit("']"))
    messages = (
        F.when(F.size(spec["evidence"]) == 0, F.lit(EVIDENCE)),
        F.when(F.size(declared) > 0, F.concat(F.lit(DECLARED), _listed(declared))),
        F.when(F.size(cited) > 0, F.concat(F.lit(CITED), _listed(cited))),
        F.when(F.size(placed) > 0, F.concat(F.lit(PLACED), quoted)),
    )
    return F.array_compact(F.array(*messages))


def replayed() -> Column:
    """Whether a scored gold record passes the gate with itself as the answer."""
    return R.passes_gate(F.col("reward"), F.col("caps"), listed(F.col("gold.expr"))["ok"])


def integrity(cases: DataFrame) -> DataFrame:
    """Adds gold_reward, errors and intact: does the label score itself, is its document hashed, are its quotes in the report.

    ``cases`` have report, gold and, if known, document.
    """
    rows = R.scored(cases.withColumn("pred", F.col("gold")))
    replay = replayed()
    hashless = F.coalesce(F.col("document.content_hash") == "", F.lit(False)) if "document" in cases.columns else F.lit(False)
    unquoted = F.exists(F.col("gold.evidence"), lambda e: ~F.contains(F.col("report"), e["quote"]))
    errors = R.compacted(("gold_replay_failed", ~replay), ("missing_document_hash", hashless), ("gold_citation_not_in_report", unquoted))
    return rows.withColumns({"gold_reward": F.col("reward"), "errors": errors}).withColumn("intact", F.size("errors") == 0).select(*cases.columns, "gold_reward", "errors", "intact")


def planned_rollouts(checked: DataFrame, k: int = 4) -> DataFrame:
    """The k rollouts that each intact case gets, as rows with ``rollout``."""
    if k < 1:
        raise ValueError("k must be positive")
    return checked.where("intact").withColumn("rollout", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def probed(checked: DataFrame, rollouts: DataFrame) -> DataFrame:
    """Every case with the metrics of its rollouts and its route; cases that are not intact have none."""
    metrics = R.group_metrics(rollouts)
    found = checked.join(metrics, "case_id", "left").withColumn("any_success", F.coalesce("any_success", F.lit(False)))
    return found.withColumns({c: R.routed(F.col("split"), F.col("intact"), F.col("errors"))[c] for c in ("route", "reason")})


def citation_errors(specs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, quote) of evidence whose chunk is unknown or does not hold the quote.

    ``specs`` have doc_id and a record ``spec``; ``chunks`` doc_id, chunk_id and text.
    """
    spans = specs.select("doc_id", F.explode("spec.evidence").alias("e")).select("doc_id", F.col("e.chunk_id").alias("chunk_id"), F.col("e.quote").alias("quote"))
    found = spans.join(chunks.select("doc_id", "chunk_id", F.col("text").alias("_text")), ["doc_id", "chunk_id"], "left")
    return found.where("_text is null or not contains(_text, quote)").drop("_text")


def page_range(chunks: DataFrame, first: int, last: int) -> DataFrame:
    """Chunks that begin on the pages; chunks without a page are not among them."""
    return chunks.where(F.col("page_start").between(first, last))


def run_summary(records: DataFrame, routed: DataFrame | None = None) -> DataFrame:
    """One row: rollouts, cases, rewards, tool calls, and tallies of caps, illegal kinds and routes.

    Each record gives one row of its own and one for each entry of its tallies,
    all counted by (tally, key) in one aggregate, so the records are read once
    whatever is tallied.  The tallies' keys are from closed lists, so what is
    put together at the end are some ten rows.
    """
    entry = lambda t, k, n, r: F.struct(F.lit(t).alias("t"), k.alias("k"), n.cast("long").alias("n"), r.alias("r"))
    own = F.struct(F.coalesce("reward", F.lit(0.0)).alias("reward"), "tool_calls", "illegal_tool_calls", "case_id")
    none = F.when(F.lit(False), own)
    some = lambda c, t: F.coalesce(c, F.array().cast(t))
    caps = F.transform(some(F.col("active_caps"), "array<string>"), lambda c: entry("hard_cap_distribution", c, F.lit(1), none))
    kinds = F.transform(some(F.map_entries("illegal_by_kind"), "array<struct<key: string, value: long>>"), lambda e: entry("illegal_tool_call_kinds", e["key"], e["value"], none))
    rows = records.select(F.explode(F.concat(F.array(entry("", F.lit(""), F.lit(1), own)), caps, kinds)).alias("e")).select("e.*")
    names = ["hard_cap_distribution", "illegal_tool_call_kinds"]
    if routed is not None:
        names.append("route_distribution")
        rows = rows.unionByName(routed.select(F.lit(names[-1]).alias("t"), F.col("route").alias("k"), F.lit(1).cast("long").alias("n")), allowMissingColumns=True)
    figures = {n: f("r.reward") for n, f in (("mean_reward", F.avg), ("reward_std", F.stddev_pop), ("min_reward", F.min), ("max_reward", F.max))}
    sums = {c: F.sum(f"r.{c}") for c in ("tool_calls", "illegal_tool_calls")}
    counts = {"rollout_count": F.count("r"), "case_count": F.count_distinct("r.case_id")}
    found = rows.groupBy("t", "k").agg(F.sum("n").alias("n"), *[c.alias(n) for n, c in (counts | figures | sums).items()])
    of = lambda name, zero: F.coalesce(F.max(F.when(F.col("t") == "", F.col(name))), F.lit(zero)).alias(name)
    tally = lambda name: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("t") == name, F.struct("k", "n"))))).alias(name)
    out = found.agg(*[of(c, 0) for c in counts], *[of(c, 0.0) for c in figures], *[of(c, 0) for c in sums], *[tally(c) for c in names])
    rate = F.coalesce(F.try_divide("illegal_tool_calls", "tool_calls"), F.lit(0.0)).alias("illegal_tool_call_rate")
    return out.select(*counts, *figures, *sums, rate, *names)


#: The metrics that an evaluation report shows.
REPORTED = ("Information_Ratio_with_cost", "annualized_return_with_cost", "turnover", "max_drawdown")


def reported(metrics: Column) -> Column:
    """The entries of a map of metrics that a report shows."""
    return F.map_filter(metrics, lambda k, v: k.isin(*REPORTED))


def metric_result(metrics: Column, period: str) -> Column:
    """Struct (ok, metric, period, metrics, error, error_source) of a map of texts, as a backtest service answers.

    The metric is ``Information_Ratio_with_cost``, else ``IR``; entries that are no numbers go.
    """
    read = F.transform_values(metrics, lambda k, v: v.try_cast("double"))
    value = F.coalesce(read["Information_Ratio_with_cost"], read["IR"])
    found = value.isNotNull()
    return F.struct(
        found.alias("ok"),
        value.alias("metric"),
        F.lit(period).alias("period"),
        F.map_filter(read, lambda k, v: v.isNotNull()).alias("metrics"),
        F.when(found, "").otherwise("Information_Ratio_with_cost missing").alias("error"),
        F.when(~found, "environment").alias("error_source"),
    )


def best_candidate(turns: DataFrame) -> DataFrame:
    """(trajectory, turn, metric) of the best success; the first turn on a tie."""
    good = turns.where(F.col("ok") & F.col("metric").isNotNull())
    best = F.max_by(F.struct("turn", "metric"), F.struct(F.col("metric"), -F.col("turn")))
    return good.groupBy("trajectory").agg(best.alias("b")).select("trajectory", "b.turn", "b.metric")


def adjustment_dates(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Both edges of the period and the ends of June and December within."""
    years = F.sequence(F.year(start), F.year(end))
    ends = F.flatten(F.transform(years, lambda y: F.array(F.make_date(y, F.lit(6), F.lit(30)), F.make_date(y, F.lit(12), F.lit(31)))))
    inner = F.filter(ends, lambda d: d.between(F.col(start), F.col(end)))
    return rows.select(F.explode(F.array_distinct(F.concat(F.array(start, end), inner))).alias("date")).distinct()
