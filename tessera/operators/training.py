"""Training rows out of labelled cases, the rewards of answers, and the settings of two adapters.

``cases`` are as ``files.cases`` reads them.  Rows are built from columns alone;
the only actions are the checks that refuse a set (a few keys reach the driver).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import dumps, parse_spec, read_spec
from . import probes as P
from . import records as R

#: The prompts.
EXTRACT_SYSTEM = """You extract a stock-selection factor from a Chinese research note.
Output ONLY a JSON object with keys:
  name, universe, frequency, neutralization, rebalance, expr, windows, evidence
frequency/rebalance: daily | weekly | monthly
neutralization: none | industry | size | industry_size
expr uses $close/$volume/... and RANK, TS_MEAN, TS_STD, TS_PCTCHANGE, INDUSTRY_NEUTRALIZE, COUNT.
evidence is a list of source citations with chunk_id and exact quote.
Do not invent fields that are not in the note.
"""
EVOLVE_SYSTEM = """You propose a small mutation of a factor that already passed extraction.
Keep universe, frequency, and neutralization. You may change windows or operators.
Use one tool per assistant turn. Validate the expression before calling evaluate_factor.
The visible tool result uses the search window. A hidden score window determines reward.
"""
EXTRACT_USER = ("Report:\n", "\n\nOutput FactorSpec JSON only.")
EVOLVE_SFT_USER = ("Seed spec:\n", "\nKeep universe, frequency, and neutralization. Validate the expression, then return the FactorSpec JSON.")
EVOLVE_GRPO_USER = ("Seed FactorSpec:\n", "\nImprove it without changing frozen fields.")
#: What the tools answer in a replayed label.
VALIDATED = '{"ok": true, "expr_ok": true, "citation_errors": []}'
LEGAL = '{"ok": true, "message": "ok", "source": "model"}'

_TERM = {"enum": ["daily", "weekly", "monthly"]}
_SPAN_SCHEMA = {
    "type": "object",
    "properties": {"chunk_id": {"type": "string"}, "quote": {"type": "string"}} | {c: {"type": ["integer", "null"]} for c in ("page_start", "page_end", "char_start", "char_end")},
    "required": ["chunk_id", "quote"],
}
_SPEC_SCHEMA = {
    "type": "object",
    "properties": {"name": {"type": "string"}, "universe": {"type": "string"}, "frequency": _TERM, "neutralization": {"enum": ["none", "industry", "size", "industry_size"]}}
    | {"rebalance": _TERM, "expr": {"type": "string"}, "windows": {"type": "array", "items": {"type": "integer"}}, "evidence": {"type": "array", "items": _SPAN_SCHEMA}},
    "required": ["name", "universe", "frequency", "neutralization", "rebalance", "expr"],
}


def _tool(name: str, description: str, required: list[str], **properties) -> dict:
    return {"type": "function", "function": {"name": name, "description": description, "parameters": {"type": "object", "properties": properties, "required": required}}}


_WHOLE = {"type": "integer"}
#: Names, descriptions and arguments of the tools of either stage.
REPORT_TOOLS = [
    _tool("search_report", "Search normalized report chunks for a literal query.", ["query"], query={"type": "string"}, limit={"type": "integer", "default": 5}),
    _tool("read_report_pages", "Read chunks overlapping a page range.", ["page_start", "page_end"], page_start=_WHOLE, page_end=_WHOLE),
    _tool("validate_factor_spec", "Validate FactorSpec schema, expression whitelist, declarations, and citations.", ["spec"], spec={"type": "object"}),
]
EVOLVE_TOOLS = [
    _tool("validate_expr", "Validate a complete mutated FactorSpec before backtesting.", ["spec"], spec=_SPEC_SCHEMA),
    _tool("evaluate_factor", "Backtest one complete FactorSpec on the visible search window.", ["spec"], spec=_SPEC_SCHEMA),
]
TOOLS = {"extract": REPORT_TOOLS, "evolve": EVOLVE_TOOLS}
STAGES = ("extract", "evolve")

_CALL = "struct<id: string, type: string, function: struct<name: string, arguments: string>>"


def tool_names(tools: list[dict]) -> list[str]:
    return [t["function"]["name"] for t in tools]


def spec_json(spec: Column) -> Column:
    """The record as one line of JSON: every field, nulls explicit, no blanks."""
    return F.to_json(spec, {"ignoreNullFields": "false"})


def _message(role: str, content: Column, calls: Column | None = None, answers: Column | None = None, name: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(role).alias("role"),
        content.alias("content"),
        (none if calls is None else F.array(calls)).cast(f"array<{_CALL}>").alias("tool_calls"),
        (none if answers is None else answers).cast("string").alias("tool_call_id"),
        (none if name is None else name).cast("string").alias("name"),
    )


def _call(call_id: Column, name: Column, arguments: Column) -> Column:
    return F.struct(call_id.alias("id"), F.lit("function").alias("type"), F.struct(name.alias("name"), arguments.alias("arguments")).alias("function"))


def _around(frame: tuple[str, str], inner: Column) -> Column:
    return F.concat(F.lit(frame[0]), inner, F.lit(frame[1]))


def _prompt(stage: str, user: Column) -> list[Column]:
    return [_message("system", F.lit(EXTRACT_SYSTEM if stage == "extract" else EVOLVE_SYSTEM)), _message("user", user)]


def _pair(prompt: list[Column]) -> Column:
    return F.array(*[F.struct(m["role"].alias("role"), m["content"].alias("content")) for m in prompt])


def _usable(cases: DataFrame, stage: str) -> DataFrame:
    """The training cases, after the checks: no key or group in both splits."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    rows = cases.withColumn("group", P.case_group())
    R.assert_no_leak(rows, "case_id")
    R.assert_no_leak(rows, "group")
    return rows.where("split = 'train'")


def sft_rows(cases: DataFrame, stage: str = "extract") -> DataFrame:
    """Supervised rows of the training cases: messages with tool calls, and which of them are trained on.

    extract: prompt, a look into the report if the label has evidence, the
    check of the record, the record.  evolve: the seed, its check, the seed
    again.  A label that does not score itself, a key or a group in both splits
    is an error.
    """
    rows = _usable(cases, stage)
    P.none_of(R.scored(rows.withColumn("pred", F.col("gold"))).where(~P.replayed()), "case_id", "the label does not pass its own check:")
    gold, kind = F.col("gold"), cases.schema["gold"].dataType
    text = spec_json(gold)
    payload = F.concat(F.lit('{"spec": '), dumps(gold, kind), F.lit("}"))
    answer = _message("assistant", text)
    if stage == "extract":
        prompt = _prompt(stage, _around(EXTRACT_USER, F.col("report")))
        first = F.try_element_at(gold["evidence"], F.lit(1))
        paged = first["page_start"].isNotNull()
        last = F.coalesce(F.nullif(first["page_end"], F.lit(0)), first["page_start"])
        pages = F.format_string('{"page_start": %d, "page_end": %d}', first["page_start"], last)
        asked = F.concat(F.lit('{"query": '), dumps(F.substring(first["quote"], 1, 32), T.StringType()), F.lit(', "limit": 5}'))
        tool = F.when(paged, "read_report_pages").otherwise("search_report")
        read_id, check_id = (F.concat("case_id", F.lit(e)) for e in ("-read", "-validate"))
        found = F.concat(F.lit('{"ok": true, "evidence": '), dumps(gold["evidence"], kind["evidence"].dataType), F.lit("}"))
        read = [_message("assistant", F.lit(""), _call(read_id, tool, F.when(paged, pages).otherwise(asked))), _message("tool", found, None, read_id, tool)]
        name = F.lit("validate_factor_spec")
        check = [_message("assistant", F.lit(""), _call(check_id, name, payload)), _message("tool", F.lit(VALIDATED), None, check_id, name)]
        cited = F.size(gold["evidence"]) > 0
        messages = F.when(cited, F.array(*prompt, *read, *check, answer)).otherwise(F.array(*prompt, *check, answer))
        mask = F.when(cited, F.array(*map(F.lit, (0, 0, 1, 0, 1, 0, 1)))).otherwise(F.array(*map(F.lit, (0, 0, 1, 0, 1))))
    else:
        prompt = _prompt(stage, _around(EVOLVE_SFT_USER, text))
        check_id, name = F.concat("case_id", F.lit("-validate-expr")), F.lit("validate_expr")
        check = [_message("assistant", F.lit(""), _call(check_id, name, payload)), _message("tool", F.lit(LEGAL), None, check_id, name)]
        messages, mask = F.array(*prompt, *check, answer), F.array(*map(F.lit, (0, 0, 1, 0, 1)))
    info = ["case_id", F.col("group").alias("group_id"), "split", F.lit(stage).alias("stage")]
    info += [gold.alias("seed")] if stage == "evolve" else []
    return rows.select(
        F.lit(f"factor_{stage}").alias("data_source"),
        _pair(prompt).alias("prompt"),
        text.alias("response"),
        messages.alias("messages"),
        F.lit(json.dumps(TOOLS[stage], ensure_ascii=False)).alias("tools"),
        F.lit(False).alias("enable_thinking"),
        mask.alias("message_loss_mask"),
        F.struct(*info, F.lit(f"{stage}_lora").alias("adapter")).alias("extra_info"),
    )


#: Of a manifest's entry, what a prompt row carries along.
ENTRY = ("case_path", "report_snapshot_path", "verifier_spec_path", "gold_path", "content_hashes")


def grpo_rows(cases: DataFrame, stage: str = "extract", manifest: DataFrame | None = None) -> DataFrame:
    """Prompt rows of the training cases with the whole case as ground truth.

    ``manifest`` (entries as ``sinks.write_batch`` returns them) adds the paths
    and hashes of a case's files; a case without an entry has nulls there.
    """
    rows = _usable(cases, stage)
    gold, names = F.col("gold"), [c for c in cases.columns]
    info = ["case_id", "group_id", "split", F.lit(stage).alias("stage"), F.lit(f"{stage}_lora").alias("adapter")]
    if stage == "extract":
        prompt = _prompt(stage, _around(EXTRACT_USER, F.col("report")))
    else:
        prompt = _prompt(stage, _around(EVOLVE_GRPO_USER, spec_json(gold)))
        info += [gold.alias("seed"), F.lit("factor_evolve_agent").alias("agent_name")]
    if manifest is not None:
        kept = [c for c in ENTRY if c in manifest.columns]
        entries = manifest.select(F.col("case_id").alias("_entry"), F.struct(*kept).alias("_files"))
        rows = rows.join(entries, rows.case_id == entries["_entry"], "left")
        info += [F.col("_files")[c].alias(c) for c in kept]
    whole = dumps(F.struct(*names), T.StructType([cases.schema[c] for c in names]))
    return rows.select(
        F.lit(f"factor_{stage}").alias("data_source"),
        _pair(prompt).alias("prompt"),
        F.struct(whole.alias("ground_truth"), F.lit("factor_rule_verifier").alias("name")).alias("reward_model"),
        F.lit(json.dumps(TOOLS[stage], ensure_ascii=False)).alias("tools"),
        F.struct(*info).alias("extra_info"),
    )


def answer_scores(rows: DataFrame, answer: str = "solution_str", truth: str = "ground_truth") -> DataFrame:
    """``rows`` with the columns of :func:`records.scored` for a text and the JSON of its case.

    The JSON is a case, or a record alone (then the report is empty).  One that
    is neither is an error.
    """
    field = lambda c: F.get_json_object(F.col(truth), f"$.{c}")
    gold = read_spec(F.coalesce(field("gold"), F.col(truth)))
    refused = F.raise_error(F.lit("the ground truth is no case and no record")).cast(T.StringType())
    report = F.when(gold.isNull(), refused).otherwise(F.coalesce(field("report"), F.lit("")))
    return R.scored(rows.withColumns({"report": report, "gold": gold, "pred": parse_spec(F.col(answer))}))


def compute_score(data_source, solution_str: str, ground_truth, extra_info=None) -> float:
    """The reward of one answer, as trainers' hooks call it; of many, use :func:`answer_scores`."""
    spark = SparkSession.active()
    truth = ground_truth if isinstance(ground_truth, str) else json.dumps(ground_truth, ensure_ascii=False)
    rows = spark.createDataFrame([(solution_str, truth)], "solution_str string, ground_truth string")
    return float(answer_scores(rows).first().reward)


def score_episode(task: dict, solution_str: str) -> float:
    """The reward of one answer to a task that holds its case."""
    return compute_score("factor_extract", solution_str, task["case"])


def echoed(cases: DataFrame) -> DataFrame:
    """Cases with ``answer``, the label itself, as a provider that knows it would give."""
    return cases.withColumn("answer", spec_json(F.col("gold")))


def dry_run(cases: DataFrame, gate: float = 0.7) -> DataFrame:
    """Each case's echoed answer, read, scored and held against the gate."""
    rows = R.scored(echoed(cases).withColumn("pred", parse_spec(F.col("answer"))))
    legal = R.listed(F.col("pred.expr"))["ok"]
    return rows.withColumn("passed", F.col("pred").isNotNull() & R.passes_gate(F.col("reward"), F.col("caps"), legal, gate))


def holdout_report(cases: DataFrame, split: str = "holdout") -> DataFrame:
    """:func:`records.summarized_by_group` of a split's labels, scored with themselves."""
    rows = cases.where(F.col("split") == split).withColumns({"pred": F.col("gold"), "_group": P.case_group()})
    return R.summarized_by_group(R.scored(rows), F.col("_group"))


#: Rank, alpha and target of the adapters.
RANK, ALPHA, TARGET = 32, 64, "all-linear"


def adapter_paths(stage: str) -> dict[str, str]:
    """Where the rows and checkpoints of a stage's adapter lie; the stages share none."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    out = {"adapter_name": f"{stage}_lora"}
    for kind, folder in (("sft", "sft"), ("grpo", "rl")):
        out |= {f"{kind}_{form}": f"data/{folder}/{stage}_train.{form}" for form in ("jsonl", "parquet")}
        out[f"{kind}_dir"] = f"checkpoints/{stage}_lora/{kind}"
    return out


def _adapter_flags(prefix: str, rank: int, alpha: int, target: str) -> list[str]:
    return [f"{prefix}.{k}={v}" for k, v in (("lora_rank", rank), ("lora_alpha", alpha), ("target_modules", target))]


def sft_flags(rank: int = RANK, alpha: int = ALPHA, target: str = TARGET) -> list[str]:
    return _adapter_flags("model", rank, alpha, target)


def grpo_flags(rank: int = RANK, alpha: int = ALPHA, target: str = TARGET, adapter_path: str = "") -> list[str]:
    prefix = "actor_rollout_ref.model"
    return _adapter_flags(prefix, rank, alpha, target) + ([f"{prefix}.lora_adapter_path={adapter_path}"] if adapter_path else [])


def correction_flags(enabled: bool, threshold: float = 2.0) -> list[str]:
    """Settings of the sequence correction, none if it is off."""
    if not enabled:
        return []
    if threshold <= 1:
        raise ValueError("the threshold must be greater than 1")
    #: The trainer's setting names.
    settings = {"rollout_is": "sequence", "rollout_is_threshold": threshold, "rollout_is_batch_normalize": False, "bypass_mode": False}
    return ["actor_rollout_ref.rollout.calculate_log_probs=True"] + [f"algorithm.rollout_correction.{k}={v}" for k, v in settings.items()]
