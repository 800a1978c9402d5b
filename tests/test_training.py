"""Training rows, hooks, parsing of answers, numerals and settings."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import probes as P
from tessera.operators import records as R
from tessera.operators import training as T
from tessera.sources import files

GOLD = {"name": "reversal", "universe": "CSI500", "frequency": "daily", "neutralization": "industry", "rebalance": "weekly", "expr": "INDUSTRY_NEUTRALIZE(-TS_PCTCHANGE($close, 20), $industry)", "windows": [20]}


def cases(spark, tmp_path, *rows):
    path = tmp_path / f"cases-{len(list(tmp_path.iterdir()))}.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return files.cases(spark, str(path))


def case(name="demo", **more):
    return {"case_id": name, "report": "中证500二十日反转 \"x\"\n", "gold": GOLD} | more


def test_sft_row(spark, tmp_path):
    row = T.sft_rows(cases(spark, tmp_path, case())).first()
    whole = GOLD | {"evidence": []}
    assert json.loads(row.response) == whole and row.message_loss_mask == [0, 0, 1, 0, 1]
    assert [m.role for m in row.messages] == ["system", "user", "assistant", "tool", "assistant"]
    call = row.messages[2].tool_calls[0]
    assert (call.id, call.type, call.function.name, call.function.arguments) == ("demo-validate", "function", "validate_factor_spec", json.dumps({"spec": whole}))
    assert row.extra_info.group_id == "demo" and row.extra_info.adapter == "extract_lora" and len(row.prompt) == 2 and not row.enable_thinking
    assert [t["function"]["name"] for t in json.loads(row.tools)] == ["search_report", "read_report_pages", "validate_factor_spec"]


@pytest.mark.parametrize("span, tool, arguments", [({"page_start": 3}, "read_report_pages", {"page_start": 3, "page_end": 3}), ({"page_start": 3, "page_end": 5}, "read_report_pages", {"page_start": 3, "page_end": 5}), ({"char_start": 0}, "search_report", {"query": "二十日反转 \"x\"", "limit": 5})])
def test_sft_row_with_evidence(spark, tmp_path, span, tool, arguments):
    gold = GOLD | {"evidence": [{"chunk_id": "p0-c0000", "quote": "二十日反转 \"x\""} | span]}
    row = T.sft_rows(cases(spark, tmp_path, case(gold=gold))).first()
    assert row.message_loss_mask == [0, 0, 1, 0, 1, 0, 1]
    look = row.messages[2].tool_calls[0].function
    assert look.name == tool and look.arguments == json.dumps(arguments, ensure_ascii=False)
    found = json.loads(row.messages[3].content)
    assert found["ok"] and found["evidence"][0]["quote"] == "二十日反转 \"x\"" and found["evidence"][0]["char_end"] is None
    assert row.messages[3].tool_call_id == row.messages[2].tool_calls[0].id == "demo-read"


def test_evolve_rows(spark, tmp_path):
    rows = cases(spark, tmp_path, case())
    row = T.sft_rows(rows, "evolve").first()
    assert row.data_source == "factor_evolve" and row.message_loss_mask == [0, 0, 1, 0, 1] and row.extra_info.adapter == "evolve_lora"
    assert [c.function.name for m in row.messages for c in m.tool_calls or []] == ["validate_expr"] and row.extra_info.seed.name == "reversal"
    prompt = T.grpo_rows(rows, "evolve").first()
    assert (prompt.extra_info.stage, prompt.extra_info.adapter, prompt.extra_info.agent_name) == ("evolve", "evolve_lora", "factor_evolve_agent")
    with pytest.raises(ValueError, match="unknown stage"):
        T.sft_rows(rows, "other")


def test_grpo_row_scores_its_own_label(spark, tmp_path):
    row = T.grpo_rows(cases(spark, tmp_path, case())).first()
    truth = json.loads(row.reward_model.ground_truth)
    assert truth["report"] == case()["report"] and truth["document"] is None and list(truth) == ["case_id", "report", "gold", "split", "max_steps", "version", "notes", "group_id", "document"]
    assert T.compute_score(row.data_source, json.dumps(GOLD), row.reward_model.ground_truth) >= 0.85
    assert T.compute_score("x", "no record", truth) == 0.0 and T.score_episode({"case": truth}, json.dumps(GOLD)) >= 0.85
    assert T.compute_score("x", json.dumps(GOLD), json.dumps(GOLD)) >= 0.85  # a record alone
    with pytest.raises(Exception, match="no case and no record"):
        T.compute_score("x", json.dumps(GOLD), "{}")


def test_builders_refuse(spark, tmp_path):
    doc = lambda i: {"doc_id": i, "institution": " BankA ", "series": ""}
    with pytest.raises(ValueError, match="group in both"):
        T.grpo_rows(cases(spark, tmp_path, case("a", document=doc("1")), case("b", document=doc("2"), split="holdout")))
    with pytest.raises(ValueError, match="case_id in both"):
        T.sft_rows(cases(spark, tmp_path, case("a"), case("a", split="holdout")))
    with pytest.raises(ValueError, match="does not pass its own check: a"):
        T.sft_rows(cases(spark, tmp_path, case("a", gold=GOLD | {"expr": "FOO($close)"})))
    assert T.sft_rows(cases(spark, tmp_path, case("a", split="holdout"))).count() == 0


def test_groups(spark):
    rows = [("g", "A", "s", "d", "g"), ("", "BankA", "", "d1", "BankA::unknown"), ("", " ", "\tS ", "d1", "unknown::S"), ("", "", None, "d1", "d1"), (None, None, None, "", "case"), ("", "A", "B", "d", "A::B")]
    df = spark.createDataFrame(rows, "g string, i string, s string, d string, want string")
    got = df.select("want", R.group_key(F.col("g"), F.col("i"), F.col("s"), F.col("d"), F.lit("case")).alias("key")).collect()
    assert all(r.key == r.want for r in got)


def test_chinese_reports_ground_their_numbers(spark, tmp_path):
    """A report and a quotation that write the window in Chinese ground it, as digits would."""
    gold = GOLD | {"evidence": [{"chunk_id": "c", "quote": "二十日反转", "page_start": 1}]}
    rows = cases(spark, tmp_path, case(gold=gold))
    other = F.col("gold").withField("expr", F.lit("RANK(TS_MEAN($close, 20))"))
    got = R.scored(rows.withColumn("pred", other)).first()
    assert (got.grounding, got.caps, got.reward) == (1.0, [], pytest.approx(0.92))
    assert rows.select(P.missing_requirements(F.col("gold"))).first()[0] == []
    bad = F.col("gold").withField("evidence", F.transform("gold.evidence", lambda e: e.withField("quote", F.lit("三十日")).withField("chunk_id", F.lit(" "))))
    got = R.scored(rows.withColumn("pred", bad)).first()
    assert got.caps == ["invalid_citation_cap"] and got.cap_reasons == {"invalid_citation_cap": " : quote not found; <no chunk_id>: citation is not anchored to a chunk"}


def test_answers_are_read_and_scored(spark, tmp_path):
    rows = cases(spark, tmp_path, case(gold=GOLD | {"evidence": [{"chunk_id": "c", "quote": "二十日", "page_start": 1}]}))
    text = json.dumps(GOLD | {"windows": ["20"], "evidence": [{"chunk_id": "c", "quote": "二十日", "page_start": "1"}], "more": 1}, ensure_ascii=False)
    answers = {"bare": text, "prose": f"So {text} it is", "fenced": f"```json\n{text}\n```", "broken": text[:-4], "none": "", "half": json.dumps({"name": "x"}), "term": text.replace('"daily"', '"hourly"'), "window": text.replace('["20"]', "[20.5]")}
    given = rows.crossJoin(spark.createDataFrame(list(answers.items()), "kind string, answer string"))
    got = {r.kind: r for r in R.scored(given.withColumn("pred", X.parse_spec(F.col("answer")))).collect()}
    assert {k for k, r in got.items() if r.reward == pytest.approx(1.0)} == {"bare", "prose", "fenced"}
    assert all(got[k].caps == ["invalid_json_cap"] and got[k].reward == 0 for k in ("broken", "none", "half", "term", "window"))


@pytest.mark.parametrize("text, value", [("十", 10), ("二十", 20), ("一百二十", 120), ("二百五", 205), ("二〇二四", 2024), ("零", 0), ("零十", 10), ("两千零五十", 2050), ("百千", 1100), ("一二十三四", 24)])
def test_numerals(spark, text, value):
    assert X.numeral(text) == value
    got = spark.createDataFrame([(f"过去{text}日 7",)], "t string").select(X.numbers_meant(F.col("t")), X.with_numerals("t")).first()
    assert got[0] == [7, value] and got[1] == f"过去{text}({value})日 7"


def test_numerals_of_nothing(spark):
    assert X.numeral("") is None and X.numeral("x") is None
    got = spark.createDataFrame([("",), (None,), ("２０ 20",)], "t string").select(X.numbers_meant(F.col("t"))).collect()
    assert [r[0] for r in got] == [[], None, [20]]


def test_settings():
    assert T.adapter_paths("extract")["grpo_dir"] != T.adapter_paths("evolve")["grpo_dir"] and T.adapter_paths("evolve")["grpo_jsonl"] == "data/rl/evolve_train.jsonl"
    assert T.sft_flags()[0] == "model.lora_rank=32"
    assert T.grpo_flags(adapter_path="checkpoints/evolve_lora/sft")[-1] == "actor_rollout_ref.model.lora_adapter_path=checkpoints/evolve_lora/sft" and len(T.grpo_flags()) == 3
    assert T.correction_flags(False) == [] and "algorithm.rollout_correction.rollout_is_threshold=2.0" in T.correction_flags(True)
    for bad in (lambda: T.adapter_paths("x"), lambda: T.correction_flags(True, 1.0)):
        with pytest.raises(ValueError):
            bad()


def test_correction_refuses_masks_that_do_not_fit(spark):
    rows = spark.createDataFrame([([0.0, 0.0, 0.0], [1.0, 5.0, 1.0], [1, 0, 1])], "r array<double>, t array<double>, m array<int>")
    c = rows.select(R.sequence_correction(F.col("r"), F.col("t"), F.col("m")).alias("c")).first().c
    assert (c.log_ratio, c.clipped_ratio, c.was_clipped, c.mean_abs_logprob_delta) == (2.0, 2.0, True, 1.0)
    for mask in ([0, 0, 0], [1, 0], [1, 2, 0]):
        bad = spark.createDataFrame([([0.0] * 3, [1.0] * 3, mask)], "r array<double>, t array<double>, m array<int>")
        with pytest.raises(Exception, match="does not fit"):
            bad.select(R.sequence_correction(F.col("r"), F.col("t"), F.col("m"))).collect()


def test_routes_and_reasons(spark):
    given = [(0.2, 0.9, 0.7, True, 0.0), (0.1, 0.1, 0.0, False, 0.0), (0.85, 0.9, 0.05, True, 0.0), (0.0, 0.2, 0.2, False, 0.0), (0.0, 0.0, 0.0, False, 1.0)]
    rows = spark.createDataFrame(given, "min_reward double, max_reward double, reward_spread double, any_success boolean, environment_error_rate double")
    zero = {c: F.lit(0.0) for c in ("parse_error_rate", "grounding_error_rate", "tool_error_rate", "max_step_hit_rate")}
    got = rows.withColumns(zero).select(R.routed(F.lit("train"), F.lit(True)).alias("r")).collect()
    assert [g.r.route for g in got] == ["rl_main", "sft_curriculum", "all_high_eval", "more_probe", "backtest_gap"] and got[3].r.reason == "all-low group needs diagnosis"
    lost = rows.withColumns(zero).select(R.routed(F.lit("train"), F.lit(False), F.array(F.lit("a"), F.lit("b"))).alias("r")).first().r
    assert tuple(lost) == ("quarantine", "a,b")
