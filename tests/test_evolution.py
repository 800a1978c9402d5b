"""Replayed trajectories against a loop over their calls."""

import json
import random

import pytest

from tessera.operators import evolution, records as R

SEED = {"name": "s", "universe": "CSI500", "frequency": "daily", "neutralization": "none", "rebalance": "weekly", "expr": "RANK($close)", "windows": [], "evidence": []}
CALLS = "trajectory string, step int, turn int, name string, arguments string"
SPEC = "struct<name: string, universe: string, frequency: string, neutralization: string, rebalance: string, expr: string, windows: array<int>, evidence: array<struct<chunk_id: string, quote: string, page_start: int, page_end: int, char_start: int, char_end: int>>>"
SEEDS = f"trajectory string, seed {SPEC}, baseline double, robustness double"
RESULTS = "trajectory string, turn int, ok boolean, metric double, error_source string"


def rewards(spark, calls, results, seeds, rounds):
    s = spark.createDataFrame([(t, tuple(SEED.values()), b, r) for t, b, r in seeds], SEEDS)
    replay = evolution.replayed(spark.createDataFrame(calls, CALLS), s, spark.createDataFrame(results, RESULTS), rounds)
    return replay, {r.trajectory: r for r in evolution.rewarded(replay, s, rounds).collect()}


def by_loop(calls, results, baseline, robust, rounds):
    """(kinds of the calls that count, reward)."""
    kinds, steps, candidates, scores, done = [], [], [], [], 0
    for step in sorted({c[1] for c in calls}):
        if step >= 3 * rounds or done >= rounds:
            break
        for _, _, turn, name, text in sorted((c for c in calls if c[1] == step), key=lambda c: c[2]):
            try:
                given = json.loads(text)
            except ValueError:
                given = {"_raw": text}
            inner = given.get("spec", given)
            made = {**SEED, "name": inner.get("factor_name", "s"), "expr": inner["factor_expr"]} if "factor_expr" in inner else inner if {"name", "universe", "expr", "frequency", "neutralization", "rebalance"} <= set(inner) else None
            kind, legal = None, made is not None and "FOO" not in made["expr"]
            if name not in ("validate_expr", "evaluate_factor"):
                kind = "unknown_tool"
            elif "_raw" in given:
                kind = "unparsable_arguments"
            elif made is None:
                kind = "schema_invalid"
            if made is not None and name == "evaluate_factor":
                if done >= rounds:
                    kind = "budget_exceeded"
                else:
                    done += 1
                    candidates.append((made, legal))
                    scores.append(results.get(turn, (False, None)))
            drift = made is not None and any(made[f] != SEED[f] for f in ("universe", "frequency", "neutralization"))
            kinds.append(kind or ("frozen_field_mutation" if drift else None))
            steps.append(step)
    crowded = len(set(steps)) < len(steps)
    kinds = [k or ("multi_tool_per_step" if steps.count(s) > 1 else None) for k, s in zip(kinds, steps)]
    best, deltas = baseline, []
    for ok, metric in scores:
        if not ok or metric is None or best is None:
            deltas.append(0.0)
            continue
        deltas.append(metric - best)
        best = max(best, metric)
    n = len(candidates)
    drift = any(m[f] != SEED[f] for m, _ in candidates for f in ("universe", "frequency", "neutralization"))
    clamp = lambda x: max(0.0, min(1.0, x))
    parts = {
        "validity": sum(v for _, v in candidates) / n if n else 0.0, "no_drift": 0.0 if drift else 1.0, "protocol": 0.0 if crowded else 1.0,
        "backtest_success": sum(ok and m is not None for ok, m in scores) / n if n else 0.0, "performance": clamp(0.5 + max(deltas, default=0.0) / 2),
        "robustness": clamp(0.5 if robust is None else robust), "novelty": sum(m["expr"].replace(" ", "") != SEED["expr"] for m, _ in candidates) / n if n else 0.0,
    }
    raw = sum(R.EVOLVE_WEIGHTS[k] * v for k, v in parts.items())
    cap = min([1.0] + [0.0] * crowded + [0.15] * bool(n and parts["validity"] < 1) + [0.3] * drift)
    return kinds, min(raw, cap)


def test_against_a_loop(spark):
    r = random.Random(4)
    texts = [json.dumps({"factor_expr": "RANK($open)"}), json.dumps({"spec": {"factor_expr": "RANK( $close )", "factor_name": "g"}}), json.dumps({"spec": SEED}), json.dumps({"factor_expr": "FOO($close)"}), json.dumps({"spec": SEED | {"universe": "CSI300"}}), "{broken", "{}"]
    calls, results, seeds = [], [], []
    for t in range(60):
        turn, name = 0, f"t{t}"
        clean = t % 3 == 0
        for step in range(r.randint(0, 9)):
            for _ in range(1 if clean or r.random() < 0.9 else 2):
                tool = r.choice(["validate_expr", "evaluate_factor", "evaluate_factor"] + ["rm"] * (not clean))
                calls.append((name, step, turn, tool, r.choice(texts[:3] if clean else texts)))
                if tool == "evaluate_factor" and r.random() < 0.9:
                    results.append((name, turn, r.random() < 0.8, r.choice([None, 0.0, round(r.uniform(-1, 2), 3)]), None))
                turn += 1
        seeds.append((name, r.choice([None, 0.1, 0.4]), r.choice([None, 0.0, 0.8])))
    replay, got = rewards(spark, calls, results, seeds, 2)
    kinds = {}
    for x in replay.orderBy("trajectory", "turn").collect():
        kinds.setdefault(x.trajectory, []).append(x.illegal_kind)
    for name, baseline, robust in seeds:
        own = [c for c in calls if c[0] == name]
        want, reward = by_loop(own, {x[1]: (x[2], x[3]) for x in results if x[0] == name}, baseline, robust, 2)
        assert kinds.get(name, []) == want, name
        assert got[name].reward == pytest.approx(reward), name
    assert len({round(x.reward, 3) for x in got.values()}) > 8


def test_drift_is_capped(spark):
    moved = json.dumps({"spec": SEED | {"universe": "CSI300", "expr": "RANK($open)"}})
    replay, got = rewards(spark, [("t", 0, 0, "evaluate_factor", moved)], [("t", 0, True, 9.0, None)], [("t", 0.1, 1.0)], 4)
    assert got["t"].caps == ["spec_drift_cap"] and got["t"].reward == 0.3 and replay.first().illegal_kind == "frozen_field_mutation"
