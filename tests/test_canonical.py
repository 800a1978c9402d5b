"""Canonical JSON of columns against Python's own."""

import json
import math
import random
import struct

from pyspark.sql import functions as F

from tessera.functions.canonical import with_hash, with_json
from tessera.sources import service, sinks


def dumped(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_numbers(spark):
    r = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.5, 1e16, 1e15, 123456789012345680.0, 9999999999999998.0, 1e-4, 1e-5, 0.00012345, 2e-3, 1e23, 9.999999999999999e22, 5e-324, 1.7976931348623157e308, 2.0**-44, 2.2e-322, 100.0, 1e7, 1.1e7, 0.1 + 0.2, math.inf, -math.inf, math.nan]
    values += [2.0**i for i in range(-1074, 1024, 7)] + [struct.unpack("<d", r.randbytes(8))[0] for _ in range(3000)] + [r.uniform(-1, 1) * 10 ** r.randint(-8, 20) for _ in range(2000)] + [round(r.uniform(0, 1e6), r.randint(0, 6)) for _ in range(1000)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {x.i: x.t for x in with_json(rows, "v", "t").collect()}
    assert [(v, got[i]) for i, v in enumerate(values) if got[i] != dumped(v)] == []


def test_nested_records(spark):
    """Keys in any order, nulls at any depth, every control character, text beyond the basic plane."""
    texts = ["", "plain", 'quo"te', "back\\slash \\u000B", "é漢😀", "".join(map(chr, range(32))), "\x7f\u2028/", None]
    schema = "struct<z: string, a: struct<n: bigint, m: map<string, array<double>>, b: boolean>, list: array<struct<y: int, x: string>>, f: float>"
    made = []
    for i, t in enumerate(texts):
        a = None if i == 3 else {"n": None if i % 2 else -(2**63) + i, "m": None if i == 1 else {"é": [1.5, None], "Z": [], "a" + (t or ""): None}, "b": i % 2 == 0}
        made.append({"z": t, "a": a, "list": None if i == 2 else [{"y": i, "x": t}, None], "f": 0.1 * i})
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(made)], f"i int, v {schema}")
    got = with_hash(with_json(rows, "v", "t"), "v", "h").collect()
    for r in got:
        value = r.v.asDict(True)
        assert r.t == dumped(value) and r.h == sinks.stable_hash(value)


def test_identities_of_many_calls(spark):
    """The hashes of a run log for a table of calls are those of the client's single calls."""
    config, specs = service.ClientConfig(), [{"name": f"f{i}", "expr": f"RANK($close) * {i}", "universe": "CSI300", "rebalance": "weekly", "neutralization": "none"} for i in range(5)]
    client = service.ServiceClient(spark, "unused", config)
    sent = [config.payload(s, "2024-01-01", "2024-02-01") for s in specs]
    want = [client.identity(s, "score", p) for s, p in zip(specs, sent)]
    settings = "struct<endpoint: string, metric: string, timeout_seconds: double, start_cash: double, label_forward_days: int, stop_loss_rate: double, stop_profit_rate: double, max_pos_each_stock: double, use_cache: boolean>"
    asked = "struct<start_cash: double, label_forward_days: int, stop_loss_rate: double, stop_profit_rate: double, max_pos_each_stock: double, use_cache: boolean, exprs: map<string, string>, backtest_start_time: string, backtest_end_time: string, stock_pool: string, update_freq: int, position_size: double, layer_start: int, layer_end: int, industry_neutralization: string, pred_score_industry_neutralization: boolean>"
    rows = spark.createDataFrame([(s["name"], s["expr"], config.__dict__, p) for s, p in zip(specs, sent)], f"name string, expr string, config {settings}, payload {asked}")
    got = sinks.identified(rows.withColumn("spec", F.struct("name", "expr"))).orderBy("name").collect()
    assert [(r.expression_hash, r.config_hash) for r in got] == [(w["expression_hash"], w["config_hash"]) for w in want]
