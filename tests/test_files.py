"""Readers and writers: round trips, defaults, refusals."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import probes as P
from tessera.operators import records as R
from tessera.sources import files, sinks

SPEC = {"name": "f", "universe": "CSI300", "frequency": "daily", "neutralization": "none", "rebalance": "monthly", "expr": "RANK($close / TS_MEAN($close, 20))", "windows": ["20", 5], "odd": 1}
SPAN = {"chunk_id": "p0-c0000", "quote": "over 20 and 5 days", "page_start": 0}


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_cases(spark, tmp_path):
    path = lines(tmp_path / "c.jsonl", {"case_id": "a", "report": "r", "gold": SPEC, "split": "holdout"}, "", {"id": "b", "report": "r", "spec": SPEC}, {"caseId": "c", "gold": SPEC}, {"id": "", "gold": SPEC})
    got = {r.case_id: r for r in files.cases(spark, path).collect()}
    assert sorted(got) == ["a", "b", "c", "unknown"]
    assert got["a"].split == "holdout" and got["b"].split == "train" and got["b"].max_steps == 4
    assert got["b"].gold.windows == [20, 5] and got["b"].gold.evidence == []
    assert files.cases(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(Exception):
        files.cases(spark, lines(tmp_path / "bad.jsonl", "{broken")).collect()


def test_reports(spark, tmp_path):
    (tmp_path / "a.md").write_text("二十日\n均线", encoding="utf-8")
    (tmp_path / "b.txt").write_text("x" * 2000, encoding="utf-8")
    got = {r.source_format: r for r in files.reports(spark, str(tmp_path)).collect()}
    assert got["markdown"].text == "二十(20)日\n均线" and got["markdown"].content_hash.startswith(got["markdown"].doc_id)
    cut = files.report_chunks(files.reports(spark, str(tmp_path))).where(F.length("text") > 100).orderBy("char_start").collect()
    assert [(c.chunk_id, c.char_start, c.char_end) for c in cut] == [("p0-c0000", 0, 1800), ("p0-c0001", 1600, 2000)]


def test_market_csv(spark, tmp_path):
    head = "date,code,open,high,low,close,volume,amount,pctChg,tradestatus,isST"
    lines(tmp_path / "p.csv", head, "2020-01-02,SH.600001,1,2,0.5,1.5,10,,2.5,1,", "2020-01-02,SH.600001,1,2,0.5,1.5,10,,2.5,1,", "2020-01-03,sh.600001,x,2,1,1,0,0,0,0,1")
    rows = files.prices(spark, str(tmp_path / "p.csv")).orderBy("datetime").collect()
    assert [(str(r.datetime), r.instrument, r.open, r.amount, r["return"], r.tradestatus, r.isST) for r in rows] == [("2020-01-02", "sh600001", 1, None, 0.025, 1, 0), ("2020-01-03", "sh600001", None, 0, 0, 0, 1)]
    lines(tmp_path / "m.csv", "universe,date,instrument", "CSI300,,a", "CSI300,2020-01-01,a", "CSI300,2020-12-28,b")
    lines(tmp_path / "i.csv", "date,instrument,industry", "2020-01-31,a,x", "2020-12-31,a,y")
    m = files.snapshots(spark, str(tmp_path / "m.csv"), "universe", "date", "instrument", asked="2020-01-01")
    i = files.snapshots(spark, str(tmp_path / "i.csv"), "date", "instrument", "industry")
    assert m.count() == 2
    assert files.snapshots_cover(m, i, "2020-01-01", "2020-12-31", ["CSI300"])
    assert not files.snapshots_cover(m, i, "2019-01-01", "2020-12-31", ["CSI300"])
    assert not files.snapshots_cover(m, i, "2020-01-01", "2021-02-01", ["CSI300"])
    assert not files.snapshots_cover(m, i, "2020-01-01", "2020-12-31", ["CSI300", "CSI500"])
    assert not files.snapshots_cover(m.drop("date"), i, "2020-01-01", "2020-12-31", ["CSI300"])


def test_fetched(spark, tmp_path):
    flag = str(tmp_path / "failed")

    def fetch(codes):
        import os

        if not os.path.exists(flag):
            open(flag, "w").close()
            raise OSError("once")
        return pd.DataFrame({"instrument": codes, "close": [float(len(codes))] * len(codes)})

    codes = spark.range(23).select(F.concat(F.lit("s"), "id").alias("instrument")).coalesce(1)
    got = files.fetched(codes, fetch, "instrument string, close double", wait=0.01).toPandas()
    assert len(got) == got.instrument.nunique() == 23 and got.close.max() <= 10

    def never(codes):
        raise OSError("down")

    with pytest.raises(Exception, match="down"):
        files.fetched(codes, never, "instrument string", wait=0.01).collect()


def market(spark):
    rows = spark.range(40).select((F.col("id") % 20).cast("int").alias("d"), F.when(F.col("id") < 20, "a").otherwise("b").alias("instrument"))
    day = F.date_add(F.lit("2020-12-20").cast("date"), F.col("d"))
    return rows.select(day.alias("datetime"), "instrument", (F.col("d") + 1.0).alias("close"), F.lit(1).alias("tradestatus"))


def test_export(spark, tmp_path):
    path = str(tmp_path / "panel")
    members = spark.createDataFrame([("CSI300", "2020-12-20", "a"), ("CSI300", "2021-01-01", "b")], "universe string, date string, instrument string").withColumn("date", F.to_date("date"))
    sinks.export_panel(market(spark), members, path, "test", "2020-12-20", "2021-01-08")
    found = sinks.validate_manifest(spark, path, "2020-12-21", "2021-01-05")
    assert (found["n_rows"], found["instruments"], found["universes"], found["fields"]) == (40, 2, ["CSI300"], ["close", "tradestatus"])
    got = files.market_panel(spark, path, "CSI300", ["close"], "2020-12-25", "2021-01-03")
    assert got.columns == ["datetime", "instrument", "close"]
    assert sorted({(str(r.datetime)[:4], r.instrument) for r in got.collect()}) == [("2020", "a"), ("2021", "b")] and got.count() == 10
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "tradestatus" not in plan.split("== Physical Plan ==")[1]
    with pytest.raises(ValueError, match="no market rows"):
        files.market_panel(spark, path, "CSI500", ["close"], "2020-12-25", "2021-01-03")
    with pytest.raises(ValueError, match="is not within the data"):
        sinks.validate_manifest(spark, path, "2019-01-01", "2021-01-05")
    spark.read.parquet(f"{path}/calendar").limit(1).write.mode("append").parquet(f"{path}/calendar")
    with pytest.raises(ValueError, match="differ from when they were exported: calendar"):
        sinks.validate_manifest(spark, path, "2020-12-21", "2021-01-05")
    with pytest.raises(FileNotFoundError):
        sinks.validate_manifest(spark, str(tmp_path), "2020-12-21", "2021-01-05")
    with pytest.raises(ValueError, match="repeated"):
        sinks.export_panel(market(spark).union(market(spark)), members, str(tmp_path / "x"), "test", "2020-12-20", "2021-01-08")


def test_ledger_and_pools(spark, tmp_path):
    path = str(tmp_path / "log")
    assert files.ledger(spark, path).count() == 0
    for metric, ok in ((1.0, True), (2.0, True), (3.0, False)):
        row = (None, "n", "c", "e", "score", "k", "{}", (ok, metric, ""), None)
        sinks.append_ledger(spark.createDataFrame([row], files.LEDGER), path)
    log = files.ledger(spark, path)
    assert log.count() == 3 and log.where("run_id is null or created_at is null").count() == 0
    newest = R.latest_success(log, ["namespace", "expression_hash", "period", "config_hash"]).collect()
    assert [r.result.metric for r in newest] == [2.0]
    routed = spark.createDataFrame([("a", "rl_main", None), ("b", "rl_main", 1), ("c", "quarantine", 2)], "case_id string, route string, x int")
    counts = sinks.write_pools(routed, str(tmp_path / "pools"))
    assert {r.route: r.n for r in counts.collect()} == {"rl_main": 2, "quarantine": 1}
    assert spark.read.json(str(tmp_path / "pools/pools/route=rl_main")).count() == 2
    assert '"x":null' in "".join(r.value for r in spark.read.text(str(tmp_path / "pools/pools")).collect())
    assert sinks.stable_hash({"b": 1, "a": "é"}) == sinks.stable_hash({"a": "é", "b": 1})


def test_batch(spark, tmp_path):
    gold = SPEC | {"evidence": [SPAN]}
    case = lambda i, split, doc, **more: {"case_id": i, "report": "over 20 and 5 days", "gold": gold, "split": split, "document": {"doc_id": doc, "content_hash": "h"}} | more
    reports = spark.createDataFrame([("d1", "h", "t"), ("d2", "h", "t")], "doc_id string, content_hash string, text string")
    read = lambda name, *rows: files.cases(spark, lines(tmp_path / name, *rows))
    good = read("a", case("a", "train", "d1"), case("b", "holdout", "d2"))
    entries = sinks.write_batch(good, reports, str(tmp_path / "batch"), "one").orderBy("case_id").collect()
    assert [(e.case_id, e.group_id, e.split, sorted(e.content_hashes)) for e in entries] == [(c, d, s, ["case", "gold", "report", "verifier"]) for c, d, s in (("a", "d1", "train"), ("b", "d2", "holdout"))]
    shown = json.loads(spark.read.parquet(str(tmp_path / "batch/batch")).where("case_id = 'a'").first().case_json)
    assert "gold" not in shown and "report" not in shown
    for name, rows, message in (
        ("b", [case("a", "train", "d1"), case("b", "holdout", "d1")], "group in both"),
        ("c", [case("a", "train", "d9")], "missing report snapshot for case a"),
        ("d", [case("a", "train", "d1", gold=SPEC)], "not a usable label: case a"),
    ):
        with pytest.raises(ValueError, match=message):
            sinks.write_batch(read(name, *rows), reports, str(tmp_path / f"batch-{name}"), "x")
    checked = {r.case_id: r for r in P.integrity(read("e", case("a", "train", "d1"), case("b", "train", "d2", report="none"))).collect()}
    assert checked["a"].intact and checked["a"].gold_reward == pytest.approx(1.0)
    assert checked["b"].errors == ["gold_replay_failed", "gold_citation_not_in_report"]


def test_rollouts_and_report(spark, tmp_path):
    row = ("c", 0.5, ["a_cap"], 2, 1, {"unknown_tool": 1}, 0, 0, False, False, False, False, False)
    path = str(tmp_path / "runs")
    for _ in range(2):
        sinks.write_rollouts(spark.createDataFrame([row], files.ROLLOUTS), path)
    read = files.json_rows(spark, path, files.ROLLOUTS)
    got = sinks.write_run_report(read, str(tmp_path / "report")).first()
    assert (got.rollout_count, got.case_count, got.mean_reward, got.reward_std, got.illegal_tool_call_rate) == (2, 1, 0.5, 0.0, 0.5)
    assert got.hard_cap_distribution == {"a_cap": 2} and got.illegal_tool_call_kinds == {"unknown_tool": 2}
    text = [r.value for r in spark.read.text(str(tmp_path / "report/report")).collect()]
    assert text[0] == "# Run report" and "- `rollout_count`: 2" in text
    empty = P.run_summary(read.limit(0)).first()
    assert (empty.rollout_count, empty.mean_reward, empty.tool_calls, empty.hard_cap_distribution) == (0, 0.0, 0, {})
    sinks.json_to_parquet(spark, path, str(tmp_path / "pq"), files.ROLLOUTS)
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_masks_and_contrasts(spark):
    rows = spark.createDataFrame([([1, 2], [0, 1]), ([1], [0]), ([1, 2], [1]), ([1], [2]), ([], [])], "i array<int>, m array<int>")
    assert [r[0] for r in rows.select(R.valid_mask(F.col("i"), F.col("m"))).collect()] == [True, False, False, False, False]
    given = spark.createDataFrame([(1.0, 0.5, 0.0), (1.0, None, 0.0), (None, 1.0, 1.0), (0.0, 0.05, None)], "a double, b double, c double")
    got = [r[0] for r in given.select(R.robustness(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == pytest.approx([0.75, 0.5, 0.5, 0.25])


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 20_001])
def test_exact_medians(spark, n):
    """As F.median, with ties, nulls, even and odd counts, one value alone."""
    rows = spark.range(n).select(
        F.rand(3).alias("a"), F.floor(F.rand(4) * 5).cast("double").alias("b"), F.when(F.col("id") % 3 > 0, F.randn(5)).alias("c"), F.lit(7.0).alias("d"), F.lit(None).cast("double").alias("e"), (F.col("id") % 2).cast("int").alias("f")
    )
    assert tuple(R.exact_medians(rows, *rows.columns).first()) == tuple(rows.agg(*[F.median(c) for c in rows.columns]).first())


def test_medians_without_a_task_for_all(spark):
    """What is put in order are the values around the middle, not all of them."""
    rows = spark.range(200_000).select(F.rand(3).alias("a"))
    plan = R.exact_medians(rows, "a")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in text and "median(" not in text
    held = rows.selectExpr("percentile_approx(a, array(0.4995D, 0.5005D), 4000) b").first().b
    assert rows.where(F.col("a").between(*held)).count() < 2000


def test_summary_reads_its_records_once(spark, tmp_path):
    row = ("c", 0.5, ["a_cap"], 2, 1, {"unknown_tool": 1}, 0, 0, False, False, False, False, False)
    spark.createDataFrame([row] * 3, files.ROLLOUTS).write.parquet(str(tmp_path / "r"))
    out = P.run_summary(spark.read.parquet(str(tmp_path / "r")))
    out.collect()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan


@pytest.mark.parametrize("seed", [0, 1])
def test_as_of_against_loops(spark, seed):
    """Gaps of years, ties, nulls on both sides, keys of one side only, a value column on the left."""
    import datetime as dt
    import random

    from tessera.operators import market as M

    r = random.Random(seed)
    day = lambda: None if r.random() < 0.03 else dt.date(2020, 1, 1) + dt.timedelta(r.choice([r.randrange(40), r.randrange(1500)]))
    left = [(r.choice(["a", "b", "c", None]), day(), i, "old") for i in range(300)]
    right = [(r.choice(["a", "b", "d", None]), day(), r.choice(["x", "y", "z", None])) for i in range(60)]

    def value(k, t):
        known = [(d, v) for j, d, v in right if k is not None and t is not None and j == k and d is not None and d <= t and v is not None]
        return max(known)[1] if known else "none"

    a, b = spark.createDataFrame(left, "k string, t date, i int, v string"), spark.createDataFrame(right, "k string, t date, v string")
    got = M.as_of(a, b, "k", "t", "v", "none")
    assert got.columns == ["k", "t", "i", "v"]
    assert {(x.i, x.v) for x in got.collect()} == {(i, value(k, t)) for k, t, i, _ in left}
    assert M.as_of(a.drop("v"), b.limit(0), "k", "t", "v").where("v is not null").isEmpty() and M.as_of(a.limit(0), b, "k", "t", "v").isEmpty()
