"""The engine, its service and client, the vendor's source, binary vectors and whole rollouts."""

import datetime as dt
import json
import struct
import sys
import threading
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.plans import backtest as B
from tessera.plans.engine import BacktestEngine, exported
from tessera.sources import files, folders, service, sinks, vendor
from tessera.sources.panel import with_calendar

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import the tests
SPEC = {"name": "f", "universe": "CSI300", "frequency": "daily", "neutralization": "none", "rebalance": "weekly", "expr": "RANK($close)"}
CALL = {"exprs": {"f": "RANK($close)"}, "backtest_start_time": "2024-01-02", "backtest_end_time": "2024-02-01", "stock_pool": "csi300"}


def market(spark, days=12):
    rows = [(dt.date(2024, 1, 2) + dt.timedelta(d), f"s{r}", 10.0 + d + (3 - r) * 3, (0.02, 0.01, -0.01, -0.02)[r], 1, float(r % 2)) for d in range(days) for r in range(4)]
    return spark.createDataFrame(rows, "datetime date, instrument string, close double, return double, tradestatus int, industry double")


def engine(spark, **config):
    panel = with_calendar(market(spark)).cache()
    asked = []

    def load(universe, fields, start, end):
        asked.append((universe, fields))
        return panel.select("datetime", "instrument", "day_idx", *fields), None

    return BacktestEngine(load, B.Config(topk_ratio=0.5, open_cost=0.001, close_cost=0.002, **config)), asked


def test_engine(spark):
    e, asked = engine(spark)
    out = e.backtest(**CALL, update_freq=2, start_cash=1.0)
    assert asked == [("CSI300", ["close", "return", "tradestatus"])]
    assert len(out["portfolio"]["nav"]) == 12 and out["portfolio"]["nav"][-1] > 1 and out["portfolio"]["dates"][0] == "2024-01-02"
    assert out["diagnostics"] | {"mean_holdings": 0} == {"factor_name": "f", "expression": "RANK($close)", "universe": "CSI300", "signal_lag_bars": 1, "shuffle_cross_section": False, "rebalance_every_bars": 2, "mean_holdings": 0, "benchmark": "CSI300_equal_weight", "rows": 48}
    assert out["metrics"]["Total_Return_with_cost"] == pytest.approx(out["portfolio"]["nav"][-1] - 1) and len(out["metrics"]) == 8
    late, dealt = e.backtest(**CALL, update_freq=2, shift_bars=2), e.backtest(**CALL, update_freq=2, shuffle_cross_section=True)
    assert late["diagnostics"]["signal_lag_bars"] == 3 and late["portfolio"]["nav"] != out["portfolio"]["nav"]
    assert dealt == e.backtest(**CALL, update_freq=2, shuffle_cross_section=True)
    assert e.backtest(**CALL, industry_neutralization="industry") and asked[-1][1] == ["close", "industry", "return", "tradestatus"]


@pytest.mark.parametrize(
    "change, error",
    [({"stock_pool": "CSI1000"}, "unsupported universe"), ({"exprs": {}}, "one factor expression"), ({"exprs": {"a": "$close", "b": "$open"}}, "one factor expression"), ({"update_freq": 0}, "update_freq")]
    + [({"position_size": 1.5}, "position_size"), ({"max_pos_each_stock": 0.0}, "max_pos"), ({"industry_neutralization": "size"}, "neutralization"), ({"exprs": {"f": "COUNT($close)"}}, "unknown function"), ({"exprs": {"f": "1/(1-1)"}}, "zero")],
)
def test_engine_refuses(spark, change, error):
    e, asked = engine(spark)
    with pytest.raises(ValueError, match=error):
        e.backtest(**CALL | change)
    assert not asked
    with pytest.raises(RuntimeError, match="no tradable rows"):
        e.backtest(**CALL | {"backtest_start_time": "2030-01-01", "backtest_end_time": "2030-02-01"})


def test_service_and_client(spark, tmp_path):
    e, _ = engine(spark)
    server = service.serve(e, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert service.post(f"{url}/test_expr", {"name": "x", "expr": "TS_MEAN($close, 3)"}, 60)["analysis"] == {"ok": True, "fields": ["close"], "max_lookback": 3}
        with pytest.raises(service.ServiceError) as caught:
            service.post(f"{url}/backtest", CALL | {"exprs": {"f": "COUNT($close)"}}, 60)
        assert caught.value.source == "model" and "422" in str(caught.value)
        with pytest.raises(service.ServiceError, match="update_freq"):
            service.post(f"{url}/backtest", CALL | {"update_freq": "x"}, 60)
        with pytest.raises(service.ServiceError) as caught:
            service.post(f"{url}/backtest", CALL | {"backtest_start_time": "2030-01-01", "backtest_end_time": "2030-02-01"}, 60)
        assert caught.value.source == "environment" and "503" in str(caught.value)
        client = service.ServiceClient(spark, str(tmp_path / "log"), service.ClientConfig(endpoint=f"{url}/backtest"))
        first = client.evaluate(SPEC, "c", "search", "2024-01-02", "2024-02-01")
        again = client.evaluate(SPEC, "c", "search", "2024-01-02", "2024-02-01")
        assert first["ok"] and not first["cached"] and again == first | {"cached": True}
        other = client.evaluate(SPEC, "c", "search", "2024-01-02", "2024-02-01", shift_bars=1)
        assert other["ok"] and not other["cached"] and other["run_id"] != first["run_id"]
        assert files.ledger(spark, str(tmp_path / "log")).count() == 2
    finally:
        server.shutdown()
        server.server_close()
    gone = client.evaluate(SPEC | {"expr": "$close"}, "c", "search", "2024-01-02", "2024-02-01")
    assert (gone["ok"], gone["error_source"], gone["metric"]) == (False, "environment", None)
    assert service.answered(e, "GET", "/health", {})[1]["status"] == "healthy" and service.answered(e, "GET", "/x", {})[0] == 404
    a, m = service.Answer, "Information_Ratio_with_cost"
    given = lambda *x: [service.outcome(a(*x), m)[c] for c in ("ok", "metric", "error_source")]
    assert given(200, {"data": {"metrics": {m: 2, "x": "y", "z": True}}}) == given(200, {"metrics": {m: 2.0}}) == [True, 2.0, None]
    assert given(200, {"metrics": {"other": 1}}) == given(200, "text") == given(500, "text") == given(503, {"detail": {"error": "x"}}) == given(0, {"error": "x"}) == [False, None, "environment"]
    assert given(404, "text") == given(422, {"detail": "x"}) == given(500, {"detail": {"source": "model"}}) == [False, None, "model"]
    sent = service.ClientConfig().payload(SPEC, "a", "b", shuffle=True)
    assert sent["update_freq"] == 5 and sent["shuffle_cross_section"] and "shift_bars" not in sent and not sent["pred_score_industry_neutralization"]


class Cursor:
    def __init__(self, fields, rows, code="0"):
        self.fields, self.rows, self.error_code, self.error_msg, self.at = fields, rows, code, "why", -1

    def next(self):
        self.at += 1
        return self.at < len(self.rows)

    def get_row_data(self):
        return self.rows[self.at]


class Client:
    """A vendor whose first logins and one query fail."""

    logins, asked = 0, []

    def login(self):
        Client.logins += 1
        return SimpleNamespace(error_code="1" if Client.logins == 1 else "0", error_msg="busy")

    def logout(self):
        pass

    def query_hs300_stocks(self, date):
        return Cursor(["updateDate", "code"], [["", "sh.600001"], ["", "sz.000001"]])

    def query_stock_industry(self, date):
        return Cursor(["updateDate", "code", "industry"], [["2020-01-31", "sh.600001", "banks"]])

    def query_history_k_data_plus(self, code, fields, start_date, end_date, frequency, adjustflag):
        names = fields.split(",")
        day = {"code": code, "open": "1", "high": "2", "low": "1", "close": "1.5", "volume": "", "amount": "9", "tradestatus": "1", "pctChg": "2.5", "isST": ""}
        return Cursor(names, [[(day | {"date": d}).get(c, "") for c in names] for d in ("2020-06-30", "2020-07-01", "2020-12-31")])


def test_vendor(spark, tmp_path):
    source = vendor.VendorSource(spark, Client, wait=0.01)
    with pytest.raises(ValueError, match="CSI1000"):
        vendor.prepared(source, str(tmp_path / "x"), "2020-01-01", "2020-12-31", ["CSI1000"])
    found = vendor.prepared(source, str(tmp_path / "m"), "2020-01-01", "2020-12-31", ["csi300"])
    assert Client.logins >= 2 and source.client is None
    assert (found["source"], found["n_rows"], found["instruments"], found["universes"]) == ("vendor", 6, 2, ["CSI300"])
    rows = files.market_panel(spark, str(tmp_path / "m/panel"), "CSI300", ["close", "volume", "return", "industry"], "2020-01-01", "2020-12-31").collect()
    assert {(r.instrument, r.close, r.volume, r["return"], r.industry) for r in rows} == {("sh600001", 1.5, None, 0.025, 2.0), ("sz000001", 1.5, None, 0.025, 1.0)}
    again = vendor.prepared(vendor.VendorSource(spark, Client, wait=0.01), str(tmp_path / "m2"), "2020-01-01", "2020-12-31", ["CSI300"])
    assert again["hashes"] == found["hashes"]
    run = BacktestEngine(exported(spark, str(tmp_path / "m/panel"), "2020-01-01", "2020-12-31"), B.Config(topk_ratio=1.0))
    assert len(run.backtest(exprs={"a": "$close"}, backtest_start_time="2020-06-30", backtest_end_time="2020-12-31", stock_pool="CSI300")["portfolio"]["nav"]) == 3
    with pytest.raises(RuntimeError, match="vendor error 7: why"):
        vendor.drained(Cursor([], [], "7"))


class Ranged(Client):
    """Bars of the weekdays asked for; what was asked is told in a file, some instruments fail."""

    told, broken = "", ()

    def __init__(self, told="", broken=()):
        self.told, self.broken = told, broken

    def login(self):
        with open(self.told, "a") as f:
            f.write("login\n")
        return SimpleNamespace(error_code="0", error_msg="")

    def query_history_k_data_plus(self, code, fields, start_date, end_date, frequency, adjustflag):
        with open(self.told, "a") as f:
            f.write(f"{code} {start_date} {end_date}\n")
        if code in self.broken:
            return Cursor([], [], "9")
        days = [] if code == "sh.000000" else [str(d.date()) for d in pd.bdate_range(start_date, end_date)]
        return Cursor(fields.split(","), [[{"date": d, "code": code, "close": "1.5", "pctChg": "1"}.get(c, "") for c in fields.split(",")] for d in days])


def told(path):
    text = path.read_text().split("\n") if path.exists() else []
    path.write_text("")
    return sorted(x for x in text if x and x != "login"), text.count("login")


def test_vendor_cache_of_a_broken_run(spark, tmp_path):
    """Nine of ten instruments are kept when one fails, and are not asked for again."""
    cache, log = str(tmp_path / "bars"), tmp_path / "told"
    names = [f"sh60000{i}" for i in range(10)]
    codes = spark.createDataFrame([(n,) for n in names], "instrument string")
    bad = vendor.VendorSource(spark, lambda: Ranged(str(log), ("sh.600004",)), batch=3, wave=2, tries=2, wait=0.01)
    with pytest.raises(RuntimeError, match="1 of 10 keys could not be fetched, all others are kept: sh600004: vendor error 9"):
        bad.prices(codes, "2024-01-01", "2024-01-31", cache)
    asked, logins = told(log)
    assert asked.count("sh.600004 2024-01-01 2024-01-31") == 2 and len(asked) == 11 and logins == 4 + 2  # a session a batch, and one after each failure but the batch's last
    good = vendor.VendorSource(spark, lambda: Ranged(str(log)), batch=3, wait=0.01)
    assert good.prices(codes, "2024-01-01", "2024-01-31", cache).count() == 10 * 23
    assert told(log)[0] == ["sh.600004 2024-01-01 2024-01-31"]
    assert good.prices(codes, "2024-01-08", "2024-01-12", cache).count() == 10 * 5 and told(log)[0] == []
    empty = spark.createDataFrame([("sh000000",)], "instrument string")
    with pytest.raises(RuntimeError, match="sh000000: no rows"):
        good.prices(empty, "2024-01-01", "2024-01-31", cache)
    with pytest.raises(Exception, match="sh000000: no bars"):
        good.prices(empty, "2024-01-01", "2024-01-31").collect()


def test_vendor_cache_of_a_longer_period(spark, tmp_path):
    """Only days that the cache lacks are asked for: before, between and after."""
    cache, log = str(tmp_path / "bars"), tmp_path / "told"
    source = vendor.VendorSource(spark, lambda: Ranged(str(log)), wait=0.01)
    codes = spark.createDataFrame([("sh600001",), ("sz000001",), ("sh600001",)], "instrument string")
    source.prices(codes.limit(1), "2024-01-08", "2024-01-12", cache)
    source.prices(codes.limit(1), "2024-01-22", "2024-01-24", cache)
    told(log)
    rows = source.prices(codes, "2024-01-01", "2024-01-31", cache)
    assert told(log)[0] == ["sh.600001 2024-01-01 2024-01-07", "sh.600001 2024-01-13 2024-01-21", "sh.600001 2024-01-25 2024-01-31", "sz.000001 2024-01-01 2024-01-31"]
    assert rows.count() == rows.select("instrument", "datetime").distinct().count() == 2 * 23
    assert source.prices(codes, "2023-12-01", "2024-02-29", cache).count() == 2 * (21 + 23 + 21)
    assert len(told(log)[0]) == 4
    day = pd.Timestamp.today().normalize()
    first, last = str((day - pd.Timedelta(days=10)).date()), str((day + pd.Timedelta(days=10)).date())
    source.prices(codes.limit(1), first, last, cache)
    told(log)
    source.prices(codes.limit(1), first, last, cache)  # today and later are not taken as known
    assert told(log)[0] == [f"sh.600001 {day.date()} {last}"]


def test_a_task_for_each_batch(spark):
    """Small batches are not put together, however few bytes they have."""
    import pyspark.sql.functions as F_

    codes = spark.range(95).select(F_.concat(F_.lit("s"), "id").alias("instrument"))
    rows = files.fetched(codes, lambda keys: pd.DataFrame({"instrument": keys}), "instrument string")
    assert rows.rdd.getNumPartitions() == 10 and rows.select(F_.spark_partition_id()).distinct().count() == 10
    assert rows.distinct().count() == rows.count() == 95
    assert files.fetched(codes.limit(0), None, "instrument string").count() == 0


def test_binary_export(spark, tmp_path):
    rows = market(spark, 4).where("not (instrument = 's1' and datetime = '2024-01-04') and not (instrument = 's2' and datetime = '2024-01-02')")
    members = spark.createDataFrame([("CSI300", "2024-01-03", "s0")], "universe string, date string, instrument string").withColumn("date", F.to_date("date"))
    assert sinks.export_binary(rows, members, str(tmp_path)) == 4 * 4 + 3
    read = lambda p: [x[0] for x in struct.iter_unpack("<f", (tmp_path / p).read_bytes())]
    assert read("features/s0/close.day.bin") == [0, 19, 20, 21, 22]
    gap = read("features/s1/close.day.bin")
    assert gap[:3] == [0, 16, 17] and gap[3] != gap[3] and gap[4] == 19
    assert read("features/s2/close.day.bin")[:2] == [1, 14]
    assert (tmp_path / "calendars/day.txt").read_text() == "2024-01-02\n2024-01-03\n2024-01-04\n2024-01-05\n"
    assert (tmp_path / "instruments/csi300.txt").read_text() == "s0\t2024-01-03\t2024-01-05\n"
    assert len((tmp_path / "instruments/all.txt").read_text().splitlines()) == 4
    assert not list(tmp_path.rglob(".*"))


def test_files_of_a_job_that_fails(spark, tmp_path):
    """Nothing of it is left, and files that were there stay; parts are put together in order."""
    rows = spark.range(40).select(F.concat(F.lit("a/f"), (F.col("id") % 4).cast("string")).alias("path"), F.col("id").alias("part"), F.encode(F.concat(F.col("id").cast("string"), F.lit(" ")), "UTF-8").alias("content")).repartition(5)
    folders.write_files(rows, str(tmp_path))
    before = {p.name: p.read_text() for p in (tmp_path / "a").iterdir()}
    assert before == {f"f{i}": "".join(f"{j} " for j in range(i, 40, 4)) for i in range(4)}

    def breaks(frames):
        for frame in frames:
            if (frame["part"] == 39).any():
                raise OSError("disk full")
            yield frame

    bad = rows.withColumn("content", F.lit(b"x")).mapInPandas(breaks, rows.schema)
    with pytest.raises(Exception, match="disk full"):
        folders.write_files(bad, str(tmp_path))
    assert {p.name: p.read_text() for p in (tmp_path / "a").iterdir()} == before and not list(tmp_path.glob(".*"))


def test_rollouts_are_kept_whole(spark, tmp_path):
    steps = [("system", "s"), ("user", "u"), ("assistant", "a")]
    schema = "rollout_id string, case_id string, stage string, steps array<struct<role: string, content: string>>, reward double, caps array<string>, audit struct<tool_calls: long, illegal_tool_calls: long, illegal_by_kind: map<string, long>>, tools string"
    made = spark.createDataFrame([("r1", "c1", "extract", steps, 0.5, ["x_cap"], (3, 1, {"unknown_tool": 1}), None), ("r2", "c2", "extract", steps, 0.7, [], None, "[1]")], schema)
    path = str(tmp_path / "run")
    got = {r.rollout_id: r for r in sinks.store_rollouts(made, path, "run-1").collect()}
    assert got["r1"].prompt_hash == got["r2"].prompt_hash == sinks.stable_hash([{"role": "system", "content": "s"}, {"role": "user", "content": "u"}])
    assert (got["r1"].tool_calls, got["r2"].tool_calls, got["r1"].illegal_by_kind) == (3, 0, {"unknown_tool": 1}) and got["r1"].tool_schema_hash == sinks.stable_hash([])
    assert got["r1"].trajectory_path == f"{path}/trajectory/case_id=c1/r1"
    assert spark.read.json(f"{path}/trajectory").count() == spark.read.json(f"{path}/metadata").count() == 2
    assert spark.read.json(f"{path}/score/case_id=c1").first().reward == 0.5
    sinks.store_rollouts(made, path, "run-2")
    assert files.json_rows(spark, f"{path}/scores", files.ROLLOUTS).count() == 4


def test_pdf(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\x0c\xe4\xba\x8c\xe5\x8d\x81\xe6\x97\xa5\x0c")
    (tmp_path / "b.txt").write_text("no")
    pages = files.pdf_pages(spark, str(tmp_path), lambda raw: raw.decode().split("\x0c"))
    assert sorted((r.page, r.text) for r in pages.collect()) == [(1, "one"), (2, "二十日"), (3, "")]
    report = files.pdf_reports(pages).first()
    assert report.text == "one\n\n二十(20)日\n\n" and report.source_format == "pdf" and report.content_hash.startswith(report.doc_id)
    assert sorted((c.chunk_id, c.page_start, c.text) for c in files.page_chunks(pages, 3, 1).collect()) == [("p1-c0000", 1, "one"), ("p2-c0000", 2, "二十("), ("p2-c0001", 2, "(20"), ("p2-c0002", 2, "0)日")]
    with pytest.raises(Exception, match="pypdf"):
        files.pdf_pages(spark, str(tmp_path)).collect()


def test_csv_and_cases(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("a", 1)], "x string, y int"), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()[:] == ("a", "1")
    sinks.write_by_case(spark.createDataFrame([("a", 1), ("b", 2)], "case_id string, y int"), str(tmp_path / "by"))
    assert spark.read.json(str(tmp_path / "by/case_id=b")).first().y == 2
    sinks.write_one(spark.range(3).toDF("n"), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    (tmp_path / "p.jsonl").write_text(json.dumps({"case_id": "a", "seed": SPEC, "evolved": SPEC | {"windows": ["3"]}}) + "\n")
    assert files.pairs(spark, str(tmp_path / "p.jsonl")).first().evolved.windows == [3]
