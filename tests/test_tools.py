"""Tool calls executed against reports, and what is illegal about them."""

import json

from pyspark.sql import functions as F

from tessera.operators import records as R
from tessera.operators import tools
from tessera.operators.training import REPORT_TOOLS, tool_names

CHUNKS = "doc_id string, chunk_id string, text string, page_start int, page_end int, char_start int, char_end int"
CALLS = "call_id long, trajectory string, step int, doc_id string, name string, arguments string"
SPEC = {"name": "f", "universe": "CSI500", "frequency": "daily", "neutralization": "none", "rebalance": "weekly", "expr": "RANK($close)", "windows": [], "evidence": [{"chunk_id": "p1-c0000", "quote": "二十(20)日"}]}


def answers(spark, *calls):
    chunks = [("d", f"p{p}-c0000", f"Page {p} \"x\" 中证500二十(20)日" if p == 1 else f"page {p}", p, p, 0, 9) for p in range(1, 8)] + [("d", "p0-c0000", "PAGE none", None, None, 0, 9), ("e", "p1-c0000", "page of another", 1, 1, 0, 9)]
    rows = [(n, "t", n if n < 90 else 90, "d", name, a if isinstance(a, str) else json.dumps(a, ensure_ascii=False)) for n, (name, a) in enumerate(calls)]
    got = tools.observed(spark.createDataFrame(rows, CALLS), spark.createDataFrame(chunks, CHUNKS).repartition(3)).orderBy("call_id")
    return got, [(r, json.loads(r.result)) for r in got.collect()]


def test_search_and_read(spark):
    _, got = answers(spark, ("search_report", {"query": " PAGE "}), ("search_report", {"query": "page", "limit": 99}), ("search_report", {"query": "  "}), ("read_report_pages", {"page_start": 2, "page_end": 3}), ("search_report", {"query": "\"x\"", "limit": 0}))
    assert [m["chunk_id"] for m in got[0][1]["matches"]] == ["p0-c0000", "p1-c0000", "p2-c0000", "p3-c0000", "p4-c0000"]
    assert len(got[1][1]["matches"]) == 8 and got[2][1] == {"ok": True, "query": "  ", "matches": []}
    assert [c["page_start"] for c in got[3][1]["chunks"]] == [2, 3] and got[4][1]["matches"][0]["text"].startswith('Page 1 "x"')
    assert all(r.ok and r.illegal_kind is None for r, _ in got)


def test_checks_and_faults(spark):
    lost = SPEC | {"evidence": [{"chunk_id": "p2-c0000", "quote": "二十(20)日"}], "neutralization": "industry", "expr": "FOO($close)"}
    calls = [("validate_factor_spec", {"spec": SPEC}), ("validate_factor_spec", {"spec": lost}), ("validate_factor_spec", {"spec": {"name": "x"}}), ("run_shell", {}), ("search_report", "{broken"), ("search_report", "[1]"), ("read_report_pages", {"page_start": 1})]
    rows, got = answers(spark, *calls)
    assert got[0][1] == {"ok": True, "expr_ok": True, "expr_message": "ok", "declaration_issues": [], "citation_errors": []}
    assert got[1][1] == {"ok": False, "expr_ok": False, "expr_message": "unknown func FOO", "declaration_issues": ["neutralization_missing_in_expr"], "citation_errors": ["p2-c0000"]}
    assert [r.illegal_kind for r, _ in got] == [None, None, "schema_invalid", "unknown_tool", "unparsable_arguments", "unparsable_arguments", None]
    assert [r.ok for r, _ in got] == [True, False, False, False, False, False, False] and got[6][1]["source"] == "model"
    audit = R.audited(rows).first()
    assert (audit.tool_calls, audit.illegal_tool_calls, audit.illegal_by_kind) == (7, 4, {"schema_invalid": 1, "unknown_tool": 1, "unparsable_arguments": 2})


def test_no_calls(spark):
    rows, got = answers(spark)
    assert got == [] and rows.columns[-1] == "illegal_kind"


def test_searches_by_index(spark):
    """The answers of the scan, and far fewer chunks read for them."""
    import random

    r = random.Random(4)
    words = ["".join(r.choice("abcdeéñ ") for _ in range(r.randint(2, 7))) for _ in range(300)]
    chunks = [(f"d{i % 3}", f"c{i}", " ".join(r.choices(words, k=40)).title(), i, i, i * 100, i * 100 + 99) for i in range(240)]
    table = spark.createDataFrame(chunks, "doc_id string, chunk_id string, text string, page_start int, page_end int, char_start int, char_end int")
    asked = [r.choice(chunks)[2][5:5 + n].strip() for n in (1, 2, 3, 4, 6, 9, 14) for _ in range(6)] + ["", " ", "zzz", "zz", "aaa aaa", 'quo"te']
    calls = [(i, f"d{i % 3}", tool_names(REPORT_TOOLS)[0], json.dumps({"query": q, "limit": 20})) for i, q in enumerate(asked)]
    calls += [(900, "d1", tool_names(REPORT_TOOLS)[1], '{"page_start": 1, "page_end": 9}'), (901, "d1", "other", "{}")]
    given = spark.createDataFrame(calls, "call_id int, doc_id string, name string, arguments string")
    index = tools.gram_index(table)
    one, two = ({x.call_id: x for x in tools.executed(given, table, i).collect()} for i in (None, index))
    assert one == two and sum('"chunk_id"' in x.result for x in one.values()) > 20
    long = given.where("call_id < 900").withColumn("_needle", F.lower(F.trim(F.get_json_object("arguments", "$.query")))).where("length(_needle) >= 4")
    assert 0 < tools.narrowed(long, index).count() < long.join(table, "doc_id").count() / 4
