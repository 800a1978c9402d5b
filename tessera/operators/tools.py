"""Tool calls of rollouts, executed as joins: what a report's search, reading and checking tools answer.

A call is a row; its answer is a column of JSON.  All calls of a batch run at
once, each against the chunks of its own document only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expression import listed
from ..functions.text import dumps, read_spec
from . import records as R
from .training import REPORT_TOOLS, tool_names

_CHUNK = T.StructType([T.StructField(c, T.StringType() if c in ("chunk_id", "text") else T.IntegerType()) for c in ("chunk_id", "text", "page_start", "page_end", "char_start", "char_end")])


def _argument(name: str) -> Column:
    return F.get_json_object("arguments", f"$.{name}")


def _text(value: Column) -> Column:
    return dumps(value, T.StringType())


def _object(**fields: Column) -> Column:
    """The JSON of an object whose values are JSON already."""
    parts = [F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def _bool(value: Column) -> Column:
    return F.when(value, "true").otherwise("false")


def _texts(values: Column) -> Column:
    return dumps(values, T.ArrayType(T.StringType()))


#: Code points of an index entry.
GRAM = 3


def _grams(text: Column) -> Column:
    """The distinct runs of ``GRAM`` code points of a text."""
    runs = lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - GRAM), lambda i: F.concat(*[F.get(a, i + j) for j in range(GRAM)]))
    letters = F.transform(F.array(F.split(text, "", F.length(text))), lambda a: F.array_distinct(runs(a)))  # the letters are told once
    return F.when(F.length(text) >= GRAM, letters[0]).otherwise(F.array().cast("array<string>"))


def gram_index(chunks: DataFrame) -> DataFrame:
    """(doc_id, gram, chunk_id): which chunks of a document hold which runs of ``GRAM`` code points, in lower case."""
    return chunks.select("doc_id", "chunk_id", F.explode(_grams(F.lower("text"))).alias("gram")).distinct()


def narrowed(searches: DataFrame, index: DataFrame) -> DataFrame:
    """(call_id, doc_id, chunk_id) of the chunks that hold all grams of a search's ``_needle``, which has one at least.

    A chunk that holds the needle is among them; whether each does is still to be
    seen.  The batch's searches meet the index by document and gram, so chunks
    that share no gram with a search are never read for it.
    """
    asked = searches.select("call_id", "doc_id", F.explode(_grams(F.col("_needle"))).alias("gram"), F.size(_grams(F.col("_needle"))).alias("_need"))
    hits = asked.join(index, ["doc_id", "gram"]).groupBy("call_id", "doc_id", "chunk_id").agg(F.count("*").alias("n"), F.first("_need").alias("_need"))
    return hits.where("n = _need").select("call_id", "doc_id", "chunk_id")


def executed(calls: DataFrame, chunks: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``calls`` with result (JSON), ok, source, error and unparsable.

    ``calls`` have call_id, doc_id, name and arguments (JSON); ``chunks`` have
    doc_id, chunk_id, text, page_start, page_end, char_start and char_end, in
    the order of doc_id and place.

    search_report   chunks that hold the query in either case, the first
                    ``limit`` of them (5, from 1 to 20); none for a blank query;
    read_report_pages   chunks that begin on the pages; those without a page are not among them;
    validate_factor_spec   whether the record can be read, is legal and quotes what its chunks hold.

    Arguments that are no JSON object, missing page numbers and other tools are
    the model's errors.  Only chunks that answer a call are gathered by it, in
    one row; a search keeps the first ones of each task before that.  With an
    ``index`` of the chunks (:func:`gram_index`) a search reads the chunks alone
    that hold all its grams.
    """
    known = tool_names(REPORT_TOOLS)
    whole = lambda c: _argument(c).try_cast("int")
    readable = F.coalesce(F.try_parse_json("arguments").isNotNull() & F.startswith(F.ltrim("arguments"), F.lit("{")), F.lit(False))
    asked = calls.withColumns(
        {
            "unparsable": ~readable,
            "_needle": F.lower(F.trim(F.coalesce(_argument("query"), F.lit("")))),
            "_limit": F.greatest(F.lit(1), F.least(F.lit(20), F.coalesce(whole("limit"), F.lit(5)))),
            "_first": whole("page_start"),
            "_last": whole("page_end"),
            "_spec": read_spec(F.coalesce(_argument("spec"), F.lit("{}"))),
        }
    )
    wanted = asked.where(~F.col("unparsable")).select("call_id", "doc_id", "name", "_needle", "_limit", "_first", "_last", F.col("_spec.evidence").alias("_evidence"))
    body = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _CHUNK])
    held = chunks.select("doc_id", body.alias("_c"))
    by_index = (F.col("name") == known[0]) & (F.length("_needle") >= GRAM)
    pairs = wanted.where(~by_index if index is not None else F.lit(True)).join(held, "doc_id")
    if index is not None:
        few = narrowed(wanted.where(by_index), index).join(held.withColumn("chunk_id", F.col("_c.chunk_id")), ["doc_id", "chunk_id"])
        pairs = pairs.unionByName(wanted.join(few.drop("doc_id", "chunk_id"), "call_id"))
    hit = (F.col("name") == known[0]) & (F.col("_needle") != "") & F.contains(F.lower("_c.text"), F.col("_needle"))
    read = (F.col("name") == known[1]) & F.col("_c.page_start").between(F.col("_first"), F.col("_last"))
    cited = (F.col("name") == known[2]) & F.exists("_evidence", lambda e: (e["chunk_id"] == F.col("_c.chunk_id")) & F.contains(F.col("_c.text"), e["quote"]))
    place = F.struct(F.coalesce("_c.page_start", F.lit(0)).alias("p"), F.col("_c.char_start").alias("s"), F.col("_c").alias("c"))
    found = pairs.where(hit | read | cited).groupBy("call_id").agg(F.slice(F.sort_array(F.collect_list(place)), 1, F.when(F.first("name") == known[0], F.first("_limit")).otherwise(F.lit(2**31 - 1))).alias("_found"))
    rows = asked.join(found, "call_id", "left")
    got = F.coalesce(F.transform("_found", lambda f: f["c"]), F.array().cast(T.ArrayType(_CHUNK)))
    shown = dumps(got, T.ArrayType(_CHUNK))
    spec = F.col("_spec")
    check, issues = listed(spec["expr"]), R.declaration_issues(spec)
    lost = F.transform(F.filter(spec["evidence"], lambda e: ~F.exists(got, lambda c: (c["chunk_id"] == e["chunk_id"]) & F.contains(c["text"], e["quote"]))), lambda e: e["chunk_id"])
    valid = check["ok"] & (F.size(lost) == 0)
    error = (
        F.when(~F.col("name").isin(known), F.concat(F.lit("unknown tool: "), F.col("name")))
        .when(F.col("unparsable"), "the arguments are no JSON object")
        .when((F.col("name") == known[1]) & (F.col("_first").isNull() | F.col("_last").isNull()), "page_start and page_end are whole numbers")
        .when((F.col("name") == known[2]) & spec.isNull(), "invalid FactorSpec")
    )
    answer = (
        F.when(F.col("name") == known[0], _object(ok=F.lit("true"), query=_text(F.coalesce(_argument("query"), F.lit(""))), matches=shown))
        .when(F.col("name") == known[1], _object(ok=F.lit("true"), page_start=F.col("_first").cast("string"), page_end=F.col("_last").cast("string"), chunks=shown))
        .otherwise(_object(ok=_bool(valid), expr_ok=_bool(check["ok"]), expr_message=_text(check["reason"]), declaration_issues=_texts(issues), citation_errors=_texts(lost)))
    )
    rows = rows.withColumns(
        {
            "error": error,
            "ok": error.isNull() & F.when(F.col("name") == known[2], valid).otherwise(True),
            "source": F.lit("model"),
            "result": F.when(error.isNotNull(), _object(ok=F.lit("false"), error=_text(error), source=F.lit('"model"'))).otherwise(answer),
        }
    )
    return rows.select(*calls.columns, "result", "ok", "source", "error", "unparsable")


def observed(calls: DataFrame, chunks: DataFrame) -> DataFrame:
    """Executed calls of trajectories (trajectory, step) with what is illegal about each, as ``records.audited`` takes them."""
    return R.classified(executed(calls, chunks), tool_names(REPORT_TOOLS))
