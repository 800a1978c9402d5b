"""Text functions for reports: chunks, numbers, search, parsing, hashes."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Chinese digits and units.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
_NUMERAL = re.compile(f"[{''.join(DIGITS)}{''.join(UNITS)}]+")


_DIGITS, _UNITS = "".join(DIGITS), "".join(UNITS)
_TERM = re.compile(f"([{_DIGITS}]?)([{_UNITS}])")


def numbers(text: Column) -> Column:
    """The distinct whole numbers of a text, by their runs of digits (full-width ones too)."""
    plain = F.when(text.rlike("[０-９]"), F.translate(text, "０１２３４５６７８９", "0123456789")).otherwise(text)
    found = F.regexp_extract_all(plain, F.lit("[0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: n.try_cast("bigint")))


def _numeral_value(run: Column) -> Column:
    """The value of a Chinese numeral, without Python: see :func:`numeral`."""
    ascii_digits = "".join(str(v) for v in DIGITS.values())
    digit = lambda c: F.translate(c, _DIGITS, ascii_digits).try_cast("bigint")
    exponent = lambda c: F.translate(c, _UNITS, "123").cast("int")  # noqa: E731  the units are powers of ten
    terms = F.regexp_extract_all(run, F.lit(f"([{_DIGITS}]?[{_UNITS}])"), F.lit(1))
    times = lambda t: F.greatest(F.coalesce(digit(F.substring(t, 1, 1)), F.lit(1)), F.lit(1))
    each = F.transform(terms, lambda t: times(t) * F.pow(F.lit(10), exponent(F.right(t, F.lit(1)))).cast("bigint"))
    rest = F.coalesce(digit(F.right(run, F.lit(1))), F.lit(0))
    return F.when(F.size(terms) == 0, digit(run)).otherwise(F.aggregate(each, rest, lambda a, x: a + x))


def numerals(text: Column) -> Column:
    """The values of a text's Chinese numerals."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"([{_DIGITS}{_UNITS}]+)"), F.lit(1)), _numeral_value))


def numbers_meant(text: Column) -> Column:
    """The distinct numbers of a text, those in digits before Chinese numerals."""
    spans = F.regexp_extract_all(text, F.lit("[0-9〇-９]+"), F.lit(0))  # two ranges that hold all of them, so few characters pay for the long class
    found = F.flatten(F.transform(spans, lambda t: F.regexp_extract_all(t, F.lit(f"([0-9０-９]+|[{_DIGITS}{_UNITS}]+)"), F.lit(1))))
    plain = lambda t: F.translate(t, "０１２３４５６７８９", "0123456789").try_cast("bigint")
    value = lambda t: F.when(t.rlike("^[0-9０-９]"), plain(t)).otherwise(_numeral_value(t))
    each = F.transform(found, lambda t, i: F.struct(~t.rlike("^[0-9０-９]"), i, value(t).alias("v")))
    return F.array_distinct(F.transform(F.array_sort(each), lambda e: e["v"]))


def numeral(text: str) -> int | None:
    """A Chinese numeral's value: digits alone are read in place.

    With units, each unit counts as often as the digit right before it says
    (once if there is none, or a zero), and a last digit is added.
    """
    if not text or any(c not in DIGITS and c not in UNITS for c in text):
        return None
    terms = _TERM.findall(text)
    if not terms:
        return int(text.translate({ord(c): str(v) for c, v in DIGITS.items()}))
    return sum(max(1, DIGITS.get(digit, 1)) * UNITS[unit] for digit, unit in terms) + DIGITS.get(text[-1], 0)


@F.pandas_udf(T.StringType())
def with_numerals(texts: pd.Series) -> pd.Series:
    """Texts with each Chinese numeral followed by its value in brackets."""
    return texts.map(lambda t: None if t is None else _NUMERAL.sub(lambda m: f"{m[0]}({numeral(m[0])})", t))


def chunks(docs: DataFrame, text: str = "text", size: int = 1800, overlap: int = 200) -> DataFrame:
    """``docs`` exploded to (chunk_no, char_start, char_end, chunk) with overlapping chunks of code points."""
    n, step = F.length(text), max(1, size - overlap)
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step)).cast("int")
    rows = docs.withColumn("_n", count).where("_n > 0").withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    start = F.col("chunk_no") * step
    return rows.drop("_n").withColumns(
        {"char_start": start, "char_end": F.least(start + size, n), "chunk": F.substring(F.col(text), start + 1, F.lit(size))}
    )


def chunk_id(page: Column, number: Column) -> Column:
    return F.format_string("p%d-c%04d", F.coalesce(page, F.lit(0)), number)


def search(rows: DataFrame, query: str, text: str, order: list[str], limit: int = 5) -> DataFrame:
    """The first rows, by ``order``, that hold the query in either case; 1 to 20 of them."""
    needle = query.strip().lower()
    hit = F.contains(F.lower(text), F.lit(needle)) if needle else F.lit(False)
    return rows.where(hit).orderBy(*order).limit(min(20, max(1, limit)))


def blank(text: Column) -> Column:
    """Whether there is nothing but white space."""
    return text.rlike(r"(?U)^\s*$")


def normal_expression(expr: Column) -> Column:
    return F.lower(F.regexp_replace(expr, r"(?U)\s+", ""))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def document_id(text: Column) -> Column:
    """The first 16 hex digits of the content's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


_SPAN = "struct<chunk_id: string, quote: string, page_start: string, page_end: string, char_start: string, char_end: string>"
SPEC = f"name string, universe string, frequency string, neutralization string, rebalance string, expr string, windows array<string>, evidence array<{_SPAN}>"
_TERMS = ("daily", "weekly", "monthly")


def whole(value: Column) -> Column:
    """A number or a text of a number as an int if it has no fraction, else NULL."""
    number = value.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def read_spec(body: Column) -> Column:
    """The record of a JSON text; NULL if it is none.

    Windows and places may be numbers or texts of numbers; unknown keys are
    ignored; lists that are not there are empty; a quotation has to name its
    chunk.
    """
    read = F.from_json(body, SPEC)
    windows = F.coalesce(F.transform(read["windows"], whole), F.array().cast("array<int>"))
    places = ("page_start", "page_end", "char_start", "char_end")
    spans = F.coalesce(read["evidence"], F.array().cast(f"array<{_SPAN}>"))
    evidence = F.transform(spans, lambda e: F.struct(e["chunk_id"].alias("chunk_id"), e["quote"].alias("quote"), *[whole(e[p]).alias(p) for p in places]))
    good = read["name"].isNotNull() & read["universe"].isNotNull() & read["expr"].isNotNull()
    good &= read["frequency"].isin(*_TERMS) & read["rebalance"].isin(*_TERMS)
    good &= read["neutralization"].isin("none", "industry", "size", "industry_size")
    good &= F.forall(windows, lambda w: w.isNotNull())
    fits = lambda e: reduce(and_, [e[p].isNull() | whole(e[p]).isNotNull() for p in places])
    good &= F.forall(spans, lambda e: e["chunk_id"].isNotNull() & e["quote"].isNotNull() & fits(e))
    return F.when(good, read.withField("windows", windows).withField("evidence", evidence))


def parse_spec(answer: Column) -> Column:
    """The record in an answer: a fenced JSON object, else first ``{`` to last ``}``; NULL if it is none."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return read_spec(F.when(fenced != "", fenced).otherwise(braced))


def candidate(payload: Column, seed: Column) -> Column:
    """The record that a tool call proposes, or NULL.

    The payload is the record, or holds it as ``spec``; one with ``factor_expr``
    is the seed with that expression and, if given, ``factor_name``.
    """
    inner = F.coalesce(F.get_json_object(payload, "$.spec"), payload)
    expr, name = (F.get_json_object(inner, f"$.factor_{f}") for f in ("expr", "name"))
    changed = seed.withField("name", F.coalesce(name, seed["name"])).withField("expr", expr)
    return F.when(expr.isNotNull(), changed).otherwise(read_spec(inner))


def tool_calls(answer: Column) -> Column:
    """(id, name, arguments) of each ``<tool_call>{...}</tool_call>``; empty if one is not JSON, see :func:`tool_call_error`."""
    found = _called(answer)

    def call(body: Column) -> Column:
        inner = F.coalesce(F.get_json_object(body, "$.function"), body)
        given = [F.get_json_object(inner, f"$.{k}") for k in ("arguments", "parameters")]
        return F.struct(F.get_json_object(body, "$.id").alias("id"), F.get_json_object(inner, "$.name").alias("name"), F.coalesce(*given, F.lit("{}")).alias("arguments"))

    return F.when(F.exists(found, lambda c: F.try_parse_json(c).isNull()), F.filter(F.transform(found, call), lambda c: F.lit(False))).otherwise(F.transform(found, call))


def tool_call_error(answer: Column) -> Column:
    """The first ``<tool_call>`` body that is not JSON, or NULL."""
    return F.try_element_at(F.filter(_called(answer), lambda c: F.try_parse_json(c).isNull()), F.lit(1))


def _called(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))


def joined_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, text): the pages of each document in turn, a blank line between them.

    The pages of one document meet in one row, which is the text itself.
    """
    each = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(text, F.lit("")).alias("t"))))
    return pages.groupBy(doc).agg(F.array_join(F.transform(each, lambda e: e["t"]), "\n\n").alias(text))


def dumps(value: Column, kind: T.DataType) -> Column:
    """JSON with ``, `` and ``: `` between its parts, nulls explicit and text as it is."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f'"{f.name}": '), dumps(value[f.name], f.dataType)) for f in kind]
        out = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: dumps(v, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.StringType):
        quoted = F.to_json(F.array(value))
        out = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    else:
        out = value.cast("string")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)
