"""Readers of record, report and market files; nothing is collected but existence checks and bounds."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import market as M
from . import downloads

_EVIDENCE = "array<struct<chunk_id: string, quote: string, page_start: int, page_end: int, char_start: int, char_end: int>>"
_SPEC = "struct<name: string, universe: string, frequency: string, neutralization: string, rebalance: string, expr: string, windows: array<string>, evidence: {0}>".format(_EVIDENCE)
_DOCUMENT = "struct<doc_id: string, source_path: string, source_format: string, title: string, institution: string, series: string, published_at: string, content_hash: string>"
CASES = f"case_id string, id string, caseId string, report string, gold {_SPEC}, spec {_SPEC}, split string, max_steps int, version string, notes string, group_id string, document {_DOCUMENT}"
LEDGER = "run_id string, namespace string, case_id string, expression_hash string, period string, config_hash string, request string, result struct<ok: boolean, metric: double, error: string>, created_at double"
ROLLOUTS = (
    "case_id string, reward double, active_caps array<string>, tool_calls long, illegal_tool_calls long, illegal_by_kind map<string, long>, tool_error_model long, "
    "tool_error_environment long, parse_error boolean, grounding_error boolean, spec_drift boolean, backtest_failed boolean, max_step_hit boolean"
)
PRICE_NUMBERS = ("open", "high", "low", "close", "volume", "amount", "pctChg")
PRICE_FLAGS = ("tradestatus", "isST")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a fixed schema: unknown keys and blank lines are ignored, a broken line is an error, no file is no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _whole(spec: Column) -> Column:
    """The struct with integer windows (texts of numbers count) and without null lists."""
    windows = F.coalesce(F.transform(spec["windows"], lambda w: w.try_cast("int")), F.array().cast("array<int>"))
    return spec.withField("windows", windows).withField("evidence", F.coalesce(spec["evidence"], F.array().cast(_EVIDENCE)))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases; ``id`` or ``caseId`` stand for ``case_id``, ``spec`` for ``gold``."""
    rows, full = json_rows(spark, path, CASES), lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.select(
        F.coalesce("case_id", full("id"), full("caseId"), F.lit("unknown")).alias("case_id"),
        "report",
        _whole(F.coalesce("gold", "spec")).alias("gold"),
        F.coalesce("split", F.lit("train")).alias("split"),
        F.coalesce("max_steps", F.lit(4)).alias("max_steps"),
        F.coalesce("version", F.lit("factor_case_v1")).alias("version"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("notes", "group_id")],
        "document",
    )


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a run log, with ``ok`` and an ``entry_id`` for ties, as ``latest_success`` takes them."""
    rows = json_rows(spark, path, LEDGER)
    return rows.withColumns({"ok": F.coalesce("result.ok", F.lit(False)), "entry_id": F.col("run_id")})


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Text and Markdown files, one row each: doc_id, source_path, source_format, content_hash, text.

    The hash is of the file's text; ``text`` has each Chinese numeral's value added.
    """
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_path"))
    marked = F.lower("source_path").rlike(r"\.(md|markdown)$")
    return raw.select(
        X.document_id(F.col("value")).alias("doc_id"),
        "source_path",
        F.when(marked, "markdown").otherwise("text").alias("source_format"),
        X.content_hash(F.col("value")).alias("content_hash"),
        X.with_numerals("value").alias("text"),
    )


def report_chunks(read: DataFrame, size: int = 1800, overlap: int = 200) -> DataFrame:
    """``reports`` cut to chunks with their ids."""
    rows = X.chunks(read, size=size, overlap=overlap)
    return rows.select("doc_id", X.chunk_id(F.lit(None).cast("int"), F.col("chunk_no")).alias("chunk_id"), F.lit(None).cast("int").alias("page_start"), "char_start", "char_end", F.col("chunk").alias("text"))


def prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from CSV files with headers: numbers and flags coerced, return from the percent change, one row a key."""
    names = ["date", "code", *PRICE_NUMBERS, *PRICE_FLAGS]
    rows = spark.read.option("header", True).option("enforceSchema", False).schema(", ".join(f"`{c}` string" for c in names)).csv(path)
    return bars(rows.withColumn("instrument", M.instrument_code(F.col("code"))))


def bars(rows: DataFrame) -> DataFrame:
    """Bars as a vendor writes them, all texts, with types, returns and one row a key."""
    rows = M.coerced(rows, list(PRICE_NUMBERS), list(PRICE_FLAGS))
    rows = rows.withColumns({"datetime": F.to_date("date"), "return": F.col("pctChg") / 100})
    rows = rows.select("datetime", "instrument", *PRICE_NUMBERS[:-1], "return", *PRICE_FLAGS)
    return M.first_of(rows, ["datetime", "instrument"], [*PRICE_NUMBERS[:-1], "return", *PRICE_FLAGS])


def snapshots(spark: SparkSession, path: str, *columns: str, asked: str | None = None) -> DataFrame:
    """Dated snapshots from CSV, repeated rows once; a blank date is the date that was asked for."""
    rows = spark.read.option("header", True).option("enforceSchema", False).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    blank = F.coalesce(F.trim("date"), F.lit("")) == ""
    return rows.withColumn("date", F.to_date(F.when(blank, F.lit(asked)).otherwise(F.col("date")))).distinct()


def snapshots_cover(memberships: DataFrame, industries: DataFrame, start: str, end: str, universes: Iterable[str]) -> bool:
    """Whether stored snapshots have the columns, universes and dates that a period needs; one small aggregate of each."""
    if not {"universe", "date", "instrument"} <= set(memberships.columns) or not {"date", "instrument", "industry"} <= set(industries.columns):
        return False
    day = lambda s: F.lit(s).cast("date")
    wanted = sorted(set(universes))
    held = F.count_distinct(F.when(F.col("universe").isin(wanted), F.col("universe"))) == len(wanted)
    span = (F.min("date") <= day(start)) & (F.max("date") >= F.date_sub(day(end), 10))
    known = (F.min("date") <= F.date_add(day(start), 31)) & (F.year(F.max("date")) >= F.year(day(end)))
    return bool(memberships.agg((held & span).alias("ok")).first().ok) and bool(industries.agg(known.alias("ok")).first().ok)


def fetched(instruments: DataFrame, fetch: Callable[[list[str]], pd.DataFrame], schema: str, batch: int = 10, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Rows that ``fetch`` returns for batches of the column ``instrument``, fetched by the executors, a task for each batch.

    A failed batch is tried again after 1, 2, 4, ... times ``wait`` seconds; the
    last failure is raised, so Spark repeats the task.  The driver deals the
    instruments out, some thousand short names.
    """
    keys = [r.instrument for r in instruments.select("instrument").distinct().orderBy("instrument").collect()]
    return downloads.fetched(instruments.sparkSession, keys, fetch, schema, batch, tries, wait)


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """(datetime, day_idx, traded) of an exported panel; every day of it is one that traded."""
    return spark.read.parquet(f"{path}/calendar").select("datetime", "day_idx", F.lit(True).alias("traded"))


def market_panel(spark: SparkSession, path: str, universe: str | None, fields: list[str], start: str, end: str) -> DataFrame:
    """Pruned scan of an exported panel: its fields, dates, and the rows within the universe's memberships.

    Whether there can be rows is asked of the small tables of ranges or spans.
    """
    day = lambda s: F.lit(s).cast("date")
    held = spark.read.parquet(f"{path}/ranges").where(F.col("universe") == universe) if universe else spark.read.parquet(f"{path}/spans")
    if held.where((F.col("from") <= day(end)) & (F.col("to") >= day(start))).isEmpty():
        raise ValueError(f"no market rows of {universe} from {start} to {end}")
    rows = spark.read.parquet(f"{path}/features")
    rows = rows.where(F.col("year").between(int(start[:4]), int(end[:4])) & F.col("datetime").between(day(start), day(end)))
    rows = rows.select("datetime", "instrument", *fields)
    return M.within_membership(rows, held) if universe else rows


def pdf_texts(content: bytes) -> list[str]:
    """The texts of a PDF's pages, by pypdf where it is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files takes the package pypdf") from e
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def pdf_pages(spark: SparkSession, path: str, texts: Callable[[bytes], list[str]] = pdf_texts) -> DataFrame:
    """(source_path, page, text) of PDF files, pages from 1; ``texts`` reads one file's pages."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                pages = texts(bytes(content))
                yield pd.DataFrame({"source_path": name, "page": range(1, len(pages) + 1), "text": pages})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content").mapInPandas(work, "source_path string, page int, text string")


def pdf_reports(pages: DataFrame) -> DataFrame:
    """``reports`` out of pages: a blank line between pages, the hash of the text without added numerals."""
    raw, shown = X.joined_pages(pages, "source_path"), X.joined_pages(pages.withColumn("text", X.with_numerals("text")), "source_path")
    raw = raw.select("source_path", X.document_id(F.col("text")).alias("doc_id"), X.content_hash(F.col("text")).alias("content_hash"))
    return raw.join(shown, "source_path").select("doc_id", "source_path", F.lit("pdf").alias("source_format"), "content_hash", "text")


def page_chunks(pages: DataFrame, size: int = 1800, overlap: int = 200) -> DataFrame:
    """Pages cut to chunks with their page's number; chunk numbers begin anew on each page."""
    rows = X.chunks(pages.withColumn("text", X.with_numerals("text")), size=size, overlap=overlap)
    page = F.col("page")
    return rows.select("source_path", X.chunk_id(page, F.col("chunk_no")).alias("chunk_id"), page.alias("page_start"), page.alias("page_end"), "char_start", "char_end", F.col("chunk").alias("text"))


#: Schemas of the other JSON lines that commands read: pairs of records, and samples of log-probabilities.
PAIRS = f"case_id string, seed {_SPEC}, evolved {_SPEC}"
SAMPLES = "rollout_log_probs array<double>, training_log_probs array<double>, response_mask array<int>"


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, seed, evolved) records to be compared."""
    return json_rows(spark, path, PAIRS).select("case_id", _whole(F.col("seed")).alias("seed"), _whole(F.col("evolved")).alias("evolved"))


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Log-probabilities of rollouts as ``records.correction_report`` takes them."""
    return json_rows(spark, path, SAMPLES)
