"""Writers: JSON lines, pools, run logs, panel exports with manifests, label batches and run reports.

All go through Spark's commit protocol, so a repeated or lost task leaves no half-written file.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import stable_hash, with_hash  # noqa: F401  both are this module's
from ..operators import market as M
from ..operators import probes as P
from ..operators import records as R
from .files import exists
from .folders import write_files

MANIFEST = "source string, start string, end string, warmup_start string, universes array<string>, instruments long, n_rows long, fields array<string>, hashes map<string, string>"
PANEL_FIELDS = ("open", "high", "low", "close", "volume", "amount", "return", "industry", "tradestatus", "isST")


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists", *partitions: str) -> None:
    """JSON lines; nulls stay explicit."""
    rows.write.mode(mode).partitionBy(*partitions).option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with headers; readers see all of them or none."""
    rows.write.mode(mode).option("header", True).csv(path)


def write_by_case(rows: DataFrame, path: str) -> None:
    """JSON lines, a folder for each case."""
    write_json(rows, path, "errorifexists", "case_id")


def write_one(row: DataFrame, path: str) -> None:
    """A report of a few rows as one file of JSON lines."""
    write_json(row.coalesce(1), path)


def write_pools(routed: DataFrame, path: str) -> DataFrame:
    """One folder of JSON lines for each route, and the counts, which are returned."""
    write_json(routed, f"{path}/pools", "errorifexists", "route")
    counts = R.histogram(routed, "route")
    write_json(counts, f"{path}/summary")
    return routed.sparkSession.read.schema("route string, n long").json(f"{path}/summary")


def identified(calls: DataFrame, spec: str = "spec", config: str = "config", payload: str = "payload") -> DataFrame:
    """``calls`` with the hashes under which a run log keeps them, as ``stable_hash`` gives them one by one.

    ``spec`` is a record with name and expr, ``config`` and ``payload`` are structs.
    """
    rows = calls.withColumns({"_e": F.struct(F.col(spec)["name"].alias("name"), F.col(spec)["expr"].alias("expr")), "_c": F.struct(F.col(config).alias("config"), F.col(payload).alias("payload"))})
    return with_hash(with_hash(rows, "_e", "expression_hash"), "_c", "config_hash").drop("_e", "_c")


def append_ledger(entries: DataFrame, path: str) -> None:
    """Adds entries to a run log; what is there is never changed."""
    whole = entries.withColumns({"run_id": F.coalesce("run_id", F.expr("uuid()")), "created_at": F.coalesce("created_at", F.unix_micros(F.current_timestamp()) / 1e6)})
    write_json(whole, path, "append")


def json_to_parquet(spark: SparkSession, source: str, path: str, schema: str) -> None:
    spark.read.schema(schema).option("mode", "FAILFAST").json(source).write.parquet(path)


def rows_hash(rows: DataFrame) -> str:
    """SHA-256 over the number of rows and the sum of their hashes: the same for any order and file layout."""
    names = sorted(rows.columns)
    n, total = rows.agg(F.count("*"), F.sum(F.xxhash64(*[F.struct(F.lit(c), F.col(f"`{c}`")) for c in names]).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{names}:{n}:{total}".encode()).hexdigest()


def export_panel(market: DataFrame, memberships: DataFrame, path: str, source: str, start: str, end: str) -> None:
    """Features by year, the trading calendar, membership ranges, spans of instruments, and a manifest."""
    if not M.duplicate_keys(market, "datetime", "instrument").isEmpty():
        raise ValueError("the market has repeated datetime and instrument")
    calendar = M.trading_calendar(market)
    if calendar.isEmpty():
        raise ValueError("the market has no trading day")
    spark, kept = market.sparkSession, [c for c in PANEL_FIELDS if c in market.columns]
    features = market.select("datetime", "instrument", *kept).withColumn("year", F.year("datetime"))
    features.repartition("year", F.pmod(F.xxhash64("instrument"), F.lit(16))).sortWithinPartitions("instrument", "datetime").write.partitionBy("year").parquet(f"{path}/features")
    calendar.write.parquet(f"{path}/calendar")
    M.membership_ranges(memberships, calendar.select("datetime")).write.parquet(f"{path}/ranges")
    market.groupBy("instrument").agg(F.min("datetime").alias("from"), F.max("datetime").alias("to")).write.parquet(f"{path}/spans")
    tables = ("features", "calendar", "ranges", "spans")
    hashes = {t: rows_hash(spark.read.parquet(f"{path}/{t}")) for t in tables}
    counts = M.coverage(spark.read.parquet(f"{path}/features"), "datetime", "instrument").first()
    universes = sorted(r[0] for r in M.snapshot_counts(memberships).select("universe").collect())  # a handful of named universes
    row = (source, start, end, start, universes, counts.n_instruments, counts.n_rows, kept, hashes)
    write_json(spark.createDataFrame([row], MANIFEST).coalesce(1), f"{path}/manifest")


def validate_manifest(spark: SparkSession, path: str, start: str, end: str) -> dict:
    """The manifest of an export that covers the period and whose tables are as they were written; else an error.

    What is wrong is listed as a whole: the first kind of fault that there is,
    with every table that has it.
    """
    where = f"{path}/manifest"
    found = json_first(spark, where, MANIFEST)
    if found is None:
        raise FileNotFoundError(f"{where} is not there")
    if not (found["start"] <= start and end <= found["end"]):
        raise ValueError(f"{start}..{end} is not within the data's {found['start']}..{found['end']}")
    lost = [t for t in sorted(found["hashes"]) if not exists(spark, f"{path}/{t}")]
    if lost:
        raise FileNotFoundError(f"tables of the export are gone: {', '.join(lost)}")
    changed = [t for t in sorted(found["hashes"]) if rows_hash(spark.read.parquet(f"{path}/{t}")) != found["hashes"][t]]
    if changed:
        raise ValueError(f"tables differ from when they were exported: {', '.join(changed)}")
    return found


def json_first(spark: SparkSession, path: str, schema: str) -> dict | None:
    """The first row of JSON lines, or None where there is no file."""
    rows = spark.read.schema(schema).json(path).head(1) if exists(spark, path) else []
    return rows[0].asDict() if rows else None


def binary_features(market: DataFrame, calendar: DataFrame) -> DataFrame:
    """(path, content) of vectors on disk: for each instrument and field the place of its first day and its values.

    Little-endian 32-bit floats over the calendar's days from the instrument's
    first to its last, NaN where there is no row.  One instrument's days are one
    group.
    """
    names = [c for c in PANEL_FIELDS if c in market.columns]
    days = calendar.select("datetime", "day_idx")
    rows = market.select("datetime", "instrument", *[F.col(c).cast("double").alias(c) for c in names]).join(F.broadcast(days), "datetime")  # one row a day

    def work(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.set_index("day_idx").sort_index()
        whole = frame.reindex(range(frame.index[0], frame.index[-1] + 1))
        content = [np.concatenate([[frame.index[0]], whole[c].to_numpy(float)]).astype("<f4").tobytes() for c in names]
        return pd.DataFrame({"path": [f"features/{str(key[0]).lower()}/{c}.day.bin" for c in names], "content": content})

    return rows.groupBy("instrument").applyInPandas(work, "path string, content binary")


def _listed(rows: DataFrame, path: Column, line: Column, *order: str) -> DataFrame:
    """(path, part, content) of text files of sorted lines: each task's lines of a file are a part of it."""
    rows = rows.select(path.alias("path"), line.alias("line"), *order)
    dealt = rows.repartitionByRange("path", *order).sortWithinPartitions("path", *order).select("path", "line", F.spark_partition_id().cast("long").alias("part"))

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, frame in enumerate(frames):
            each = frame.groupby(["path", "part"], sort=False)["line"].agg("\n".join).reset_index()
            yield each.assign(part=each["part"] * 2**32 + n, content=(each["line"] + "\n").str.encode("utf-8"))[["path", "part", "content"]]

    return dealt.mapInPandas(joined, "path string, part long, content binary")


def export_binary(market: DataFrame, memberships: DataFrame, root: str) -> int:
    """The panel as vectors, a calendar and spans of instruments in text files; returns the number of files.

    ``root`` is a folder that the driver and all executors mount.  Tasks write,
    and files appear when all have ended (:func:`folders.write_files`); lists are
    written in parts, so no list is one task's.
    """
    calendar = M.trading_calendar(market)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    ranges = M.membership_ranges(memberships, calendar.select("datetime"))
    spans = market.groupBy("instrument").agg(F.min("datetime").alias("from"), F.max("datetime").alias("to")).withColumn("universe", F.lit("all"))
    lists = ranges.select("universe", "instrument", "from", "to").unionByName(spans.select("universe", "instrument", "from", "to"))
    made = binary_features(market, calendar).select("path", F.lit(0).cast("long").alias("part"), "content")
    made = made.unionByName(_listed(calendar, F.lit("calendars/day.txt"), day("datetime"), "datetime"))
    place = F.concat(F.lit("instruments/"), F.lower("universe"), F.lit(".txt"))
    made = made.unionByName(_listed(lists, place, F.concat_ws("\t", "instrument", day("from"), day("to")), "instrument", "from", "to"))
    write_files(made, root)
    fields = sum(c in market.columns for c in PANEL_FIELDS)
    return spans.count() * fields + 1 + lists.select(F.lower("universe")).distinct().count()


def write_batch(cases: DataFrame, reports: DataFrame, path: str, batch_id: str, need_evidence: bool = True) -> DataFrame:
    """A label batch: four JSON texts a case with their hashes, and a manifest, which is returned.

    ``cases`` are as ``files.cases`` reads them; ``reports`` have doc_id, content_hash
    and text.  A group in both splits, a case without report, or (if evidence is
    needed) a label with open requirements is an error and nothing is written.
    """
    keyed = cases.withColumns({"_doc": F.col("document.doc_id"), "group": P.case_group()})
    R.assert_no_leak(keyed, "case_id")
    R.assert_no_leak(keyed, "group")
    P.none_of(keyed.join(reports.select(F.col("doc_id").alias("_doc")), "_doc", "left_anti"), "case_id", "missing report snapshot for case")
    if need_evidence:
        P.none_of(keyed.where(F.size(P.missing_requirements(F.col("gold"))) > 0), "case_id", "not a usable label: case")
    found = keyed.join(reports.select(F.col("doc_id").alias("_doc"), F.struct("doc_id", "content_hash", "text").alias("_report")), "_doc")
    rules = json.dumps({"weights": R.WEIGHTS, "caps": {c: R.CAPS[c] for c in ("invalid_json_cap", "illegal_expr_cap", "hallucinated_expr_cap")}}, sort_keys=True)
    shown = F.struct(*[c for c in cases.columns if c not in ("gold", "report")])
    body = {"case": F.to_json(shown), "report": F.to_json("_report"), "verifier": F.lit(rules), "gold": F.to_json(F.struct("case_id", "gold"))}
    rows = found.select("case_id", F.col("group").alias("group_id"), "split", *[b.alias(f"{n}_json") for n, b in body.items()])
    rows = rows.withColumn("content_hashes", F.create_map(*[x for n in body for x in (F.lit(n), F.sha2(f"{n}_json", 256))]))
    rows.write.partitionBy("split").parquet(f"{path}/batch")
    back = cases.sparkSession.read.parquet(f"{path}/batch")
    parts = {"case": "case_path", "report": "report_snapshot_path", "verifier": "verifier_spec_path", "gold": "gold_path"}
    places = [F.concat(F.lit(f"{path}/batch?column={n}_json&case_id="), "case_id").alias(p) for n, p in parts.items()]
    entries = back.select(F.lit(batch_id).alias("batch_id"), "case_id", "group_id", "split", *places, "content_hashes", F.lit("factor_batch_v1").alias("version"))
    write_json(entries, f"{path}/manifest")
    return entries


def write_rollouts(rollouts: DataFrame, path: str) -> None:
    """Appends scored rollouts; several runs share one folder."""
    write_json(rollouts, path, "append")


def store_rollouts(trajectories: DataFrame, path: str, run_id: str) -> DataFrame:
    """Keeps whole rollouts and appends their records, which are returned.

    ``trajectories`` have rollout_id, case_id, stage, steps (array of role and
    content), reward, caps, audit (tool_calls, illegal_tool_calls,
    illegal_by_kind) and, if known, tools, metadata and the two columns of
    log-probabilities.  The trajectory, the score and the rest go to three
    tables by case; the prompt is the steps of system and user.
    """
    kept = F.filter("steps", lambda s: s["role"].isin("system", "user"))
    prompt = F.transform(kept, lambda s: F.struct(s["content"].alias("content"), s["role"].alias("role")))
    have, text = set(trajectories.columns), F.lit(None).cast("string")
    optional = {c: F.col(c) if c in have else F.lit(None).cast(t) for c, t in (("metadata", "map<string, string>"), ("rollout_log_probs", "array<double>"), ("training_log_probs", "array<double>"))}
    rows = trajectories.withColumns(
        {
            "run_id": F.lit(run_id),
            "prompt": prompt,
            "tool_schemas": F.coalesce(F.col("tools") if "tools" in have else text, F.lit("[]")),
            "place": F.concat_ws("/", F.lit(path), F.lit("{}"), F.concat(F.lit("case_id="), "case_id"), "rollout_id"),
            **optional,
        }
    )
    rows = with_hash(rows, "prompt", "prompt_hash").withColumn("tool_schema_hash", F.sha2("tool_schemas", 256))
    parts = {"trajectory": ["stage", "steps"], "score": ["reward", "caps"], "metadata": ["prompt", "tool_schemas", "prompt_hash", "tool_schema_hash", *optional]}
    for name, columns in parts.items():
        write_json(rows.select("run_id", "rollout_id", "case_id", *columns), f"{path}/{name}", "append", "case_id")
    calls = {c: F.coalesce(F.col(f"audit.{c}"), F.lit(0)).cast("long").alias(c) for c in ("tool_calls", "illegal_tool_calls")}
    place = lambda n: F.replace("place", F.lit("{}"), F.lit(n))
    records = rows.select(
        "run_id", "rollout_id", "case_id", "stage", "reward", F.col("caps").alias("active_caps"), *calls.values(), F.col("audit.illegal_by_kind").alias("illegal_by_kind"),
        "prompt_hash", "tool_schema_hash", place("trajectory").alias("trajectory_path"), place("score").alias("score_path"), "metadata",
    )
    write_rollouts(records, f"{path}/scores")
    return records


def write_run_report(records: DataFrame, path: str, routed: DataFrame | None = None) -> DataFrame:
    """The one-row summary of a run as JSON and as Markdown lines; returned."""
    summary = P.run_summary(records, routed)
    write_json(summary.coalesce(1), f"{path}/summary")
    back = records.sparkSession.read.schema(summary.schema).json(f"{path}/summary")
    lines = [F.lit("# Run report"), F.lit("")] + [F.concat(F.lit(f"- `{c}`: "), F.to_json(c) if t.startswith("map") else F.col(c).cast("string")) for c, t in back.dtypes]
    back.select(F.array_join(F.array(*lines), "\n", "").alias("value")).coalesce(1).write.text(f"{path}/report")
    return back
