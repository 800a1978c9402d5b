"""Run logs as streams: files that runs append are read as they come, and figures kept up to date.

The readers and sinks of batches (``files``, ``sinks``) use the same schemas, so
a log can be read either way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import records as R
from ..sources import files


def rollouts(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """Scored rollouts appended below ``path``; a broken line ends the stream."""
    return spark.readStream.schema(files.ROLLOUTS).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_at_once).json(path)


def case_metrics(stream: DataFrame) -> DataFrame:
    """The metrics of each case over all that has come; one state row a case."""
    return R.group_metrics(stream)


def window_metrics(stream: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rollouts, mean reward and illegal calls of each window of event time; rows later than ``late`` are left out.

    With the watermark a window's row is final, and its state goes, once it has passed.
    """
    calls, bad = F.sum(F.coalesce("tool_calls", F.lit(0))), F.sum(F.coalesce("illegal_tool_calls", F.lit(0)))
    rows = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"))
    out = rows.agg(F.count("*").alias("n"), F.avg("reward").alias("mean_reward"), F.coalesce(F.try_divide(bad, calls), F.lit(0.0)).alias("illegal_tool_call_rate"))
    return out.select("w.start", "w.end", "n", "mean_reward", "illegal_tool_call_rate")


def keep(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", **options: str) -> StreamingQuery:
    """Writes a stream to Parquet (append) until what is there has been read; started again, it goes on where it was."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).format("parquet").start(path)


def keep_latest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of the newest row of each key of an aggregate in update mode.

    Each batch goes to a folder of its own, so a repeated batch replaces itself;
    :func:`latest` reads them.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of each key that :func:`keep_latest` wrote."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "batch").alias("r"))
    return newest.select(key, "r.*").drop("batch")
