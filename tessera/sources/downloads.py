"""Downloads as a Spark data source, and a cache of them that knows what it covers.

A download is dealt to batches; each is one input partition, so there are as many
tasks as batches whatever their sizes, and Spark repeats those that were lost.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def batched(spark: SparkSession, batches: list, read: Callable[[Any], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """The frames that ``read`` yields for each batch; one input partition, and so one task, a batch.

    ``read`` runs on the executors.  Columns are those of ``schema`` by name, in
    any order; other columns are left out, columns that a frame lacks are null.
    """
    fields, label = StructType.fromDDL(schema), f"batches-{uuid.uuid4().hex}"
    arrow = to_arrow_schema(fields)

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(b) for b in batches]

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            for frame in read(partition.value):
                if n := len(frame):
                    yield pa.RecordBatch.from_arrays([pa.array(frame[f.name], f.type, from_pandas=True) if f.name in frame else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    class Batches(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> StructType:
            return fields

        def reader(self, schema: StructType) -> Reader:
            return Reader()

    if not batches:
        return spark.createDataFrame([], fields)
    spark.dataSource.register(Batches)
    return spark.read.format(label).load()


def attempts(work: Callable[[], Any], tries: int, wait: float) -> Any:
    """What ``work`` returns, tried again after 1, 2, 4, ... times ``wait`` seconds; the last failure is raised."""
    for attempt in range(tries):
        try:
            return work()
        except Exception:
            if attempt == tries - 1:
                raise
            time.sleep(wait * 2**attempt)


def fetched(spark: SparkSession, keys: list[str], fetch: Callable[[list[str]], pd.DataFrame], schema: str, batch: int = 10, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Rows that ``fetch`` returns for batches of keys; a batch that keeps failing fails the job."""

    def read(codes: list[str]) -> Iterator[pd.DataFrame]:
        yield attempts(lambda: fetch(codes), tries, wait)

    return batched(spark, [keys[i : i + batch] for i in range(0, len(keys), batch)], read, schema)


class RangeCache:
    """Rows by key and day in one Parquet table, with a record of the days that were asked for.

    ``fields`` are texts, of which ``date`` is the day.  Each answer to (key, first
    day, last day) is kept as its rows and one row without a date, which says what
    was asked, how many rows came and what went wrong.  Rows and records are
    committed by one write for each ``wave`` of batches, so a run that breaks
    loses the wave at most, and a key that fails loses nothing of the others.
    """

    def __init__(self, spark: SparkSession, path: str, fields: list[str], batch: int = 10, wave: int = 64):
        self.spark, self.path, self.fields, self.batch, self.wave = spark, path, fields, batch, wave
        self.schema = ", ".join(f"`{c}` string" for c in fields) + ", key string, first date, last date, n long, error string"

    def _rows(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(self.schema).parquet(self.path) if there else self.spark.createDataFrame([], self.schema)

    def covered(self) -> DataFrame:
        """(key, first, last) ranges that were answered; a key without any row counts as not answered."""
        good = self._rows().where("date is null and error is null").select("key", "first", "last", "n")
        return good.withColumn("held", F.sum("n").over(W.partitionBy("key"))).where("held > 0").select("key", "first", "last").distinct()

    def gaps(self, keys: DataFrame, start: str, end: str) -> DataFrame:
        """(key, first, last): the days of the period that the cache lacks for each of ``keys``."""
        a, z = F.lit(start).cast("date"), F.lit(end).cast("date")
        wanted = keys.select("key").distinct()
        held = self.covered().join(wanted, "key", "left_semi").where((F.col("last") >= a) & (F.col("first") <= z))
        marks = held.unionByName(wanted.select("key", F.date_add(z, 1).alias("first"), F.date_add(z, 1).alias("last")))
        before = W.partitionBy("key").orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1)
        open_ = marks.withColumn("from", F.coalesce(F.date_add(F.max("last").over(before), 1), a))
        return open_.where(F.col("from") < F.col("first")).select("key", F.greatest("from", a).alias("first"), F.date_sub("first", 1).alias("last"))

    def fill(self, keys: DataFrame, start: str, end: str, fetch: Callable[[list[tuple[str, str, str]]], Iterator[tuple[pd.DataFrame | None, str | None]]]) -> None:
        """Fetches what is lacking; keys that failed or have no rows at all are told in one error, after all others are kept.

        ``fetch`` gets a batch of (key, first, last) and yields for each its rows,
        or None and what went wrong.  Days from today on are not recorded as
        covered, so they are asked for again.
        """
        lacking = [(r.key, str(r.first_day), str(r.last_day)) for r in self.gaps(keys, start, end).select("key", F.col("first").alias("first_day"), F.col("last").alias("last_day")).orderBy("key", "first").collect()]
        batches = [lacking[i : i + self.batch] for i in range(0, len(lacking), self.batch)]

        def read(asked: list[tuple[str, str, str]]) -> Iterator[pd.DataFrame]:
            for (key, first, last), (rows, error) in zip(asked, fetch(asked)):
                a, z = dt.date.fromisoformat(first), min(dt.date.fromisoformat(last), dt.date.today() - dt.timedelta(1))
                if rows is not None and len(rows):
                    yield rows.assign(key=key)
                if error is not None or z >= a or not len(rows):
                    yield pd.DataFrame({"key": [key], "first": [a], "last": [z], "n": [0 if rows is None else len(rows)], "error": [error]})

        for i in range(0, len(batches), self.wave):
            batched(self.spark, batches[i : i + self.wave], read, self.schema).write.mode("append").parquet(self.path)
        if not lacking:
            return
        asked = self.spark.createDataFrame([(k,) for k, _, _ in lacking], "key string").distinct()
        left = self.gaps(asked, start, min(end, str(dt.date.today() - dt.timedelta(1)))).select("key").distinct()
        why = self._rows().where("error is not null").groupBy("key").agg(F.max("error").alias("error"))
        failed = left.join(why, "key", "left").select("key", F.coalesce("error", F.lit("no rows")).alias("error")).orderBy("key")
        if n := failed.count():
            raise RuntimeError(f"{n} of {asked.count()} keys could not be fetched, all others are kept: " + "; ".join(f"{r.key}: {r.error}" for r in failed.limit(5).collect()))

    def rows(self, keys: DataFrame, start: str, end: str) -> DataFrame:
        """The rows of the keys within the period, with the column ``key``; repeats of fetches that overlap stay."""
        found = self._rows().where(F.col("date").between(start, end)).select(*[F.col(f"`{c}`") for c in self.fields], "key")
        return found.join(keys.select("key").distinct(), "key", "left_semi")
