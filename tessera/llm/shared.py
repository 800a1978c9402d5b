"""Staged tables, bucketed exchange and null keys used by the operators.

A stage is a Parquet table below the folder that the cluster names in
``spark.checkpoint.dir``: it cuts the lineage, every executor can read it, and
a lost executor only repeats the tasks that had not been committed.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside the kernels, and is turned back at the end.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Only a local session, whose tasks all run on this machine, gets a private
    one where none is set; elsewhere executors could not read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="stages-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, changed where ``docs`` has such a column (in any case)."""
    have, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


class _Held(threading.local):
    """Paths of the stages that this thread made and that are still there, so callers side by side keep their own."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_held = _Held()


#: Spark's setting to delete a query's shuffle files once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's bound on the bytes of a batch that goes to Python.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's bound on the rows that its Parquet reader holds at once, and ours where rows are long: texts and packed rows.
_READER = "spark.sql.parquet.columnarReaderBatchSize"
FEW_ROWS = {_READER: "128"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with these settings, which are then what they were."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stage(df: DataFrame, name: str, batch_bytes: int | None = None, **options) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's options, and return the table read back.

    Its shuffle files go as soon as it is written: nothing reads the plan again.
    ``batch_bytes`` bounds the batches that its Python functions get, for long
    rows, of which Spark's reader then holds few at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, {_CLEANUP: "true"} | (FEW_ROWS | {_BATCH: str(batch_bytes)} if batch_bytes else {})):
        df.write.options(**options).parquet(path)
    _held.paths.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stage_path = path
    return back


def keys_are_unique(rows: DataFrame, key: str) -> bool:
    """Whether no two rows have one key."""
    return rows.groupBy(key).count().where("count > 1").isEmpty()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _held.paths:
        _held.paths.remove(path)


def unstage(*tables: DataFrame) -> None:
    """Delete stages that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df._stage_path)


def staged() -> list[str]:
    """The stages that are there; what an operator adds to them its result may read."""
    return list(_held.paths)


def release(spark: SparkSession, before: list[str], *kept: DataFrame) -> None:
    """Delete the stages made since ``before`` was taken, but for those kept.

    For callers that have written the results that read them.
    """
    for path in set(_held.paths) - set(before) - {df._stage_path for df in kept}:
        _delete(spark, path)


def buckets(spark: SparkSession, size: int = 0, share: int = 1) -> int:
    """Buckets of an exchange: as many as the session has shuffle partitions, and more where ``size`` needs them for shares of ``share``."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // share))


def keyed(df: DataFrame, *columns: str, key: str = "doc_id") -> DataFrame:
    """The named columns, the key as a long without nulls (``NULL_ID``)."""
    return df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_ID)).alias(key), *[F.col(f"`{c}`") for c in columns])


def unkeyed(column: str = "doc_id"):
    """The key with its nulls again."""
    return F.nullif(F.col(column), F.lit(NULL_ID)).alias(column)


def split_rows(bucket: np.ndarray, nb: int, *columns: np.ndarray, pack=np.ndarray.tobytes):
    """For each bucket that has entries: (bucket, bytes of each column)."""
    order = np.argsort(bucket.astype(np.uint16 if nb <= 65536 else np.uint32), kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=nb))
    ordered = [c[order] for c in columns]
    lo = 0
    for b in range(nb):
        hi = int(ends[b])
        if hi > lo:
            yield b, [pack(c[lo:hi]) for c in ordered]
        lo = hi


def joined(column, dtype) -> np.ndarray:
    """The entries of a column of byte strings, one array."""
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in column if x.is_valid), dtype=dtype)


def planes(rows: np.ndarray) -> bytes:
    """Rows of fixed size as bytes, the first byte of all rows before the second of all: ids, places and lengths then shrink in the exchange."""
    return np.ascontiguousarray(rows).view(np.uint8).reshape(-1, rows.dtype.itemsize).T.tobytes()


def unplaned(column, dtype: np.dtype) -> np.ndarray:
    """The entries of a column of :func:`planes`, one array."""
    parts = [np.frombuffer(x.as_buffer(), np.uint8).reshape(dtype.itemsize, -1) for x in column if x.is_valid]
    out = np.empty(sum(p.shape[1] for p in parts), dtype)
    flat, at = out.view(np.uint8).reshape(-1, dtype.itemsize), 0
    for p in parts:
        flat[at : at + p.shape[1]] = p.T
        at += p.shape[1]
    return out


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)


def ids_of(column) -> np.ndarray:
    """A long column without nulls as a writable array."""
    return np.array(column.to_numpy(zero_copy_only=False), dtype=np.int64)


def grouped(work, **fixed):
    """``work(key, table, **fixed)`` in the form that applyInArrow takes."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return work(key, table, **fixed)

    return run


def by_bucket(df: DataFrame, work, schema: str, /, parts: int = 0, **fixed) -> DataFrame:
    """``work`` on each bucket; ``parts``: tasks that get as many buckets each, one more or less, however their hashes fall together."""
    if parts:
        df = df.repartitionById(parts, F.col("bucket"))
    return df.groupBy("bucket").applyInArrow(grouped(work, **fixed), schema)
