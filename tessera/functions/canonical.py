"""Canonical JSON of a column and its hash: keys sorted at every depth, no spaces, numbers as Python writes them.

Arrow batches of whole records are written by the function that hashes single
values on the driver, so both agree whatever a record holds; nothing is collected.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dumped(value: Any) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def stable_hash(value: Any) -> str:
    """SHA-256 of :func:`dumped`."""
    return hashlib.sha256(dumped(value).encode()).hexdigest()


def _checked(kind: T.DataType) -> None:
    """An error if a type, at whatever depth, has no JSON form."""
    if isinstance(kind, T.StructType):
        inner = [f.dataType for f in kind.fields]
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        inner = [kind.valueType]
    elif isinstance(kind, T.ArrayType):
        inner = [kind.elementType]
    elif isinstance(kind, (T.StringType, T.FractionalType, T.IntegralType, T.BooleanType, T.NullType)) and not isinstance(kind, T.DecimalType):
        inner = []
    else:
        raise TypeError(f"{kind.simpleString()} has no JSON form")
    for k in inner:
        _checked(k)


def _plain(value: Any, kind: pa.DataType) -> Any:
    """A value as JSON takes it: maps come out of Arrow as lists of pairs."""
    if value is None:
        return None
    if pa.types.is_struct(kind):
        return {f.name: _plain(value[f.name], f.type) for f in kind}
    if pa.types.is_map(kind):
        return {k: _plain(v, kind.item_type) for k, v in value}
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return [_plain(v, kind.value_type) for v in value]
    return value


def _written(rows: DataFrame, column: str, name: str, write) -> DataFrame:
    _checked(rows.schema[column].dataType)

    @F.arrow_udf(T.StringType())
    def shown(values: pa.Array) -> pa.Array:
        return pa.array([write(_plain(v, values.type)) for v in values.to_pylist()], pa.string())

    return rows.withColumn(name, shown(F.col(column)))


def with_json(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the canonical JSON of a column; a null is ``null``."""
    return _written(rows, column, name, dumped)


def with_hash(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the SHA-256 of a column's canonical JSON."""
    return _written(rows, column, name, stable_hash)
