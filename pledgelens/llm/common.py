"""Helpers shared by the training-data operators: tables, intermediate tables, Arrow columns."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pledgelens.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the cluster's shared folder: a cut in the lineage that outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that a task holds the Python objects of few texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null is an empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The texts of a column; null is an empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def extended(batch: pa.RecordBatch, drop: Iterable[str] = (), **columns: pa.Array) -> pa.RecordBatch:
    """The batch without ``drop`` and with ``columns`` at its end, in place of columns so named."""
    gone = {*drop, *columns}
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in gone]
    names = [n for n, _ in kept] + list(columns)
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(columns.values()), names=names)


def schema_with(df: DataFrame, drop: Iterable[str] = (), **columns: str) -> str:
    """The schema that ``extended`` gives, as DDL."""
    gone = {*drop, *columns}
    parts = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in gone]
    return ", ".join(parts + [f"`{n}` {t}" for n, t in columns.items()])


def wrapped(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others in the struct ``__rest``, so that no name can clash."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in names]
    return df.select(*names, F.struct(F.lit(0).alias("__none"), *rest).alias("__rest"))


def unwrapped(df: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """``columns`` as they were before ``wrapped``, with the present values of the named ones."""
    return df.select(*[F.col(c) if c in names else F.col("__rest")[c].alias(c) for c in columns])


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
