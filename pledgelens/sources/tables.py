"""Readers and writers: tables, snapshot envelopes and link lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..operators.columns import nan_to_null


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | t.StructType | None = None,
               **options) -> DataFrame:
    """A parquet, ORC, CSV or JSON table with one kind of missing value.

    Give text formats a schema: inference reads the data once more.
    """
    reader = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {}) | options)
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.load(path))


def spread(df: DataFrame, *keys: str, bytes_per_task: int = 64 << 20) -> DataFrame:
    """A small table dealt by its keys to all cores; a table with work for every core stays as it was read.

    A file of few row groups is read by as few tasks, however much is done with each row after.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if table_bytes(df) < cores * bytes_per_task else df


def table_bytes(df: DataFrame) -> int:
    """The size of a table's files as the planner knows it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(df: DataFrame, *keys: str, size: int, bytes_per_task: int = 4 << 20) -> DataFrame:
    """Rows that take long each, dealt by their keys to tasks of few of the ``size`` bytes that they come from.

    The number of tasks follows the table, not what a join before made of it.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, size // bytes_per_task), *keys)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] = (), **options) -> None:
    """Write a table; CSV gets a header row."""
    writer = df.write.format(fmt).mode(mode).options(**({"header": "true"} if fmt == "csv" else {}) | options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "csv") -> list[str]:
    """Write every table of a report under its name; returns the paths."""
    paths = []
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", fmt)
        paths.append(f"{path}/{name}")
    return paths


def read_snapshot(spark: SparkSession, path: str, item_schema: str | t.StructType | None = None) -> DataFrame:
    """Snapshot envelopes (whole JSON files) to one row per item."""
    reader = spark.read.option("multiLine", True)
    if item_schema is not None:
        items = item_schema if isinstance(item_schema, t.StructType) else t.StructType.fromDDL(item_schema)
        reader = reader.schema(t.StructType([t.StructField("items", t.ArrayType(items))]))
    return reader.json(path).select(F.inline("items"))


def snapshot_items(df: DataFrame, json_col: str, item_schema: str) -> DataFrame:
    """Items of envelopes that are held as JSON texts in a column."""
    parsed = F.from_json(F.get_json_object(json_col, "$.items"), f"array<struct<{item_schema}>>")
    return df.select(F.inline(parsed))


def snapshot_stats(records: DataFrame) -> DataFrame:
    """Totals of the envelope: all, completed, successful and failed items."""
    return records.agg(
        F.count(F.lit(1)).alias("total"), F.count("status").alias("completed"),
        F.count_if(F.col("status") == "ok").alias("success"), F.count_if(F.col("status") == "error").alias("failed"))


def write_snapshot(records: DataFrame, path: str) -> None:
    """Records as JSON lines, one file per partition."""
    records.write.mode("overwrite").json(path)


def split_ok_error(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with status ``ok`` and rows with status ``error``."""
    return records.where(F.col("status") == "ok"), records.where(F.col("status") == "error")


def link_list(df: DataFrame, json_col: str, normalize) -> DataFrame:
    """Distinct valid links of JSON texts: an array, or an object with ``urls`` or ``projectUrls``.

    ``normalize`` maps a column of raw links to clean links or null.
    """
    text = F.trim(F.col(json_col))
    arrays = "array<string>"
    urls = F.when(text.startswith("["), F.from_json(text, arrays)).otherwise(F.coalesce(
        F.from_json(F.get_json_object(text, "$.urls"), arrays),
        F.from_json(F.get_json_object(text, "$.projectUrls"), arrays),
        F.transform(F.from_json(F.get_json_object(text, "$.projectStates"), "array<struct<url:string>>"),
                    lambda s: s["url"])))
    return df.select(F.explode(urls).alias("raw")).select(normalize(F.col("raw")).alias("url")).where(
        "url is not null").distinct()


def link_states(df: DataFrame, json_col: str, normalize) -> DataFrame:
    """``(url, states)`` from the ``projectStates`` of JSON link lists."""
    states = F.from_json(
        F.get_json_object(json_col, "$.projectStates"), "array<struct<url:string,states:array<string>>>")
    return df.select(F.inline(states)).select(
        normalize(F.col("url")).alias("url"),
        F.filter(F.array_distinct(F.coalesce("states", F.array().cast("array<string>"))), lambda s: s.isNotNull())
        .alias("states")).where("url is not null")


def read_link_list(spark: SparkSession, path: str, normalize) -> DataFrame:
    """Distinct valid links of JSON link files."""
    return link_list(spark.read.text(path, wholetext=True), "value", normalize)


