"""Tables in the cluster's shared folder: cuts in the lineage that outlive executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import shared_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
