"""Text features for arriving documents with frozen parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.lexicons import RUSSIAN, LanguagePack
from ..operators.features import extract_text_features
from ..operators.scaling import Scaler


def score_documents(df: DataFrame, text_col: str, scaler: Scaler, pack: LanguagePack = RUSSIAN) -> DataFrame:
    """Features scaled by the frozen parameters; works on batch and stream alike.

    Each row is handled on its own, so a stream needs no state and no watermark.
    """
    return scaler.transform(extract_text_features(df, text_col, pack))


def score_stream(
    stream: DataFrame, text_col: str, scaler: Scaler, path: str, checkpoint: str, pack: LanguagePack = RUSSIAN,
    available_now: bool = False,
) -> StreamingQuery:
    """Write scored documents as they arrive, each exactly once."""
    writer = (
        score_documents(stream, text_col, scaler, pack).writeStream.format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint).outputMode("append"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
