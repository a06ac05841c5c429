"""Scoring rows as they arrive: the saved classifier on a streaming table.

Scoring is a chain of projections and one lookup in a static table, so it needs no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.classification import load_classifier


def score_stream(stream: DataFrame, model_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch scored and appended as Parquet; stops when the input is read."""
    scored = load_classifier(stream.sparkSession, model_path).score(stream)
    return (scored.writeStream.format("parquet").outputMode("append")
            .option("path", out_path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
