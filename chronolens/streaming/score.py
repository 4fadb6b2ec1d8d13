"""Scoring streams, and building series from an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolens.operators.model import Model, predict


def score_stream(series: DataFrame, model: Model) -> DataFrame:
    """Predictions of a streaming (id, x, …) DataFrame."""
    if not series.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return predict(series, model)


def daily_totals(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """(user_id, day, total) of an event stream; late rows beyond the watermark
    are dropped, and state older than it is freed."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy("user_id", F.window("ts", "1 day"))
        .agg(F.sum("value").alias("total"))
        .select("user_id", F.col("window.start").alias("day"), "total")
    )
