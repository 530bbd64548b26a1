"""An extension beyond batch queries: latency and outcomes of runs as they are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(runs: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Per window of created_at and method: runs, mean latency, abstentions, errors. runs may be a stream or a table."""
    total = F.col("preprocess_ms") + F.col("inference_ms") + F.col("postprocess_ms")
    rows = runs.withWatermark("created_at", late) if runs.isStreaming else runs
    return rows.groupBy(F.window("created_at", width).alias("w"), "method").agg(F.count("*").alias("n"), F.avg(total).alias("mean_ms"), F.count_if(F.col("outcome") == "empty").alias("abstained"), F.count_if(F.col("outcome") == "error").alias("errors")).select(F.col("w.start").alias("start"), "method", "n", "mean_ms", "abstained", "errors")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Per user the stretches of events with no pause of `gap`."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def first_of_each(runs: DataFrame, late: str = "2 days") -> DataFrame:
    """Runs without repeats of the same image, method and time."""
    if runs.isStreaming:
        return runs.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["image_id", "method"])
    return runs.dropDuplicates(["image_id", "method"])
