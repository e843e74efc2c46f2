"""Roll-ups of result rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_result_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON-lines result files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def windowed_scores(rows: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Rows, mean score and tokens by window, system and type; rows later than ``late`` are left out."""
    return (
        rows.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "system", "type")
        .agg(F.count("*").alias("n"), F.avg("f1").alias("mean_f1"), F.sum("total_tokens").alias("tokens"))
        .select("window.start", "window.end", "system", "type", "n", "mean_f1", "tokens")
    )


def event_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events and summed value by window and type, on a stream or a table."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
