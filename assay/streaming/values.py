"""Metric values and late outcomes as streams.

Readings arrive as files, out of order and sometimes twice. A watermark bounds what has to be remembered: repeats within it are dropped, later ones
no longer are, and readings that come after their window is closed are left out of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VALUES = "run_id string, task string, metric_key string, metric_ord int, value double, computed_at timestamp"
OUTCOMES = "record_id string, deployed_at timestamp, incident boolean, label int"
RECORDS = "record_id string, logged_at timestamp, task string"


def read(spark: SparkSession, folder: str, schema: str = VALUES, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(values: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each reading of a run and metric once within the watermark."""
    return values.withWatermark("computed_at", delay).dropDuplicatesWithinWatermark(["run_id", "metric_key"])


def daily(values: DataFrame, delay: str = "7 days", width: str = "1 day") -> DataFrame:
    """Readings per metric and window: count, mean and extremes. NaN and null readings are counted but not averaged."""
    known = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("value"))
    grouped = values.withWatermark("computed_at", delay).groupBy(F.window("computed_at", width).alias("w"), "metric_key")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.count(known).alias("known"), F.avg(known).alias("mean"), F.min(known).alias("least"), F.max(known).alias("most")).select(F.col("w.start").alias("start"), "metric_key", "n", "known", "mean", "least", "most")


def with_outcomes(records: DataFrame, outcomes: DataFrame, patience: str = "180 days", delay: str = "1 day") -> DataFrame:
    """Records with the outcome that comes later, up to `patience` after them; those without one come out with nulls when it has passed."""
    left = records.withWatermark("logged_at", delay)
    right = outcomes.withColumnRenamed("record_id", "_record").withWatermark("deployed_at", delay)
    window = (F.col("record_id") == F.col("_record")) & (F.col("deployed_at") >= F.col("logged_at")) & (F.col("deployed_at") <= F.col("logged_at") + F.expr(f"interval {patience}"))
    return left.join(right, window, "leftOuter").drop("_record")


def write(df: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """All that is there now, then stop; the checkpoint folder must be one that all executors share."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
