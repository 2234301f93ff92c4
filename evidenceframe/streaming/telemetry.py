"""Telemetry over event time. An extension: the batch summary by window, with a watermark for late samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sample_stream(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", per_trigger: int = 64) -> DataFrame:
    """Samples from Parquet files as they arrive. Event time is taken as UTC."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("mem_mib"), (F.col("user_id") % 101).cast("double").alias("util_pct"))


def windowed_summary(samples: DataFrame, width: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """Samples, peak and mean by window; works on batches (late=None) and streams alike."""
    rows = samples.withWatermark("ts", late) if late else samples
    g = rows.groupBy(F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("samples"), F.max("mem_mib").alias("peak_mem"), F.avg("mem_mib").alias("mean_mem"), F.max("util_pct").alias("peak_util"))
    return g.select(F.col("w.start").alias("window_start"), "samples", "peak_mem", "mean_mem", "peak_util")


def run_to_table(summary: DataFrame, name: str, checkpoint: str):
    """Append closed windows to a table until no input is left."""
    return summary.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).toTable(name)
