"""Hourly counts and sums of events, over a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """event_type, hour, n, total; on a stream, hours close once the watermark has passed them."""
    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    out = seen.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").alias("hour"), "n", "total")


def hourly_stream(spark: SparkSession, folder: str, schema, checkpoint: str, name: str):
    """Starts the query over Parquet files that appear in a folder, into a memory table."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return hourly(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
