"""An optional extra: a headway monitor over a stream of departures, beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def departures(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream of events."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windows(events: DataFrame, length: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Departures and mean gap per route direction and window; events later than ``late`` are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), F.col("event_type").alias("route_dir"))
    sums = counted.agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    gap = (F.unix_timestamp("last") - F.unix_timestamp("first")) / (F.col("n") - 1)
    return sums.select("window.start", "window.end", "route_dir", "n", F.when(F.col("n") > 1, gap).alias("mean_gap_s"))
