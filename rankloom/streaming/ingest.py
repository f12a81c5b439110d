"""Structured Streaming beside the daily batches (the reference has none): mention windows and bar upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def mention_windows(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Mentions and mean value of each user in event-time windows; rows later than the watermark are left out."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window, "user_id").agg(F.count(F.lit(1)).alias("mentions"), F.avg("value").alias("mean_value"))


def bar_batches(ticks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's bars into the partitions of its days; a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, epoch: int) -> None:
        bars = batch.groupBy("ticker", F.to_date("ts").alias("date")).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"))
        bars.withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(path)

    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
