"""Structured Streaming variants of operators that also make sense over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_metrics(events: DataFrame, *, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Count and mean per event type and window; state older than the watermark goes."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def first_seen(rows: DataFrame, key: list[str], *, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first row of each key; with an event time only keys within the watermark are remembered."""
    if time is None:
        return rows.dropDuplicates(key)
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def write_previews(previews: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch as a folder by step; a batch that is run again writes the same folder again."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").json(f"{path}/step_{number:08d}")

    return previews.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
