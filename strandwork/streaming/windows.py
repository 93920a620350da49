"""The sliding-window activity as a stream, and an idempotent sink for it.

Late rows are taken up to the watermark; a window is final when the watermark has
passed its end.  The sink writes each window's partition anew, so a batch that is
run twice leaves the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_a_batch: int = 8) -> DataFrame:
    """Events of a folder of Parquet files, as they arrive."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed_activity(events: DataFrame, length: str = "7 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    """Changes, lines and (about how many) authors by window and subsystem; works on streams and tables alike."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", late) if e.isStreaming else e
    g = e.groupBy(F.window("at", length, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("lines"), F.approx_count_distinct("user_id").alias("authors"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "lines", "authors")


def write_windows(activity: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write finished and changed windows until all input there is has been read."""

    def batch(df: DataFrame, _: int) -> None:
        df.withColumn("day", F.to_date("window_start")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "event_type").parquet(path)

    return activity.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()
