"""Structured Streaming: incremental indexing, a live frontier, page events.

The index stream reads new page files, builds their postings batch by batch
and appends them; the checkpoint resumes it where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import index


def index_stream(spark: SparkSession, pages_dir: str, schema, out_dir: str, checkpoint: str, on_batch=None):
    """Starts the stream over parquet pages; processes what is there, then stops.

    A batch writes to its own folder by batch id, so that a repeated batch
    replaces itself: postings land exactly once."""
    pages = spark.readStream.schema(schema).parquet(pages_dir)

    def write(batch: DataFrame, number: int) -> None:
        index.build(batch.where("status_code = 200")).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")
        if on_batch is not None:
            on_batch(number)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Events by window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def distinct_urls(urls: DataFrame, watermark: str = "6 hours") -> DataFrame:
    """Each url once within the watermark, whatever batch it comes in."""
    return urls.withWatermark("added_at", watermark).dropDuplicatesWithinWatermark(["url"])
