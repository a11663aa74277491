"""Streams over the events table: files as the source, event-time windows with watermarks, exactly-once file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import fresh_path


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at `path`, with the schema that they have now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and their summed value by event-time window and type; state older than the watermark is dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_to_end(df: DataFrame, mode: str, path: str, checkpoint: str) -> None:
    """Process all that is there, then stop. Complete results replace the files at `path`; others are appended."""

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    out = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (out.foreachBatch(replace) if mode == "complete" else out.format("parquet").option("path", path)).start().awaitTermination()


def extra_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour and type from the stream of events."""
    # a file source lists folders: the table may be one file, so a scratch copy of its rows is the folder
    source, path, mark = (fresh_path(spark, n) for n in ("events", "windows", "progress"))
    spark.read.parquet(f"{sf_dir}/events.parquet").write.mode("overwrite").parquet(source)
    run_to_end(windowed_counts(stream(spark, source)), "complete", path, mark)
    return spark.read.parquet(path).select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


def extra_stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases over 50 as they arrive."""
    source, path, mark = (fresh_path(spark, n) for n in ("events", "filter", "progress"))
    spark.read.parquet(f"{sf_dir}/events.parquet").write.mode("overwrite").parquet(source)
    run_to_end(stream(spark, source).filter("event_type = 'purchase' AND value > 50").select("event_id", "user_id", "value"), "append", path, mark)
    return spark.read.schema("event_id bigint, user_id bigint, value double").parquet(path)


QUERIES = {f.__name__: f for f in (extra_stream_windows, extra_stream_filter)}
ORACLE = {
    "extra_stream_windows": "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
    "extra_stream_filter": "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 50",
}
