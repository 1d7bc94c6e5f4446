"""Structured Streaming over folders of Parquet files: windowed aggregates with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files


def windowed_totals(stream: DataFrame, time: str, keys: list[str], width: str, value: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by key and window (tumbling, or sliding by slide), with state kept for the time that late rows are awaited."""
    grouped = stream.withWatermark(time, late).groupBy(*keys, F.window(time, width, slide or width).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*keys, F.col("w.start").alias("started"), "n", "total")


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str = "complete", at: str | None = None) -> DataFrame:
    """What a stream gives once it has read all that is there. Executors write each batch's result to the shared folder, in complete mode over the last one, and the stream's progress lies beside it: with the same path, a later run goes on from there."""
    at = at or files.scratch(spark)
    kept = "overwrite" if mode == "complete" else "append"
    put = lambda batch, _: batch.write.mode(kept).parquet(f"{at}/result")
    running = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/progress").outputMode(mode).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/result")


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table of a folder as a stream of its files."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}*").withColumn("ts", F.col("ts").cast("timestamp"))


def daily_totals(spark: SparkSession, folder: str, width: str = "1 day", slide: str | None = None) -> DataFrame:
    out = run_to_end(spark, windowed_totals(events_stream(spark, folder), "ts", ["event_type"], width, "value", "1 hour", slide))
    return out.select("event_type", F.col("started").cast("timestamp_ntz").alias("day"), "n", "total")
