"""Streams: a review queue that sees every item once, and windowed rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory as a stream of its files; the schema is read, not inferred."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def review_queue(stream: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Items once each within the watermark, whatever is sent again."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def rates(stream: DataFrame, time: str, kind: str, value: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count and sum of each kind per window; windows close behind the watermark."""
    got = stream.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("window.start").alias("window_start"), kind, "n", "total")
