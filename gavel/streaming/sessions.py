"""Streaming forms: sessions, windows with late rows, first-seen rows, keyed replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.sources.staging import new_path

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream of files."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def user_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Blocks of a user's events at most `gap` apart: start, end, number, value. Rows later than `late` don't count."""
    return (
        events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")
    )


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by kind in fixed windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once, the first time it is seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is there now through the stream into a table of the shared folder, read as a batch."""
    spark = stream.sparkSession
    root = new_path(spark, f"stream-{name}")
    query = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
