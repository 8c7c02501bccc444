"""Streaming counterparts of the batch operators: event-time windows, sessions and point-in-time visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronica.session import files_folder


def windowed_counts(stream: DataFrame, time: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows and sum of a value by event-time window and keys, with rows later than ``late`` left out."""
    rows = stream.withColumn("w_time", F.col(time).cast("timestamp")).withWatermark("w_time", late)
    window = F.window("w_time", width, slide) if slide else F.window("w_time", width)
    by = rows.groupBy(window, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return by.select(F.col("window.start").alias("from_time"), F.col("window.end").alias("to_time"), *keys, "n", "total")


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each key: rows no farther apart than ``gap``, as (from_time, to_time, keys, n); a session ends ``gap`` after its last row."""
    rows = stream.withColumn("w_time", F.col(time).cast("timestamp")).withWatermark("w_time", late)
    by = rows.groupBy(F.session_window("w_time", gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("s.start").alias("from_time"), F.col("s.end").alias("to_time"), *keys, "n")


def visible_matches(anchors: DataFrame, events: DataFrame, key: str, hours: int, late: str = "1 hour") -> DataFrame:
    """Stream join of anchors (key, anchor) with events (key, ts, seen_at) visible before the anchor and at most ``hours`` old."""
    left = anchors.withColumn("anchor", F.col("anchor").cast("timestamp")).withWatermark("anchor", late)
    right = events.withColumnRenamed(key, "e_key").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    met = F.expr(f"{key} = e_key AND ts >= anchor - INTERVAL {int(hours)} HOURS AND ts < anchor AND seen_at < anchor")
    return left.join(right, met).drop("e_key")


def first_seen(stream: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The stream without rows whose keys were seen within ``late`` before: each repeat sent in that time goes, with bounded state."""
    return stream.withColumn("w_time", F.col(time).cast("timestamp")).withWatermark("w_time", late).dropDuplicatesWithinWatermark(keys).drop("w_time")


def run_to_files(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Everything the stream has now, written exactly once to Parquet files below the shared folder, and read back."""
    folder = files_folder(spark, name)
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def parquet_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder as a stream of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
