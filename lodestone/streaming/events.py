"""Structured Streaming over an event table: windows in event time with watermarks, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import removed, scratch


def source(spark: SparkSession, folder: str, name: str = "events", close: str | None = "7 days") -> DataFrame:
    """A stream of the Parquet files of a table (one file, or a folder of files), all of them in its first batch.

    With ``close`` a row without values but a time later than the last by so much is added, so that a watermark passes all groups
    that end by then; its own group stays open and is never given.
    """
    path = f"{folder}/{name}.parquet"
    rows = spark.read.parquet(path)
    reader = spark.readStream.schema(rows.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    stream = reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    if not close:
        return stream
    end = f"{scratch(spark)}/end-{uuid.uuid4().hex}"
    last = rows.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").select((F.col("ts") + F.expr(f"INTERVAL {close}")).alias("ts"))
    rows.limit(0).unionByName(last, allowMissingColumns=True).write.parquet(end)
    return stream.union(reader.parquet(end).withColumn("ts", F.col("ts").cast("timestamp")))


def drained(stream: DataFrame) -> DataFrame:
    """Everything an aggregating stream over source() gives, as a table of Parquet files in the shared folder.

    Append mode: a group is written once, when the watermark has passed it, and its state is dropped. Executors write; nothing goes
    through the driver. Progress and state are removed at the end.
    """
    spark = stream.sparkSession
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append")
    writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    removed(spark, f"{folder}/progress")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum of values by window and type; without slide the windows tumble."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "v")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user: a session ends when nothing happens for the gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")
