"""Structured Streaming: pages that arrive as files, and sessions of an audit stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_arriving(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_at_once: int = 8) -> DataFrame:
    """Files of a folder as a stream; with an available-now trigger a run takes what is there and ends."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", pattern).parquet(folder)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user; in a stream, rows that come later than ``late`` after the newest are dropped and a session is given out when it can't grow."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    source = events.withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n_events"), F.sum("value").alias("value"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_events", "value")


def run_available(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that has arrived and adds the result to a table."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).toTable(table)
    query.awaitTermination()


def run_to_folder(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs a stream over all that has arrived and appends the result to a folder of Parquet files; both folders are shared ones."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
    query.awaitTermination()
