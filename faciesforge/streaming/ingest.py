"""Files and events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import las


def las_files(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New LAS files of a folder as they come: (path, text)."""
    reader = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).schema("value string")
    return reader.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def ingest_samples(spark: SparkSession, folder: str, out: str, checkpoint: str, wanted: tuple[str, ...] | None = None) -> StreamingQuery:
    """Append the samples of files that are there and have not been read yet, then stop. What a run has
    committed stays; an interrupted one goes on where its last commit was."""
    found = las.curve_samples(las_files(spark, folder), wanted)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events, distinct-free sums and types in each window, once it is past the lateness allowed: a stream or a table of ``(ts, event_type, value)``."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def latest_by_key(events: DataFrame, key: str, time: str) -> DataFrame:
    """The last row of each key."""
    rest = [F.col(c) for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(time)).alias("e")).select(key, "e.*")
