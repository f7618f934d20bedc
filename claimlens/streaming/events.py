"""Progress events as a stream: event frames, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.publish import frame


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).parquet(folder)


def frames(events: DataFrame) -> DataFrame:
    return events.select("event_id", frame(F.col("event_type"), F.col("props")).alias("frame"))


def counted(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window; a window closes once the watermark is past it, so state stays bounded."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def write_once(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream's new rows to folder, each batch to a folder of its own, and ends when there are none left.

    A batch that is repeated after a failure has the same rows and number, and so takes the place of what it had written before:
    each row is there once.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_frames(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Event frames of a stream of events, each once."""
    return write_once(frames(events), folder, checkpoint)
