"""Streaming upserts: exact triple dedup in a stream, and chunks by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgspark.sources.texts import save_chunks


def distinct_triples(edges: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream's edges (src, dst, relation, time), each key once within the watermark."""
    stamped = edges.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.dropDuplicatesWithinWatermark(["src", "dst", "relation"])


def windowed_counts(events: DataFrame, key: str, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n) of a stream in tumbling windows."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def upsert_chunks(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch of chunks (chunk_id, text) into the table at path; all that is there, once."""

    def write(batch: DataFrame, _: int) -> None:
        save_chunks(batch.sparkSession, batch.groupBy("chunk_id").agg(F.max("text").alias("text")), path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
