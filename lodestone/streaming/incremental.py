"""Structured Streaming forms of the incremental work: ingest into a collection, and latency windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.collection import Collection


def ingest(docs: DataFrame, collection: Collection, checkpoint: str) -> StreamingQuery:
    """Ingest a stream of documents (doc_id, text), a batch of the collection for each micro-batch.

    A batch that Spark runs again after a failure is written over if it didn't come to its end, and left alone if it did; a document's
    last text counts, and what it had before goes."""
    return docs.writeStream.foreachBatch(lambda rows, n: collection.ingest(rows, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, mean, high) of tumbling windows; on a stream, rows later than ``late`` are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    got = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("high"))
    return got.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean", "high")


def stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
