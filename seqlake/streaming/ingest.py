"""Streaming ingestion of operations into a change log, exactly once per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqlake.operators.reads import visible
from seqlake.sources.files import Files


def ingest(changes: DataFrame, path: str, checkpoint: str, available_now: bool = True, interval: str = "10 seconds") -> StreamingQuery:
    """Append a stream of versions ``key, seq, kind, value`` to the log at ``path``.

    Each micro-batch overwrites the partition of its own number, so a batch that is run again
    after a failure replaces itself. Rows are sorted by key for pruning. Versions may arrive
    late or out of order; their numbers decide, not their arrival.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.select("key", "seq", "kind", "value").sortWithinPartitions("key", F.desc("seq")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def ingested(spark: SparkSession, path: str, schema) -> DataFrame:
    """The log that :func:`ingest` has written; empty before the first batch with rows."""
    if not [n for n in Files(spark).names(path) if n.startswith("batch=")]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/*")


def commit_watermark(log: DataFrame) -> DataFrame:
    """One row ``last_sequence``: everything up to it is committed."""
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last_sequence"))


def latest_view(spark: SparkSession, changes: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Ingest what is available and return the view of it."""
    ingest(changes, path, checkpoint).awaitTermination()
    return visible(ingested(spark, path, changes.schema)).select("key", "value")


def request_rate(requests: DataFrame, window: str = "60 seconds", slide: str = "1 second", late: str = "2 minutes") -> DataFrame:
    """Requests per second over sliding windows of a request stream; rows later than ``late`` are dropped."""
    counted = requests.withWatermark("ts", late).groupBy(F.window("ts", window, slide)).agg(F.count("*").alias("requests"))
    seconds = F.unix_micros("window.end") - F.unix_micros("window.start")
    return counted.select(F.col("window.end").alias("until"), "requests", (F.col("requests") * 1_000_000.0 / seconds).alias("qps"))
