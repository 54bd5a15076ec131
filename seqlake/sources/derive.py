"""Change logs and request logs derived from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(prefix: str, column: str, width: int):
    return F.concat(F.lit(prefix), F.lpad(F.col(column).cast("string"), width, "0"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version per event; an error deletes its user's key."""
    gone = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        _padded("user:", "user_id", 6).alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        gone.cast("int").alias("kind"),
        F.when(~gone, F.col("props")).alias("value"),
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version per order: a wide key space."""
    return table(spark, sf_dir, "orders").select(_padded("order:", "o_orderkey", 10).alias("key"), (F.col("o_orderkey") + 1).alias("seq"), F.lit(0).alias("kind"), F.col("o_orderstatus").alias("value"))


def index_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and, with each, an index entry by customer and status that points to it."""
    orders = table(spark, sf_dir, "orders")
    row = _padded("order:", "o_orderkey", 10)
    entry = F.concat_ws(":", F.lit("idx:cust"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"), "o_orderstatus", F.col("o_orderkey").cast("string"))
    data = orders.select(row.alias("key"), (F.col("o_orderkey") * 2 + 1).alias("seq"), F.lit(0).alias("kind"), F.col("o_orderstatus").alias("value"))
    return data.unionByName(orders.select(entry.alias("key"), (F.col("o_orderkey") * 2 + 2).alias("seq"), F.lit(0).alias("kind"), row.alias("value")))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("method"), (F.col("event_type") != "error").alias("success"), F.round(F.col("value") * 1000).cast("long").alias("latency_us"))


def flushed(log: DataFrame, rows: int = 500) -> DataFrame:
    """``log`` with ``file_id, level`` as if flushed every ``rows`` versions and partly compacted."""
    file_id = F.floor((F.col("seq") - 1) / rows).cast("long")
    return log.withColumn("file_id", file_id).withColumn("level", F.least(F.pmod("file_id", F.lit(4)), F.lit(2)).cast("int"))
