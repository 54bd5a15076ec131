from pyspark.sql import functions as F

from seqlake.operators import reads
from seqlake.streaming import ingest as S


def test_late_versions_and_repeated_runs(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    rows = spark.range(100).select(F.format_string("k%02d", F.pmod("id", F.lit(10))).alias("key"), (100 - F.col("id")).alias("seq"), F.lit(0).alias("kind"), F.col("id").cast("string").alias("value"))
    rows.where("seq > 50").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    S.ingest(stream, path, state).awaitTermination()
    rows.where("seq <= 50").write.mode("append").parquet(source)  # older numbers arrive later
    for _ in range(2):  # the second run finds nothing new
        S.ingest(stream, path, state).awaitTermination()
    log = S.ingested(spark, path, rows.schema)
    assert log.count() == 100
    assert sorted(map(tuple, reads.visible(log).collect())) == sorted(map(tuple, reads.visible(rows).collect()))
    assert S.commit_watermark(log).first()[0] == 100


def test_request_rate_stream(spark, tmp_path):
    source = str(tmp_path / "requests")
    spark.range(60).select(F.timestamp_seconds("id").alias("ts")).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp").parquet(source)
    query = S.request_rate(stream, slide="30 seconds").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("rates").agg(F.max("requests"), F.max("qps")).first() == (60, 1.0)
    query = S.request_rate(stream, window="30 seconds", slide="30 seconds").writeStream.format("memory").queryName("short").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("short").select("requests", "qps").collect()} == {(30, 1.0)}


def test_a_stream_without_rows(spark, tmp_path):
    source, path, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    rows = spark.range(0).select(F.lit("k").alias("key"), F.col("id").alias("seq"), F.lit(0).alias("kind"), F.lit("v").alias("value"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    assert S.latest_view(spark, stream, path, state).count() == 0
