"""Shared pieces of the training-data operators: the cluster's shared folder and hand-off tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbuf import give_back

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (a test) gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder; a session that has ended leaves it to the cluster."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage (lost executors cost no recomputation of what came before) and
    gives later joins real sizes, so that AQE can split hot keys on both sides.
    """
    spark = df.sparkSession
    prepare(spark)
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing reads any more."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and broadcasts of steps that are over, and give back the driver's free memory.

    Else the files stay until the driver's heap is full, and the heap grows with the steps.
    """
    give_back()
    spark.sparkContext._jvm.System.gc()


#: Bytes of an Arrow batch that a Python worker gets, or a single row if that is larger.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, and bound their batches by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Longs of a table of marks: with its 64 bits each it tells some million keys from others, and
#: broadcast it takes about 16 MB, however many keys there are.
MARK_WORDS = 1 << 19


def marks(keys: DataFrame, *columns: str | Column) -> DataFrame:
    """A table ``word, bits`` of at most MARK_WORDS rows with a bit for each key."""
    digest = F.xxhash64(*columns)
    word, bit = digest.bitwiseAND(F.lit(MARK_WORDS - 1)), F.shiftrightunsigned(digest, 58).cast("int")
    return materialize(keys.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "marks")


def with_mark(df: DataFrame, marked: DataFrame, name: str, *columns: str | Column) -> DataFrame:
    """``df`` with a boolean column ``name``: false where the key isn't in the table for sure.

    What is marked by chance has to be sorted out by an exact join; the rest needs no shuffle.
    With far more keys than bits all rows are marked, which costs the shuffle but stays right.
    """
    word, bits = fresh(df, "_word", "_bits")
    digest = F.xxhash64(*columns)
    joined = df.join(F.broadcast(marked.select(F.col("word").alias(word), F.col("bits").alias(bits))), digest.bitwiseAND(F.lit(MARK_WORDS - 1)) == F.col(word), "left")
    hit = F.call_function("shiftrightunsigned", F.col(bits), F.shiftrightunsigned(digest, 58).cast("int")).bitwiseAND(F.lit(1)) == 1
    return joined.select(*df.columns, F.coalesce(hit, F.lit(False)).alias(name))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other letters stay as they are."""
    return F.translate(text, _UPPER, _UPPER.lower())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
