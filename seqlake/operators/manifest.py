"""The manifest: edits that add and remove files, as rows ``edit_no, action, level, file_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .reads import newest


def replay_edits(edits: DataFrame, upto: int | None = None) -> DataFrame:
    """The files that live after the edits up to ``upto``: last added, not removed since."""
    seen = edits if upto is None else edits.where(F.col("edit_no") <= upto)
    last = newest(seen.withColumnRenamed("edit_no", "seq"), ["file_id"]).withColumnRenamed("seq", "edit_no")
    return last.where("action = 'add'").drop("action")


def live_files(edits: DataFrame, retained: int) -> DataFrame:
    """``file_id`` of all files that one of the last ``retained`` versions holds.

    A file lives from the edit that adds it until the next edit that names it.
    """
    last = edits.agg(F.max("edit_no").alias("last"))
    until = F.lead("edit_no").over(Window.partitionBy("file_id").orderBy("edit_no"))
    spans = edits.withColumn("until", until).where("action = 'add'").join(F.broadcast(last))  # one row
    return spans.where(F.col("until").isNull() | (F.col("until") > F.col("last") - retained + 1)).select("file_id").distinct()


def obsolete_files(edits: DataFrame, retained: int) -> DataFrame:
    """``file_id`` of removed files that no retained version holds."""
    gone = edits.where("action = 'delete'").select("file_id").distinct()
    return gone.join(live_files(edits, retained), "file_id", "left_anti")


def invalid_edits(edits: DataFrame, levels: int) -> DataFrame:
    """Rows of edits that can't be applied, with ``reason``."""
    order = Window.partitionBy("file_id").orderBy("edit_no")
    before = F.lag("action").over(order)
    reason = (
        F.when((F.col("level") < 0) | (F.col("level") >= levels), "no such level")
        .when((F.col("action") == "add") & (before == "add"), "file is there already")
        .when((F.col("action") == "delete") & (before.isNull() | (before == "delete")), "file isn't there")
    )
    return edits.withColumn("reason", reason).where("reason is not null")
