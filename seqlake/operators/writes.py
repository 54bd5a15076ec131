"""Writes as sets: operations become log rows; compare-and-set and batches check one view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.errors import Unavailable
from seqlake.model import DELETE, MAX_SEQ, PUT


def check_range(base: int, count: int) -> None:
    """Whether ``count`` sequence numbers from ``base`` on exist."""
    if base + count - 1 > MAX_SEQ:
        raise Unavailable("sequence numbers are used up")


def assign_seq(ops: DataFrame, base: int) -> DataFrame:
    """Log rows of operations ``op_idx, op, key, value``; ``op_idx`` counts from 0 without gaps.

    Numbers are ``base + op_idx``, so a batch's are in a row and the last of a repeated key wins.
    """
    is_put = F.col("op") == "put"
    return ops.select(
        "key",
        (F.lit(base).cast("long") + F.col("op_idx")).alias("seq"),
        F.when(is_put, F.lit(PUT)).otherwise(F.lit(DELETE)).cast("byte").alias("kind"),
        F.when(is_put, F.col("value")).alias("value"),
    )


def apply_batch(log: DataFrame, ops: DataFrame, base: int) -> DataFrame:
    """The log after a batch."""
    return log.select("key", "seq", F.col("kind").cast("byte").alias("kind"), "value").unionByName(assign_seq(ops, base))


def compare_and_set(view: DataFrame, requests: DataFrame) -> DataFrame:
    """Judge requests ``req, key, expect_exists, expected, new_value, delete`` against one view.

    Adds ``applied`` and ``op``. A request that expects a value applies if the key holds just
    that one, one that expects none if the key is absent. ``delete`` wins over ``new_value``.
    """
    held = view.select(F.col("key").alias("_key"), F.col("value").alias("_held"))
    joined = requests.join(held, requests["key"] == held["_key"], "left")
    there = F.col("_key").isNotNull()
    applied = F.when(F.col("expect_exists"), there & F.col("_held").eqNullSafe(F.col("expected"))).otherwise(~there)
    op = F.when(F.col("delete"), "delete").otherwise("put")
    return joined.select(*[requests[c] for c in requests.columns], applied.alias("applied"), op.alias("op"))


def write_groups(requests: DataFrame, max_ops: int, max_bytes: int) -> DataFrame:
    """Groups that a queue of requests (``queue, pos, ops, bytes``) is committed in.

    Requests join the open group in order until one would go beyond either limit; that one
    opens the next group, and one that is too large alone forms a group. Whether a request
    opens a group depends on all before it, so each queue is walked in order, batch by batch,
    with two running sums; queues are independent of one another.
    """

    def walk(batches):
        queue, group, ops, size = None, 0, 0, 0
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in ("queue", "pos", "ops", "bytes")}
            groups = []
            for q, o, b in zip(columns["queue"], columns["ops"], columns["bytes"], strict=True):
                if q != queue:
                    queue, group, ops, size = q, 0, o, b
                elif ops + o > max_ops or size + b > max_bytes:
                    group, ops, size = group + 1, o, b
                else:
                    ops, size = ops + o, size + b
                groups.append(group)
            yield pa.RecordBatch.from_arrays([batch.column("queue"), batch.column("pos"), pa.array(groups, pa.int64())], ["queue", "pos", "group_id"])

    import pyarrow as pa

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    ready = requests.select("queue", "pos", "ops", "bytes").repartition("queue").sortWithinPartitions("queue", "pos")
    return ready.mapInArrow(walk, f"queue {kinds['queue']}, pos {kinds['pos']}, group_id long")
