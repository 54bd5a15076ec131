"""Schemas, limits and options of the versioned change log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PUT, DELETE, BATCH_MARKER = 0, 1, 2
#: A sequence number has 56 bits; the low 8 bits of its encoding hold the kind.
MAX_SEQ = (1 << 56) - 1
#: Reads without a snapshot see every committed sequence number.
LATEST = MAX_SEQ

LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("kind", T.ByteType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
OPS = T.StructType(
    [
        T.StructField("op_idx", T.IntegerType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
FILES = T.StructType(
    [
        T.StructField("level", T.IntegerType(), False),
        T.StructField("file_id", T.LongType(), False),
        T.StructField("path", T.StringType(), True),
        T.StructField("file_size", T.LongType(), False),
        T.StructField("smallest_key", T.BinaryType(), False),
        T.StructField("largest_key", T.BinaryType(), False),
        T.StructField("smallest_seqno", T.LongType(), False),
        T.StructField("largest_seqno", T.LongType(), False),
    ]
)
REQLOG = T.StructType(
    [
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("method", T.StringType(), False),
        T.StructField("success", T.BooleanType(), False),
        T.StructField("latency_us", T.LongType(), False),
    ]
)


@dataclass(frozen=True)
class ScanOptions:
    """``start`` inclusive, ``end`` exclusive, ``prefix`` and both; ``limit`` 0 means all rows."""

    start: bytes | str | None = None
    end: bytes | str | None = None
    prefix: bytes | str | None = None
    limit: int = 0
    reverse: bool = False


@dataclass(frozen=True)
class Options:
    """Settings that have a meaning on Spark. Sizes are bytes.

    A group of writes that wait shares one log file, up to ``group_max_*``; beyond ``queue_max_*``
    writers wait before they join the queue. ``max_unflushed_batches`` commits may lie in logs.
    """

    levels: int = 7
    l0_compaction_trigger: int = 4
    level1_target: int = 64 * 1024
    level_multiplier: int = 10
    grandparent_factor: int = 10
    max_subcompactions: int = 1
    l0_slowdown_files: int = 20
    l0_stop_files: int = 36
    pending_soft_bytes: int = 64 * 1024 * 1024
    pending_hard_bytes: int = 256 * 1024 * 1024
    group_max_ops: int = 4096
    group_max_bytes: int = 2 * 1024 * 1024
    manifest_max_edits: int = 10_000
    retained_versions: int = 10
    queue_max_requests: int = 1024
    queue_max_bytes: int = 8 * 1024 * 1024
    max_unflushed_batches: int = 100_000
    flush_failure_limit: int = 3
    target_file_bytes: int = 128 * 1024 * 1024

    def __post_init__(self) -> None:
        # Values below one would stop all progress.
        for name in ("levels", "l0_compaction_trigger", "level_multiplier", "max_subcompactions", "group_max_ops", "queue_max_requests", "retained_versions", "max_unflushed_batches", "target_file_bytes"):
            if getattr(self, name) < 1:
                object.__setattr__(self, name, 1)
        if self.l0_stop_files < self.l0_slowdown_files:
            object.__setattr__(self, "l0_stop_files", self.l0_slowdown_files)
        if self.pending_hard_bytes < self.pending_soft_bytes:
            object.__setattr__(self, "pending_hard_bytes", self.pending_soft_bytes)

    def level_target(self, level: int) -> int:
        return self.level1_target * self.level_multiplier ** (max(level, 1) - 1)
