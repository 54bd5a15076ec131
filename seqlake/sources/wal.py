"""The byte log of writes: encoding, replay, and Spark sources and sinks over it.

A record is crc32, key length + 8, key, encoded sequence number, value length, value; numbers
are little-endian and the checksum covers all that follows it. A batch starts with a marker
record of empty key and kind 2 and counts only if all its records follow.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.errors import Corruption, InvalidArgument
from seqlake.model import BATCH_MARKER, MAX_SEQ

#: Start of a batch marker's value (fixed value); the number of records follows.
BATCH_MAGIC = b"GKTB"
LONGEST = 1 << 32


def encode_record(key: bytes, seq: int, kind: int, value: bytes) -> bytes:
    if not 0 <= seq <= MAX_SEQ:
        raise InvalidArgument("sequence number out of range")
    body = struct.pack("<I", len(key) + 8) + key + struct.pack("<QI", seq << 8 | kind, len(value)) + value
    return struct.pack("<I", zlib.crc32(body)) + body


def encode_batch(rows: Sequence[tuple[bytes, int, int, bytes]]) -> bytes:
    """An atomic batch of (key, seq, kind, value) with numbers in a row."""
    if not rows:
        return b""
    first = rows[0][1]
    if any(seq != first + i or kind == BATCH_MARKER for i, (_, seq, kind, _) in enumerate(rows)):
        raise Corruption("a batch has data records with numbers in a row")
    marker = encode_record(b"", first, BATCH_MARKER, BATCH_MAGIC + struct.pack("<I", len(rows)))
    return marker + b"".join(encode_record(*row) for row in rows)


@dataclass
class Replay:
    """What a log holds up to ``good_bytes``; behind that it was torn if ``truncated``."""

    rows: list[tuple[bytes, int, int, bytes]] = field(default_factory=list)
    good_bytes: int = 0
    truncated: bool = False

    @property
    def max_sequence(self) -> int:
        return max((r[1] for r in self.rows), default=0)


def _records(data: bytes) -> Iterator[tuple[int, int, tuple[bytes, int, int, bytes] | None, str]]:
    """(begin, end, record or None, what is wrong). Ends with the first torn record."""
    at = 0
    while at < len(data):
        left = len(data) - at
        if left < 8:
            yield at, at, None, "checksum is cut" if left < 4 else "record is cut"
            return
        crc, key_size = struct.unpack_from("<II", data, at)
        if key_size < 8:
            yield at, at, None, "key length is invalid"
            return
        if left < 8 + key_size:
            yield at, at, None, "record is cut"
            return
        key = data[at + 8 : at + key_size]
        encoded = struct.unpack_from("<Q", data, at + key_size)[0]
        if encoded & 255 > BATCH_MARKER:
            raise Corruption(f"no such kind: {encoded & 255}")
        if left < 12 + key_size:
            yield at, at, None, "record is cut"
            return
        size = struct.unpack_from("<I", data, at + 8 + key_size)[0]
        end = at + 12 + key_size + size
        if end > len(data):
            yield at, at, None, "record is cut"
            return
        if zlib.crc32(memoryview(data)[at + 4 : end]) != crc:
            yield at, end, None, "checksum differs"
            return
        yield at, end, (key, encoded >> 8, encoded & 255, data[end - size : end]), ""
        at = end


def replay(data: bytes) -> Replay:
    """Recover a log: what is torn or half a batch at its end is left out."""
    out = Replay()
    batch: list | None = None
    wanted = first = start = 0
    for begin, end, record, _ in _records(data):
        if record is None:
            out.truncated = True
            break
        key, seq, kind, value = record
        if kind == BATCH_MARKER:
            if key:
                raise Corruption("a batch marker has a key")
            if batch is not None:
                out.truncated = True
                break
            if len(value) != 8 or value[:4] != BATCH_MAGIC:
                raise Corruption("a batch marker's value is invalid")
            wanted = struct.unpack("<I", value[4:])[0]
            if not wanted:
                raise Corruption("a batch of no records")
            batch, first, start = [], seq, begin
            continue
        if batch is None:
            out.rows.append(record)
            out.good_bytes = end
            continue
        if seq != first + len(batch):
            out.truncated = True
            break
        batch.append(record)
        if len(batch) == wanted:
            out.rows += batch
            out.good_bytes, batch = end, None
    else:
        out.truncated = batch is not None
        if batch is not None:
            out.good_bytes = start
    return out


def read_strict(data: bytes) -> list[tuple[bytes, int, int, bytes]]:
    """All data records; whatever is wrong is an error, but a torn checksum ends the log."""
    rows = []
    for _, _, record, wrong in _records(data):
        if record is None:
            if wrong == "checksum is cut":
                break
            raise Corruption(wrong)
        if record[2] != BATCH_MARKER:
            rows.append(record)
    return rows


def read_wal(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Log files under ``path`` as rows ``file, position, key, seq, kind, value``.

    Records have no marks to find them by, so a file is one task's; files run in parallel.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                rows = read_strict(data) if strict else replay(data).rows
                if rows:
                    keys, seqs, kinds, values = zip(*rows, strict=True)
                    values = [None if k else v for k, v in zip(kinds, values, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array(keys, pa.binary()), pa.array(seqs, pa.int64()), pa.array(kinds, pa.int8()), pa.array(values, pa.binary())],
                        ["file", "position", "key", "seq", "kind", "value"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path).select("path", "content")
    return files.mapInArrow(decode, "file string, position long, key binary, seq long, kind byte, value binary")


def encode_log(log: DataFrame, rows_per_file: int = 100_000, batch: int = 0) -> DataFrame:
    """``number, content``: the bytes of log files with ``rows_per_file`` versions each, by ``seq``.

    ``batch`` over 0 groups that many versions into an atomic batch.
    """
    first = log.agg(F.coalesce(F.min("seq"), F.lit(0))).first()[0]
    numbered = log.select(F.floor((F.col("seq") - first) / rows_per_file).cast("long").alias("number"), F.col("key").cast("binary").alias("key"), "seq", F.col("kind").cast("int").alias("kind"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"))

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("key", "seq", "kind", "value")), strict=True), key=lambda r: r[1])
        step = batch or 1
        parts = (encode_batch(rows[i : i + step]) if batch else encode_record(*rows[i]) for i in range(0, len(rows), step))
        return pa.table({"number": [table["number"][0].as_py()], "content": pa.array([b"".join(parts)], pa.binary())})

    return numbered.groupBy("number").applyInArrow(one, "number long, content binary")
