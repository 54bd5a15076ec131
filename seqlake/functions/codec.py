"""Byte formats: encoded sequence numbers, internal keys, varints, run lengths, file names."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqlake.errors import Corruption
from seqlake.model import BATCH_MARKER


# Sequence number and kind in one number -----------------------------------------------------


def encode_seq(seq: Column, kind: Column) -> Column:
    return F.shiftleft(seq, 8) + kind


def decode_seq(encoded: Column) -> Column:
    return F.shiftrightunsigned(encoded, 8)


def decode_kind(encoded: Column) -> Column:
    return encoded.bitwiseAND(F.lit(255)).cast("int")


def checked_kind(kind: Column) -> Column:
    """The kind, or an error for one that doesn't exist."""
    message = F.concat(F.lit("Corruption: no such kind: "), kind.cast("string"))
    return F.when(kind.between(0, BATCH_MARKER), kind).otherwise(F.raise_error(message).cast("int"))


def internal_key(key: Column, seq: Column, kind: Column) -> Column:
    """Key, then the encoded number inverted and big-endian, so that bytes sort newest first."""
    trailer = F.lpad(F.hex(F.bitwise_not(encode_seq(seq, kind))), 16, "0")
    return F.concat(key.cast("binary"), F.unhex(trailer))


def split_internal_key(serialized: Column) -> tuple[Column, Column, Column]:
    """(key, seq, kind) of :func:`internal_key`."""
    size = F.octet_length(serialized)
    key = F.substring(serialized, F.lit(1), size - 8)
    high = F.conv(F.hex(F.substring(serialized, size - 7, F.lit(4))), 16, 10).cast("long")
    low = F.conv(F.hex(F.substring(serialized, size - 3, F.lit(4))), 16, 10).cast("long")
    encoded = F.bitwise_not(F.shiftleft(high, 32) + low)
    return key, decode_seq(encoded), decode_kind(encoded)


# Variable-length numbers ---------------------------------------------------------------------


def varint(n: int) -> bytes:
    """Seven bits a byte, low ones first, the top bit on all but the last."""
    if not 0 <= n < 1 << 64:
        raise ValueError("out of range")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(number, position behind it)."""
    total = 0
    for i in range(10):
        if at + i >= len(data):
            raise Corruption("varint ends early")
        total |= (data[at + i] & 127) << 7 * i
        if data[at + i] < 128:
            if total >= 1 << 64:
                break
            return total, at + i + 1
    raise Corruption("varint is too long")


def slice_with_length(data: bytes) -> bytes:
    return varint(len(data)) + data


def read_slice(data: bytes, at: int = 0) -> tuple[bytes, int]:
    size, at = read_varint(data, at)
    if at + size > len(data):
        raise Corruption("slice ends early")
    return data[at : at + size], at + size


def varint_column(number: Column) -> Column:
    """:func:`varint` of longs from 0 on, with built-in functions."""
    parts = []
    for i in range(9):
        own = F.shiftright(number, 7 * i).bitwiseAND(F.lit(127))
        more = F.when(F.shiftright(number, 7 * (i + 1)) > 0, 128).otherwise(0) if i < 8 else F.lit(0)
        shown = F.lpad(F.hex(own.bitwiseOR(more.cast("long"))), 2, "0")
        parts.append(F.when(F.shiftright(number, 7 * i) > 0, shown).otherwise(F.lit("")) if i else shown)
    return F.unhex(F.concat(*parts))


def _byte(data: Column, at: Column) -> Column:
    """The byte at a place that counts from 1."""
    return F.conv(F.hex(F.substring(data, at, F.lit(1))), 16, 10).cast("long")


def read_varint_column(data: Column) -> Column:
    """The number that the bytes encode; null for no bytes."""
    places = F.sequence(F.octet_length(data), F.lit(1), F.lit(-1))
    total = F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: acc * 128 + _byte(data, i).bitwiseAND(F.lit(127)))
    return F.when(F.octet_length(data) > 0, total)


# Run lengths ---------------------------------------------------------------------------------


def rle_encode(data: bytes) -> bytes:
    """Pairs of a run's length (1 to 255) and its byte."""
    out = bytearray()
    at = 0
    while at < len(data):
        rest = data[at : at + 255]
        run = len(rest) - len(rest.lstrip(rest[:1]))
        out += bytes((run, rest[0]))
        at += run
    return bytes(out)


def rle_decode(data: bytes, expected: int) -> bytes:
    """The bytes of runs, which must be pairs, of some length, and ``expected`` bytes in all."""
    runs, values = data[::2], data[1::2]
    if len(runs) != len(values) or 0 in runs or sum(runs) != expected:
        raise Corruption("run lengths don't give the bytes that are expected")
    return b"".join(n * bytes((value,)) for n, value in zip(runs, values, strict=True))


def rle_column(data: Column) -> Column:
    """:func:`rle_encode` with built-in functions: runs of equal pairs of hex digits."""
    runs = F.regexp_extract_all(F.hex(data), F.lit(r"((..)\2{0,254})"), F.lit(1))
    pairs = F.transform(runs, lambda run: F.concat(F.lpad(F.hex((F.length(run) / 2).cast("long")), 2, "0"), F.left(run, F.lit(2))))
    return F.unhex(F.array_join(pairs, ""))


def read_rle_column(data: Column) -> Column:
    """The bytes of :func:`rle_column`."""
    places = F.sequence(F.lit(1), F.octet_length(data), F.lit(2))
    runs = F.transform(places, lambda i: F.repeat(F.hex(F.substring(data, i + 1, F.lit(1))), _byte(data, i).cast("int")))
    return F.when(F.octet_length(data) > 0, F.unhex(F.array_join(runs, ""))).otherwise(data)


# Checksums, bloom sizes, names ---------------------------------------------------------------


def checksum(data: bytes) -> int:
    return zlib.crc32(data)


def bloom_bits(entries: Column, false_positives: float) -> Column:
    """Bits of a bloom filter: -n ln p / (ln 2)^2, rounded up."""
    return F.ceil(-entries * F.log(F.lit(false_positives)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0))))


def bloom_key(key: Column, prefix: int) -> Column:
    """What a bloom filter holds of a key: its first ``prefix`` bytes, or all of it for 0."""
    return F.substring(key, 1, prefix) if prefix else key


def log_name(number: Column) -> Column:
    return F.format_string("%06d.wal", number)


def table_name(number: Column) -> Column:
    return F.format_string("%06d.sst", number)


def manifest_number(name: Column) -> Column:
    found = F.regexp_extract(name, "^MANIFEST-([0-9]+)$", 1)
    return F.when(found != "", found.cast("long"))


# Keyspace of the benchmark -------------------------------------------------------------------


def bench_key(i: Column) -> Column:
    return F.format_string("key_%016d", i)


def bench_value(i: Column, size: int) -> Column:
    """A value of ``size`` letters that repeats the alphabet, begun at another place for each key."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz" * (size // 26 + 2))
    return F.substring(letters, (i % 26 + 1).cast("int"), F.lit(size))


def split_range(total: int, parts: int, part: Column) -> tuple[Column, Column]:
    """Begin and end of one of ``parts`` nearly equal ranges of 0 to ``total``; first ones are larger."""
    base, extra = divmod(total, parts)
    begin = part * base + F.least(part, F.lit(extra))
    return begin, begin + base + (part < extra).cast("long")
