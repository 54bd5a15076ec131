"""Reads over a change log: DataFrame in, DataFrame out.

Predicates on keys and sequence numbers go below the newest-per-key step (and so to the
Parquet scan); those on kinds and values above it, or old versions would come back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.errors import InvalidArgument
from seqlake.model import LATEST, PUT, ScanOptions


def successor(prefix: bytes | str) -> bytes | str | None:
    """The least key above all keys that start with ``prefix``; None if there is none."""
    raw = prefix.encode() if isinstance(prefix, str) else bytes(prefix)
    stem = raw.rstrip(b"\xff")
    if not stem:
        return None
    if isinstance(prefix, bytes | bytearray):
        return stem[:-1] + bytes([stem[-1] + 1])
    # Text: the last character that has a successor, leaving out the surrogates.
    for i in range(len(prefix) - 1, -1, -1):
        code = ord(prefix[i]) + 1
        if code <= 0x10FFFF:
            return prefix[:i] + chr(0xE000 if 0xD800 <= code < 0xE000 else code)
    return None


def key_range(key: Column, options: ScanOptions) -> Column:
    """Bounds and prefix of a scan as comparisons that Parquet can push down."""
    start, end, prefix = options.start, options.end, options.prefix
    out = F.lit(True)
    if start:
        out = out & (key >= F.lit(start))
    if end:
        out = out & (key < F.lit(end))
    if prefix:
        out = out & (key >= F.lit(prefix))
        above = successor(prefix)
        if above is not None:
            out = out & (key < F.lit(above))
    return out


def newest(log: DataFrame, by: Sequence[str] = ("key",), plan: str = "join") -> DataFrame:
    """The row of largest ``seq`` for each value of ``by``.

    ``join``: sums up the largest numbers, which are few and small, and joins them back; AQE
    broadcasts them when they turn out small enough. ``window``: ranks rows, one shuffle of whole rows; for logs that
    are laid out by key already.
    """
    by = list(by)
    if plan == "window":
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("seq")))
        return log.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    top = log.groupBy(*by).agg(F.max("seq").alias("seq"))
    return log.join(top, [*by, "seq"], "left_semi")


def visible(log: DataFrame, read_seq: int | None = None, keys: Column | None = None, plan: str = "join") -> DataFrame:
    """``key, value, seq`` of every key that lives at ``read_seq`` (None: now)."""
    seen = log if read_seq is None or read_seq >= LATEST else log.where(F.col("seq") <= read_seq)
    if keys is not None:
        seen = seen.where(keys)
    return newest(seen, plan=plan).where(F.col("kind") == PUT).select("key", "value", "seq")


def get(log: DataFrame, key: bytes | str, read_seq: int | None = None) -> DataFrame:
    """At most one row ``key, value, seq``."""
    return visible(log, read_seq, F.col("key") == F.lit(key))


def multi_get(log: DataFrame, requests: DataFrame, read_seq: int | None = None) -> DataFrame:
    """One row per row of ``requests`` (``pos, key``): ``pos, key, found, value``.

    Repeated keys are looked up once and answered each time; order by ``pos`` for the order
    of the requests. The log is reduced to requested keys before anything else.
    """
    wanted = requests.select("key").distinct()
    held = visible(log.join(wanted, "key", "left_semi"), read_seq).select(F.col("key").alias("_key"), "value")
    joined = requests.join(held, requests["key"] == held["_key"], "left")
    return joined.select("pos", "key", F.col("_key").isNotNull().alias("found"), "value")


def scan(log: DataFrame, options: ScanOptions = ScanOptions(), read_seq: int | None = None) -> DataFrame:
    """``key, value`` in key order; reversed before the limit is applied."""
    return arrange(visible(log, read_seq, key_range(F.col("key"), options)).select("key", "value"), options)


def arrange(view: DataFrame, options: ScanOptions) -> DataFrame:
    if options.limit < 0:
        raise InvalidArgument("limit is negative")
    order = F.desc("key") if options.reverse else F.asc("key")
    out = view.orderBy(order)
    return out.limit(options.limit) if options.limit else out


def history(log: DataFrame, keys: Column | None = None) -> DataFrame:
    """All versions, newest first for each key, with the interval in which each is current."""
    rows = log if keys is None else log.where(keys)
    following = F.lead("seq").over(Window.partitionBy("key").orderBy("seq"))
    return rows.select("key", "seq", "kind", "value", F.col("seq").alias("valid_from"), following.alias("valid_to")).orderBy("key", F.desc("seq"))


def diff(log: DataFrame, old_seq: int, new_seq: int | None = None) -> DataFrame:
    """``key, change, old_value, new_value`` of keys that were added, removed or changed."""
    old = visible(log, old_seq).select(F.col("key").alias("_old"), F.col("value").alias("old_value"), F.col("seq").alias("_os"))
    new = visible(log, new_seq).select(F.col("key").alias("_new"), F.col("value").alias("new_value"), F.col("seq").alias("_ns"))
    both = old.join(new, F.col("_old") == F.col("_new"), "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "changed")
    return both.select(F.coalesce("_old", "_new").alias("key"), change.alias("change"), "old_value", "new_value").where("change is not null")


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Sorted runs as one, by key, then newest first."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out.orderBy("key", F.desc("seq"))


def overlay(view: DataFrame, staged: DataFrame) -> DataFrame:
    """``view`` (``key, value``) with staged operations (``op_idx, op, key, value``) over it."""
    last = staged.groupBy("key").agg(F.max_by(F.struct("op", "value"), "op_idx").alias("_last"))
    puts = last.where("_last.op = 'put'").select("key", F.col("_last.value").alias("value"))
    return view.select("key", "value").join(last.select("key"), "key", "left_anti").unionByName(puts)


def index_lookup(log: DataFrame, index_prefix: bytes | str, read_seq: int | None = None) -> DataFrame:
    """``index_key, key, value``: rows that entries under a prefix point to by their value."""
    entries = visible(log, read_seq, key_range(F.col("key"), ScanOptions(prefix=index_prefix)))
    pointers = entries.select(F.col("key").alias("index_key"), F.col("value").alias("_to"))
    return pointers.join(visible(log, read_seq), F.col("_to") == F.col("key")).select("index_key", "key", "value")


def as_of(log: DataFrame, probes: DataFrame) -> DataFrame:
    """As-of join: for each probe (``key, at``) the value of the key at that sequence number.

    Versions and probes of a key are put in order together, and each probe takes the last
    version before it: one shuffle and no pairs, so that a key with many of both stays cheap.
    """
    versions = log.select("key", F.col("seq").alias("_at"), F.struct("kind", "value").alias("_held"), F.lit(0).alias("_probe"))
    asked = probes.select("key", F.col("at").alias("_at"), F.lit(None).cast(versions.schema["_held"].dataType).alias("_held"), F.lit(1).alias("_probe"))
    order = Window.partitionBy("key").orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    rows = versions.unionByName(asked).withColumn("_hit", F.last("_held", ignorenulls=True).over(order)).where("_probe = 1")
    found = F.coalesce(F.col("_hit.kind") == PUT, F.lit(False))
    return rows.select("key", F.col("_at").alias("at"), F.when(found, F.col("_hit.value")).alias("value"), found.alias("found"))
