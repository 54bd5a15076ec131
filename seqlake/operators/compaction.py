"""Files, levels and compaction: which files to merge, and what the merge keeps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.model import LATEST, Options

from .reads import newest


def stripe(seq: Column, snapshots: Sequence[int]) -> Column:
    """The earliest snapshot that can see a version; versions after all snapshots share one."""
    held = sorted(set(snapshots))
    if not held:
        return F.lit(LATEST)
    first = F.array_min(F.filter(F.array(*[F.lit(s).cast("long") for s in held]), lambda s: s >= seq))
    return F.coalesce(first, F.lit(LATEST))


def compact(log: DataFrame, snapshots: Sequence[int] = (), drop_tombstones: bool = False) -> DataFrame:
    """The versions that a read at any snapshot or at the end can still see.

    Tombstones stay, as older versions of their keys may lie in files that aren't merged;
    ``drop_tombstones`` is for merges of everything while no snapshot is held.
    """
    kept = newest(log.withColumn("_stripe", stripe(F.col("seq"), snapshots)), ["key", "_stripe"]).drop("_stripe")
    return kept.where("kind = 0") if drop_tombstones and not snapshots else kept


def entry_bytes() -> Column:
    """Size of a version as the write path counts it: key, value and 20 bytes."""
    return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 20


def file_stats(entries: DataFrame) -> DataFrame:
    """Bounds of each file from entries with ``level, file_id``."""
    return entries.groupBy("level", "file_id").agg(
        F.sum(entry_bytes()).cast("long").alias("file_size"),
        F.min("key").alias("smallest_key"),
        F.max("key").alias("largest_key"),
        F.min("seq").alias("smallest_seqno"),
        F.max("seq").alias("largest_seqno"),
        F.count("*").alias("entries"),
    )


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("file_size").cast("long").alias("level_bytes"))


def files_for_key(files: DataFrame, key: bytes | str) -> DataFrame:
    return files.where((F.col("smallest_key") <= F.lit(key)) & (F.col("largest_key") >= F.lit(key)))


def files_for_snapshot(files: DataFrame, seq: int) -> DataFrame:
    return files.where(F.col("smallest_seqno") <= seq)


def overlapping(files: DataFrame, low: bytes | str, high: bytes | str) -> DataFrame:
    return files.where((F.col("smallest_key") <= F.lit(high)) & (F.col("largest_key") >= F.lit(low)))


def overlapping_pairs(files: DataFrame, source: int, target: int) -> DataFrame:
    """Files of two levels whose key ranges meet. ``files`` is metadata: one row per file."""
    a = files.where(F.col("level") == source).select(F.col("file_id").alias("source_id"), F.col("smallest_key").alias("_alo"), F.col("largest_key").alias("_ahi"))
    b = files.where(F.col("level") == target).select(F.col("file_id").alias("target_id"), F.col("smallest_key").alias("_blo"), F.col("largest_key").alias("_bhi"), "file_size")
    return a.join(b, (F.col("_alo") <= F.col("_bhi")) & (F.col("_ahi") >= F.col("_blo"))).select("source_id", "target_id", "file_size")


def level_overlaps(files: DataFrame) -> DataFrame:
    """Neighbours of a level, in key order, that overlap; there should be none below level 0."""
    before = Window.partitionBy("level").orderBy("smallest_key", "file_id")
    marked = files.where("level > 0").select("level", "file_id", "smallest_key", F.lag("largest_key").over(before).alias("previous_largest"))
    return marked.where("previous_largest >= smallest_key")


def _target(level: Column, options: Options) -> Column:
    return (F.lit(options.level1_target) * F.pow(F.lit(options.level_multiplier), level - 1)).cast("long")


def pending_bytes(files: DataFrame, options: Options = Options()) -> DataFrame:
    """One row ``pending_bytes``: what lies over the targets, and level 0 if it has too many files."""
    over = F.greatest(F.col("level_bytes") - _target(F.col("level"), options), F.lit(0))
    part = F.when(F.col("level") > 0, over).when(F.col("n_files") > options.l0_compaction_trigger, F.col("level_bytes")).otherwise(0)
    return level_stats(files).agg(F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("pending_bytes"))


def compaction_scores(files: DataFrame, options: Options = Options()) -> DataFrame:
    """``level, score``: files over the trigger for level 0, bytes over the target for others."""
    score = F.when(F.col("level") == 0, F.col("n_files") / options.l0_compaction_trigger).otherwise(F.col("level_bytes") / _target(F.col("level"), options))
    return level_stats(files).where(F.col("level") <= options.levels - 2).select("level", score.cast("double").alias("score"))


#: States and reasons of the write pressure (fixed values).
NORMAL, SLOWDOWN, STOP = "normal", "slowdown", "stop"
REASONS = ("l0_stop_trigger", "pending_compaction_hard_limit", "l0_and_pending_compaction_slowdown", "l0_slowdown_trigger", "pending_compaction_soft_limit", "below_thresholds")


def pressure_rules(l0_files, pending, options: Options) -> list[tuple]:
    """(condition, state, reason) in order, for numbers or columns; the first that holds counts."""
    stop0, stop1 = l0_files >= options.l0_stop_files, pending >= options.pending_hard_bytes
    slow0, slow1 = l0_files >= options.l0_slowdown_files, pending >= options.pending_soft_bytes
    states = (STOP, STOP, SLOWDOWN, SLOWDOWN, SLOWDOWN)
    return list(zip((stop0, stop1, slow0 & slow1, slow0, slow1), states, REASONS, strict=False))


def write_pressure(files: DataFrame, options: Options = Options()) -> DataFrame:
    """One row ``l0_files, pending_bytes, pressure, reason``. Stop wins, level 0 before bytes."""
    n0 = files.agg(F.count(F.when(F.col("level") == 0, 1)).alias("l0_files"))
    both = n0.join(pending_bytes(files, options))  # two one-row tables
    state, reason = F.lit(NORMAL), F.lit(REASONS[-1])
    for holds, its_state, its_reason in reversed(pressure_rules(F.col("l0_files"), F.col("pending_bytes"), options)):
        state, reason = F.when(holds, its_state).otherwise(state), F.when(holds, its_reason).otherwise(reason)
    return both.select("l0_files", "pending_bytes", state.alias("pressure"), reason.alias("reason"))


def subcompaction_ranges(files: DataFrame, parts: int) -> DataFrame:
    """``part, start_key, end_key`` (null: open) that cut the keys at largest keys of files.

    Cut i of c is the boundary at place i * n / (c + 1), integer division, of the n distinct
    largest keys without the greatest. ``files`` is metadata: one row per file.
    """
    keys = files.select(F.col("largest_key").alias("cut")).distinct()
    every = Window.orderBy("cut")
    placed = keys.select("cut", (F.row_number().over(every) - 1).alias("i"), (F.count("*").over(Window.partitionBy()) - 1).alias("n")).where("i < n")
    cuts = F.least(F.lit(parts - 1), F.col("n"))
    chosen = placed.withColumn("c", cuts).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c").cast("long")))).where("k > 0 and i = k * n div (c + 1)").select("cut").distinct()
    starts = chosen.unionByName(files.sparkSession.createDataFrame([(None,)], chosen.schema))
    order = Window.orderBy(F.asc_nulls_first("cut"))
    return starts.select((F.row_number().over(order) - 1).alias("part"), F.col("cut").alias("start_key"), F.lead("cut").over(order).alias("end_key"))


@dataclass(frozen=True)
class File:
    """Metadata of one file; a plan is made on the driver from these few rows."""

    level: int
    file_id: int
    path: str
    file_size: int
    smallest_key: bytes
    largest_key: bytes
    smallest_seqno: int
    largest_seqno: int

    def meets(self, low: bytes, high: bytes) -> bool:
        return self.smallest_key <= high and self.largest_key >= low


@dataclass(frozen=True)
class Plan:
    source: int
    target: int
    inputs: tuple[File, ...]
    target_inputs: tuple[File, ...]
    trivial_move: bool


def _of_level(files: Sequence[File], level: int) -> list[File]:
    """Level 0 newest first, others by key."""
    own = [f for f in files if f.level == level]
    return sorted(own, key=(lambda f: -f.file_id) if level == 0 else (lambda f: (f.smallest_key, f.file_id)))


def _hull(files: Sequence[File]) -> tuple[bytes, bytes]:
    return min(f.smallest_key for f in files), max(f.largest_key for f in files)


def output_cuts(inputs: Sequence[File], below: Sequence[File], parts: int, most_below: int) -> list[bytes]:
    """Keys at which the output of a merge is cut, from metadata alone.

    ``parts`` ranges are cut at keys where input files begin, by the bytes before them. Besides,
    a range ends where it would meet more than ``most_below`` bytes of the level after (a later
    compaction of a file then has a bounded number of bytes to merge with).
    """
    starts = sorted({f.smallest_key for f in inputs})[1:]
    total = sum(f.file_size for f in inputs)
    before = {k: sum(f.file_size for f in inputs if f.largest_key < k) for k in starts}
    cuts = {min(starts, key=lambda k: (abs(before[k] - total * i / parts), k)) for i in range(1, parts)} if starts else set()
    held = 0
    for f in sorted(below, key=lambda f: f.smallest_key):
        held = 0 if f.smallest_key in cuts else held
        if held and held + f.file_size > most_below:
            cuts.add(f.smallest_key)
            held = 0
        held += f.file_size
    return sorted(cuts)


def pick(files: Sequence[File], options: Options = Options(), pointers: dict[int, bytes] | None = None) -> Plan | None:
    """The next compaction: the level of the highest score above one, the lowest on ties.

    Level 0 goes to the first level below its target, others one down. The seed is the file
    after the level's pointer; inputs of both levels grow until neither meets more. From
    level 0 every file takes part, so that a newer version never sinks below an older one.
    """
    sizes = {n: sum(f.file_size for f in files if f.level == n) for n in range(options.levels)}
    scores = {0: len(_of_level(files, 0)) / options.l0_compaction_trigger} | {n: sizes[n] / options.level_target(n) for n in range(1, options.levels - 1)}
    source = max(scores, key=lambda n: (scores[n], -n))
    if scores[source] <= 1:
        return None
    if source:
        target = source + 1
        pointer = (pointers or {}).get(source)
        own = _of_level(files, source)
        seed = [next((f for f in own if pointer is None or f.largest_key > pointer), own[0])]
    else:
        # Not past a level that holds data: what lies there is older.
        target = next((n for n in range(1, options.levels - 1) if sizes[n] < options.level_target(n) or sizes[n]), options.levels - 1)
        seed = _of_level(files, 0)
    chosen, below = seed, []
    while True:
        low, high = _hull(chosen)
        more_below = [f for f in _of_level(files, target) if f.meets(low, high)]
        low, high = _hull([*chosen, *more_below])
        more = [f for f in _of_level(files, source) if f.meets(low, high)]
        if len(more) == len(chosen) and len(more_below) == len(below):
            break
        chosen, below = more, more_below
    low, high = _hull([*chosen, *below])
    grand = sum(f.file_size for f in _of_level(files, target + 1) if f.meets(low, high)) if target + 1 < options.levels else 0
    return Plan(source, target, tuple(chosen), tuple(below), len(chosen) == 1 and not below and grand <= grandparent_limit(target, options))


def grandparent_limit(target: int, options: Options) -> int:
    """Bytes of the level after ``target`` that one of its files may meet."""
    return max(options.level_target(target), options.level1_target) * options.grandparent_factor
