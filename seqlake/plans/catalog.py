"""Registry of the engine's own queries, each with the SQL that it equals.

Sequence numbers of snapshots are a quarter and a half of the log's last number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.functions import codec
from seqlake.model import Options, ScanOptions
from seqlake.operators import compaction as C
from seqlake.operators import manifest as M
from seqlake.operators import metrics as R
from seqlake.operators import reads as V
from seqlake.operators import writes as W
from seqlake.sources import derive as D
from seqlake.sources.files import scratch
from seqlake.sources.wal import encode_log
from seqlake.streaming import ingest as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: A key with many versions, and requests with a repeated and a missing key.
KEY = "user:000007"
#: A key that is there at the middle snapshot.
EARLY_KEY = "user:000002"
REQUESTED = ("user:000003", "user:999999", "user:000007", "user:000003", "user:000010")
LEVELS = Options(level1_target=20_000, l0_compaction_trigger=2, l0_slowdown_files=4, l0_stop_files=1000, pending_soft_bytes=100_000, pending_hard_bytes=10**12)
FLUSH_ROWS = 500

# Tables that the SQL builds on, by name, in order of need.
_WITH = {
    "ev": "SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS kind, CASE WHEN event_type <> 'error' THEN props END AS value FROM events",
    "orl": "SELECT 'order:' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_orderkey + 1 AS seq, 0 AS kind, o_orderstatus AS value FROM orders",
    "idx": "SELECT 'order:' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, 2 * o_orderkey + 1 AS seq, o_orderstatus AS value FROM orders UNION ALL SELECT 'idx:cust:' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') || ':' || o_orderstatus || ':' || CAST(o_orderkey AS VARCHAR), 2 * o_orderkey + 2, 'order:' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') FROM orders",
    "snap": "SELECT max(seq) // 4 AS s1, max(seq) // 2 AS s2, max(seq) AS top FROM ev",
    "latest": "SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ev) WHERE rn = 1 AND kind = 0",
    "old": "SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ev, snap WHERE seq <= s2) WHERE rn = 1 AND kind = 0",
    "entries": f"SELECT *, (seq - 1) // {FLUSH_ROWS} AS file_id, CAST(least(((seq - 1) // {FLUSH_ROWS}) % 4, 2) AS INTEGER) AS level FROM ev",
    "files": "SELECT level, file_id, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 20) AS BIGINT) AS file_size, min(key) AS smallest_key, max(key) AS largest_key, min(seq) AS smallest_seqno, max(seq) AS largest_seqno, count(*) AS entries FROM entries GROUP BY level, file_id",
    "levels": "SELECT level, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS level_bytes FROM files GROUP BY level",
    "ofiles": f"SELECT min(key) AS smallest_key, max(key) AS largest_key, (seq - 1) // {FLUSH_ROWS} AS file_id, 1 AS level FROM orl GROUP BY (seq - 1) // {FLUSH_ROWS}",
    "req": "SELECT ts, event_type AS method, event_type <> 'error' AS success, CAST(round(value * 1000) AS BIGINT) AS latency_us FROM events",
    "edits": "SELECT file_id AS edit_no, 'add' AS action, level, file_id FROM files UNION ALL SELECT file_id + 3, 'delete', level, file_id FROM files WHERE file_id % 3 = 0",
}
_NEEDS = {"snap": ["ev"], "latest": ["ev"], "old": ["ev", "snap"], "entries": ["ev"], "files": ["entries"], "levels": ["files"], "ofiles": ["orl"], "edits": ["files"]}


def _with(sql: str, *names: str) -> str:
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({_WITH[n]})" for n in wanted) + " " + sql if wanted else sql


def _query(sql: str | None = None, *names: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = _with(sql, *names)
        return f

    return register


def _snapshots(log: DataFrame) -> tuple[int, int]:
    top = log.agg(F.max("seq")).first()[0] or 0
    return top // 4, top // 2


def _placed(df: DataFrame, reverse: bool = False) -> DataFrame:
    """With ``pos``, so that the order shows. For results that a limit or a bound keeps small."""
    order = F.desc("key") if reverse else F.asc("key")
    return df.withColumn("pos", F.row_number().over(Window.orderBy(order)).cast("long"))


# Reads ---------------------------------------------------------------------------------------


@_query("SELECT key, value FROM latest", "latest")
def latest_view(spark, sf):
    return V.visible(D.event_log(spark, sf)).select("key", "value")


@_query("SELECT key, value FROM old", "old")
def snapshot_view(spark, sf):
    log = D.event_log(spark, sf)
    return V.visible(log, _snapshots(log)[1]).select("key", "value")


@_query("SELECT key, value FROM latest", "latest")
def latest_view_by_window(spark, sf):
    return V.visible(D.event_log(spark, sf), plan="window").select("key", "value")


@_query(
    "SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'changed' END AS change, o.value AS old_value, n.value AS new_value "
    "FROM old o FULL JOIN latest n ON o.key = n.key WHERE o.key IS NULL OR n.key IS NULL OR o.value IS DISTINCT FROM n.value",
    "old", "latest",
)
def snapshot_diff(spark, sf):
    log = D.event_log(spark, sf)
    return V.diff(log, _snapshots(log)[1])


@_query(f"SELECT key, value FROM latest WHERE key = '{KEY}'", "latest")
def point_get(spark, sf):
    return V.get(D.event_log(spark, sf), KEY).select("key", "value")


@_query(f"SELECT key, value FROM old WHERE key = '{EARLY_KEY}'", "old")
def point_get_at_seq(spark, sf):
    log = D.event_log(spark, sf)
    return V.get(log, EARLY_KEY, _snapshots(log)[1]).select("key", "value")


@_query(
    "SELECT d.key, l.key IS NOT NULL AS found FROM (SELECT min(key) AS key FROM (SELECT key, max_by(kind, seq) AS k FROM ev GROUP BY key) WHERE k = 1) d LEFT JOIN latest l ON d.key = l.key WHERE d.key IS NOT NULL",
    "ev", "latest",
)
def point_get_deleted(spark, sf):
    log = D.event_log(spark, sf)
    gone = V.newest(log).where("kind = 1").agg(F.min("key").alias("key")).where("key is not null").withColumn("pos", F.lit(0))
    return V.multi_get(log, gone).select("key", "found")


_REQUESTS = " UNION ALL ".join(f"SELECT {i} AS pos, '{k}' AS key" for i, k in enumerate(REQUESTED))


@_query(f"SELECT r.pos, r.key, l.key IS NOT NULL AS found, l.value FROM ({_REQUESTS}) r LEFT JOIN latest l ON r.key = l.key", "latest")
def multi_get(spark, sf):
    return V.multi_get(D.event_log(spark, sf), spark.createDataFrame(list(enumerate(REQUESTED)), "pos int, key string"))


def _scanned(options: ScanOptions, orders: bool = False) -> Query:
    def run(spark, sf):
        log = D.order_log(spark, sf) if orders else D.event_log(spark, sf)
        return V.scan(log, options)

    return run


def _scan(name: str, options: ScanOptions, sql: str, *names: str, orders: bool = False, placed: bool = False) -> None:
    run = _scanned(options, orders)
    _QUERIES[name] = (lambda spark, sf: _placed(run(spark, sf), options.reverse)) if placed else run
    _SQL[name] = _with(sql, *names)


_scan("scan_range", ScanOptions("user:000010", "user:000050"), "SELECT key, value FROM latest WHERE key >= 'user:000010' AND key < 'user:000050'", "latest")
_scan("scan_prefix", ScanOptions(prefix="order:00000001"), "SELECT key, value FROM orl WHERE starts_with(key, 'order:00000001')", "orl", orders=True)
_scan(
    "scan_range_prefix_limit", ScanOptions("user:000010", "user:000090", "user:0000", 7),
    "SELECT key, value, row_number() OVER (ORDER BY key) AS pos FROM latest WHERE key >= 'user:000010' AND key < 'user:000090' AND starts_with(key, 'user:0000') ORDER BY key LIMIT 7", "latest", placed=True,
)
_scan("scan_reverse_limit", ScanOptions("user:000010", limit=5, reverse=True), "SELECT key, value, row_number() OVER (ORDER BY key DESC) AS pos FROM latest WHERE key >= 'user:000010' ORDER BY key DESC LIMIT 5", "latest", placed=True)
_scan("scan_empty_intersection", ScanOptions("user:000090", "user:000010"), "SELECT key, value FROM latest WHERE key >= 'user:000090' AND key < 'user:000010'", "latest")
_scan("scan_limit_zero", ScanOptions(limit=0), "SELECT key, value FROM latest", "latest")


@_query("SELECT key, value, row_number() OVER (ORDER BY key DESC) AS pos FROM old ORDER BY key DESC LIMIT 10", "old")
def scan_snapshot_reverse(spark, sf):
    log = D.event_log(spark, sf)
    return _placed(V.scan(log, ScanOptions(limit=10, reverse=True), _snapshots(log)[1]), reverse=True)


@_query(f"SELECT key, seq, kind, value FROM ev WHERE key = '{KEY}'", "ev")
def version_history(spark, sf):
    return V.history(D.event_log(spark, sf), F.col("key") == KEY).select("key", "seq", "kind", "value")


@_query("SELECT key, seq AS valid_from, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS valid_to FROM ev", "ev")
def version_intervals(spark, sf):
    return V.history(D.event_log(spark, sf)).select("key", "valid_from", "valid_to")


@_query("SELECT key, seq FROM (SELECT key, seq, kind, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ev) WHERE rn = 1 AND kind = 1", "ev")
def tombstones(spark, sf):
    return V.newest(D.event_log(spark, sf)).where("kind = 1").select("key", "seq")


@_query("SELECT count(*) AS versions, count(DISTINCT key) AS keys, (SELECT count(*) FROM latest) AS live, count(DISTINCT key) - (SELECT count(*) FROM latest) AS dead FROM ev", "latest")
def live_dead_counts(spark, sf):
    log = D.event_log(spark, sf)
    by_key = log.groupBy("key").agg(F.count("*").alias("n"), F.max_by("kind", "seq").alias("kind"))
    live = F.count_if(F.col("kind") == 0)
    return by_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("versions"), F.count("*").alias("keys"), live.alias("live"), (F.count("*") - live).alias("dead"))


@_query(
    "SELECT i.key AS index_key, r.key, r.value FROM idx i JOIN idx r ON i.value = r.key WHERE starts_with(i.key, 'idx:cust:0000001')",
    "idx",
)
def index_lookup(spark, sf):
    return V.index_lookup(D.index_log(spark, sf), "idx:cust:0000001")


@_query(
    "SELECT p.key, p.at, CASE WHEN e.kind = 0 THEN e.value END AS value, coalesce(e.kind = 0, FALSE) AS found FROM (SELECT key, seq - 1 AS at FROM ev) p ASOF LEFT JOIN ev e ON p.key = e.key AND p.at >= e.seq",
    "ev",
)
def as_of_join(spark, sf):
    log = D.event_log(spark, sf)
    return V.as_of(log, log.select("key", (F.col("seq") - 1).alias("at")))


@_query("SELECT key, seq, kind, value FROM ev", "ev")
def run_merge(spark, sf):
    log = D.event_log(spark, sf)
    return V.merge_runs(*[log.where(F.pmod("seq", F.lit(4)) == i) for i in range(4)])


# Writes and transactions ----------------------------------------------------------------------

_BATCH = (("put", "user:000001", "one"), ("delete", "user:000002", None), ("put", "user:000001", "two"), ("put", "user:new", "three"))
_AFTER = "SELECT key, value FROM latest WHERE key NOT IN ('user:000001', 'user:000002', 'user:new') UNION ALL SELECT 'user:000001', 'two' UNION ALL SELECT 'user:new', 'three'"


def _ops(spark: SparkSession, ops) -> DataFrame:
    return spark.createDataFrame([(i, *op) for i, op in enumerate(ops)], "op_idx int, op string, key string, value string")


def _after(spark, sf, ops) -> DataFrame:
    log = D.event_log(spark, sf)
    base = (log.agg(F.max("seq")).first()[0] or 0) + 1
    return V.visible(W.apply_batch(log, _ops(spark, ops), base)).select("key", "value")


@_query(_AFTER, "latest")
def batch_apply_latest(spark, sf):
    return _after(spark, sf, _BATCH)


@_query("SELECT key, value FROM latest WHERE key <> 'user:missing'", "latest")
def delete_missing_key(spark, sf):
    return _after(spark, sf, [("delete", "user:missing", None)])


_CAS = "SELECT seq AS req, key, seq % 3 <> 0 AS expect_exists, CASE WHEN seq % 3 = 1 THEN value WHEN seq % 3 = 2 THEN 'other' END AS expected, seq % 2 = 0 AS del FROM latest"


def _requests(log: DataFrame) -> DataFrame:
    view = V.visible(log)
    third = F.pmod("seq", F.lit(3))
    return view.select(F.col("seq").alias("req"), "key", (third != 0).alias("expect_exists"), F.when(third == 1, F.col("value")).when(third == 2, "other").alias("expected"), F.lit("new").alias("new_value"), (F.pmod("seq", F.lit(2)) == 0).alias("delete"))


@_query(f"SELECT l.key, CASE WHEN c.applied THEN 'new' ELSE l.value END AS value FROM latest l JOIN (SELECT c.key, c.del, expect_exists AND l.value IS NOT DISTINCT FROM c.expected AS applied FROM ({_CAS}) c JOIN latest l ON c.key = l.key) c ON l.key = c.key WHERE NOT (c.applied AND c.del)", "latest")
def cas_apply(spark, sf):
    log = D.event_log(spark, sf)
    judged = W.compare_and_set(V.visible(log), _requests(log)).where("applied")
    staged = judged.select(F.col("req").alias("op_idx"), "op", "key", F.col("new_value").alias("value"))
    return V.overlay(V.visible(log), staged)


@_query(f"SELECT c.req, c.key FROM ({_CAS}) c JOIN latest l ON c.key = l.key WHERE NOT (expect_exists AND l.value IS NOT DISTINCT FROM c.expected)", "latest")
def cas_conflicts(spark, sf):
    log = D.event_log(spark, sf)
    return W.compare_and_set(V.visible(log), _requests(log)).where(~F.col("applied")).select("req", "key")


@_query(f"SELECT key, value FROM ({_AFTER}) WHERE key < 'user:000020'", "latest")
def txn_overlay_scan(spark, sf):
    options = ScanOptions(end="user:000020")
    staged = _ops(spark, _BATCH)
    return V.arrange(V.overlay(V.visible(D.event_log(spark, sf)), staged).where(V.key_range(F.col("key"), options)), options)


@_query(f"SELECT key, value FROM ({_AFTER}) WHERE key IN ('user:000001', 'user:000002', 'user:000003')", "latest")
def txn_overlay_get(spark, sf):
    wanted = F.col("key").isin("user:000001", "user:000002", "user:000003")
    return V.overlay(V.visible(D.event_log(spark, sf), keys=wanted), _ops(spark, _BATCH).where(wanted))


@_query(_AFTER, "latest")
def txn_commit_view(spark, sf):
    log = D.event_log(spark, sf)
    staged = V.overlay(V.visible(log), _ops(spark, _BATCH))
    committed = _after(spark, sf, _BATCH)
    return committed.join(staged.select("key"), "key", "left_semi")


@_query(f"SELECT key, value FROM ({_AFTER}) WHERE key NOT IN ('user:000003', 'user:gone')", "latest")
def txn_rollback_view(spark, sf):
    """Two transactions have staged operations; only those of the first are committed."""
    kept = _ops(spark, _BATCH).withColumn("txn", F.lit(1))
    dropped = _ops(spark, [("delete", "user:000004", None), ("put", "user:gone", "x"), ("put", "user:000001", "y")]).withColumn("txn", F.lit(2))
    ended = spark.createDataFrame([(1, "commit"), (2, "rollback")], "txn int, outcome string")
    staged = kept.unionByName(dropped).join(F.broadcast(ended.where("outcome = 'commit'")), "txn", "left_semi").drop("txn")
    return V.overlay(V.visible(D.event_log(spark, sf)), staged).where("key not in ('user:000003', 'user:gone')")


_GROUP_OPS, _GROUP_BYTES = 16, 1000


@_query(
    "WITH RECURSIVE ev AS (" + _WITH["ev"] + "), q AS (SELECT CAST(substr(key, 6) AS BIGINT) % 64 AS queue, seq AS pos, strlen(key) + coalesce(strlen(value), 0) + 20 AS bytes, row_number() OVER (PARTITION BY CAST(substr(key, 6) AS BIGINT) % 64 ORDER BY seq) AS i FROM ev), "
    "g AS (SELECT queue, pos, i, 0 AS group_id, 1 AS n, bytes AS size FROM q WHERE i = 1 "
    f"UNION ALL SELECT q.queue, q.pos, q.i, g.group_id + CASE WHEN g.n + 1 > {_GROUP_OPS} OR g.size + q.bytes > {_GROUP_BYTES} THEN 1 ELSE 0 END, CASE WHEN g.n + 1 > {_GROUP_OPS} OR g.size + q.bytes > {_GROUP_BYTES} THEN 1 ELSE g.n + 1 END, CASE WHEN g.n + 1 > {_GROUP_OPS} OR g.size + q.bytes > {_GROUP_BYTES} THEN q.bytes ELSE g.size + q.bytes END FROM g JOIN q ON q.queue = g.queue AND q.i = g.i + 1) "
    "SELECT queue, pos, group_id::BIGINT AS group_id FROM g"
)
def write_groups(spark, sf):
    log = D.event_log(spark, sf)
    queue = F.pmod(F.substring("key", 6, 6).cast("long"), F.lit(64)).alias("queue")
    return W.write_groups(log.select(queue, F.col("seq").alias("pos"), F.lit(1).alias("ops"), C.entry_bytes().cast("int").alias("bytes")), _GROUP_OPS, _GROUP_BYTES)


@_query("SELECT seq, count(*) AS holders FROM (SELECT s1 AS seq FROM snap UNION ALL SELECT s2 FROM snap UNION ALL SELECT s2 FROM snap UNION ALL SELECT top FROM snap) GROUP BY seq", "snap")
def snapshot_holders(spark, sf):
    """How many snapshots hold each sequence number; the oldest bounds what compaction may drop."""
    log = D.event_log(spark, sf)
    first, second = _snapshots(log)
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return spark.createDataFrame([(s,) for s in (first, second, second, top)], "seq long").groupBy("seq").agg(F.count("*").alias("holders"))


# Compaction and files ---------------------------------------------------------------------------


@_query("SELECT key, seq, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM ev) WHERE rn = 1", "ev")
def compact_no_snapshot(spark, sf):
    return C.compact(D.event_log(spark, sf)).select("key", "seq", "kind", "value")


@_query("SELECT key, seq, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key, CASE WHEN seq <= s1 THEN 1 WHEN seq <= s2 THEN 2 ELSE 3 END ORDER BY seq DESC) AS rn FROM ev, snap) WHERE rn = 1", "ev", "snap")
def compact_stripes(spark, sf):
    log = D.event_log(spark, sf)
    return C.compact(log, _snapshots(log)).select("key", "seq", "kind", "value")


@_query(
    "SELECT read_at, key, value FROM (SELECT b.read_at, e.key, e.value, e.kind, row_number() OVER (PARTITION BY b.read_at, e.key ORDER BY e.seq DESC) AS rn FROM ev e, (SELECT s1 AS read_at FROM snap UNION SELECT s2 FROM snap UNION SELECT top FROM snap) b WHERE e.seq <= b.read_at) WHERE rn = 1 AND kind = 0",
    "ev", "snap",
)
def compaction_invariance(spark, sf):
    """What reads at the snapshots and at the end see of the compacted log; the SQL reads the whole one."""
    log = D.event_log(spark, sf)
    held = sorted({*_snapshots(log), log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]})
    merged = C.compact(log, held)
    views = [V.visible(merged, seq).select(F.lit(seq).cast("long").alias("read_at"), "key", "value") for seq in held]
    return reduce(DataFrame.unionByName, views)


def _files(spark, sf) -> DataFrame:
    return C.file_stats(D.flushed(D.event_log(spark, sf), FLUSH_ROWS))


def _order_files(spark, sf) -> DataFrame:
    return C.file_stats(D.flushed(D.order_log(spark, sf), FLUSH_ROWS).withColumn("level", F.lit(1)))


@_query("SELECT * FROM files", "files")
def file_stats(spark, sf):
    return _files(spark, sf)


@_query("SELECT * FROM levels", "levels")
def level_stats(spark, sf):
    return C.level_stats(_files(spark, sf))


@_query(f"SELECT level, file_id FROM files WHERE smallest_key <= '{KEY}' AND largest_key >= '{KEY}'", "files")
def files_for_key(spark, sf):
    return C.files_for_key(_files(spark, sf), KEY).select("level", "file_id")


@_query("SELECT level, file_id FROM files, snap WHERE smallest_seqno <= s1", "files", "snap")
def files_for_snapshot(spark, sf):
    return C.files_for_snapshot(_files(spark, sf), _snapshots(D.event_log(spark, sf))[0]).select("level", "file_id")


@_query("SELECT a.file_id AS source_id, b.file_id AS target_id, b.file_size FROM files a JOIN files b ON a.smallest_key <= b.largest_key AND a.largest_key >= b.smallest_key WHERE a.level = 0 AND b.level = 1", "files")
def overlapping_files(spark, sf):
    return C.overlapping_pairs(_files(spark, sf), 0, 1)


@_query("SELECT CAST(coalesce(sum(file_size), 0) AS BIGINT) AS overlap_bytes FROM files WHERE level = 2 AND smallest_key <= 'user:000050' AND largest_key >= 'user:000010'", "files")
def overlap_bytes(spark, sf):
    return C.overlapping(_files(spark, sf).where("level = 2"), "user:000010", "user:000050").agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("overlap_bytes"))


@_query("SELECT min(smallest_key) AS smallest_key, max(largest_key) AS largest_key FROM files WHERE level = 1", "files")
def key_range_hull(spark, sf):
    return _files(spark, sf).where("level = 1").agg(F.min("smallest_key").alias("smallest_key"), F.max("largest_key").alias("largest_key"))


@_query("SELECT level, file_id FROM (SELECT *, lag(largest_key) OVER (PARTITION BY level ORDER BY smallest_key, file_id) AS p FROM files WHERE level > 0) WHERE p >= smallest_key", "files")
def level_overlap_check(spark, sf):
    return C.level_overlaps(_files(spark, sf)).select("level", "file_id")


@_query("SELECT level, file_id FROM (SELECT *, lag(largest_key) OVER (PARTITION BY level ORDER BY smallest_key, file_id) AS p FROM ofiles) WHERE p < smallest_key", "ofiles")
def level_neighbours_apart(spark, sf):
    """Files of a sorted level that lie behind their neighbour, as all but the first must."""
    files = _order_files(spark, sf)
    first = files.groupBy("level").agg(F.min_by("file_id", F.struct("smallest_key", "file_id")).alias("file_id"))
    return files.select("level", "file_id").join(first, ["level", "file_id"], "left_anti").join(C.level_overlaps(files), ["level", "file_id"], "left_anti")


_TARGET = f"CAST({LEVELS.level1_target} * pow({LEVELS.level_multiplier}, level - 1) AS BIGINT)"
_PENDING = f"SELECT CAST(coalesce(sum(CASE WHEN level > 0 THEN greatest(level_bytes - {_TARGET}, 0) WHEN n_files > {LEVELS.l0_compaction_trigger} THEN level_bytes ELSE 0 END), 0) AS BIGINT) AS pending_bytes FROM levels"


@_query(_PENDING, "levels")
def pending_compaction_bytes(spark, sf):
    return C.pending_bytes(_files(spark, sf), LEVELS)


@_query(f"SELECT level, CASE WHEN level = 0 THEN n_files / {LEVELS.l0_compaction_trigger} ELSE level_bytes / {_TARGET} END AS score FROM levels WHERE level <= {LEVELS.levels - 2}", "levels")
def compaction_score(spark, sf):
    return C.compaction_scores(_files(spark, sf), LEVELS)


@_query(
    f"SELECT l0_files, pending_bytes, CASE WHEN l0_files >= {LEVELS.l0_stop_files} OR pending_bytes >= {LEVELS.pending_hard_bytes} THEN 'stop' WHEN l0_files >= {LEVELS.l0_slowdown_files} OR pending_bytes >= {LEVELS.pending_soft_bytes} THEN 'slowdown' ELSE 'normal' END AS pressure, "
    f"CASE WHEN l0_files >= {LEVELS.l0_stop_files} THEN 'l0_stop_trigger' WHEN pending_bytes >= {LEVELS.pending_hard_bytes} THEN 'pending_compaction_hard_limit' WHEN l0_files >= {LEVELS.l0_slowdown_files} AND pending_bytes >= {LEVELS.pending_soft_bytes} THEN 'l0_and_pending_compaction_slowdown' WHEN l0_files >= {LEVELS.l0_slowdown_files} THEN 'l0_slowdown_trigger' WHEN pending_bytes >= {LEVELS.pending_soft_bytes} THEN 'pending_compaction_soft_limit' ELSE 'below_thresholds' END AS reason "
    f"FROM (SELECT count(*) FILTER (level = 0) AS l0_files FROM files), ({_PENDING})",
    "files", "levels",
)
def write_pressure(spark, sf):
    return C.write_pressure(_files(spark, sf), LEVELS)


@_query(
    "SELECT row_number() OVER (ORDER BY cut NULLS FIRST) - 1 AS part, cut AS start_key, lead(cut) OVER (ORDER BY cut NULLS FIRST) AS end_key FROM (SELECT NULL AS cut UNION ALL SELECT DISTINCT b.k FROM "
    "(SELECT largest_key AS k, row_number() OVER (ORDER BY largest_key) - 1 AS i, count(*) OVER () - 1 AS n FROM (SELECT DISTINCT largest_key FROM ofiles)) b, range(1, 4) t(j) WHERE b.i < b.n AND t.j <= least(3, b.n) AND b.i = t.j * b.n // (least(3, b.n) + 1))",
    "ofiles",
)
def subcompaction_ranges(spark, sf):
    return C.subcompaction_ranges(_order_files(spark, sf), 4).select(F.col("part").cast("long").alias("part"), "start_key", "end_key")


def _edits(spark, sf) -> DataFrame:
    files = _files(spark, sf).select("level", "file_id")
    add = files.select(F.col("file_id").alias("edit_no"), F.lit("add").alias("action"), "level", "file_id")
    return add.unionByName(files.where("file_id % 3 = 0").select((F.col("file_id") + 3).alias("edit_no"), F.lit("delete").alias("action"), "level", "file_id"))


@_query("SELECT level, file_id FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY edit_no DESC) AS rn FROM edits) WHERE rn = 1 AND action = 'add'", "edits")
def manifest_replay(spark, sf):
    return M.replay_edits(_edits(spark, sf)).select("level", "file_id")


_LIVE = "SELECT DISTINCT file_id FROM (SELECT *, lead(edit_no) OVER (PARTITION BY file_id ORDER BY edit_no) AS until, max(edit_no) OVER () AS last FROM edits) WHERE action = 'add' AND (until IS NULL OR until > last - 9)"


@_query(_LIVE, "edits")
def live_files(spark, sf):
    return M.live_files(_edits(spark, sf), 10)


@_query(f"SELECT DISTINCT file_id FROM edits WHERE action = 'delete' AND file_id NOT IN ({_LIVE})", "edits")
def obsolete_files(spark, sf):
    return M.obsolete_files(_edits(spark, sf), 10)


_BAD = "SELECT edit_no, action, level, file_id FROM edits UNION ALL SELECT 1000000, 'add', 1, file_id FROM files UNION ALL SELECT 1000001, 'delete', 0, -1 - file_id FROM files UNION ALL SELECT 1000002, 'add', 7 + file_id, 5000000 + file_id FROM files UNION ALL SELECT 1000003, 'add', -1, 6000000 + file_id FROM files"


@_query(
    f"SELECT edit_no, action, level, file_id, reason FROM (SELECT *, CASE WHEN level < 0 OR level >= 7 THEN 'no such level' WHEN action = 'add' AND before = 'add' THEN 'file is there already' WHEN action = 'delete' AND (before IS NULL OR before = 'delete') THEN 'file isn''t there' END AS reason FROM (SELECT *, lag(action) OVER (PARTITION BY file_id ORDER BY edit_no) AS before FROM ({_BAD}))) WHERE reason IS NOT NULL",
    "edits",
)
def edit_validation(spark, sf):
    """Edits with repeated, unknown and misplaced files among good ones."""
    files = _files(spark, sf)
    bad = [(1_000_000, "add", F.lit(1), F.col("file_id")), (1_000_001, "delete", F.lit(0), -1 - F.col("file_id")), (1_000_002, "add", 7 + F.col("file_id"), 5_000_000 + F.col("file_id")), (1_000_003, "add", F.lit(-1), 6_000_000 + F.col("file_id"))]
    edits = _edits(spark, sf).select(F.col("edit_no").cast("long").alias("edit_no"), "action", F.col("level").cast("long").alias("level"), "file_id")
    for number, action, level, file_id in bad:
        edits = edits.unionByName(files.select(F.lit(number).cast("long").alias("edit_no"), F.lit(action).alias("action"), level.cast("long").alias("level"), file_id.alias("file_id")))
    return M.invalid_edits(edits, 7).select("edit_no", "action", "level", "file_id", "reason")


# Metrics ------------------------------------------------------------------------------------------


@_query("SELECT method, count(*) AS total, count(*) FILTER (success) AS success, count(*) FILTER (NOT success) AS error FROM req GROUP BY method", "req")
def rpc_counters(spark, sf):
    return R.counters(D.request_log(spark, sf))


@_query("SELECT count(*) AS total, count(*) FILTER (NOT success) AS errors, CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (NOT success) / count(*) END::DOUBLE AS error_rate FROM req", "req")
def rpc_error_rate(spark, sf):
    return R.error_rate(D.request_log(spark, sf))


_BOUNDS = ", ".join(f"({b})" for b in R.BOUNDS)


@_query(f"SELECT b::BIGINT AS bound_us, (SELECT count(*) FROM req WHERE latency_us <= b) AS cumulative FROM (VALUES {_BOUNDS}) t(b) UNION ALL SELECT NULL, count(*) FROM req", "req")
def latency_histogram(spark, sf):
    return R.histogram(D.request_log(spark, sf))


@_query(
    f"SELECT q, coalesce((SELECT min(b) FROM (VALUES {_BOUNDS}) t(b) WHERE (SELECT count(*) FROM req WHERE latency_us <= b) >= ceil((SELECT count(*) FROM req) * q)), {R.BOUNDS[-1]}) / 1000000.0::DOUBLE AS seconds FROM (VALUES (0.95::DOUBLE), (0.99::DOUBLE)) s(q)",
    "req",
)
def latency_quantiles(spark, sf):
    return R.quantiles(D.request_log(spark, sf))


@_query("SELECT avg(latency_us) AS avg_us, max(latency_us) AS max_us FROM req", "req")
def latency_avg_max(spark, sf):
    return R.average_and_largest(D.request_log(spark, sf))


@_query("SELECT second, n AS requests, CAST(sum(n) OVER (ORDER BY second RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS DOUBLE) / 60 AS qps FROM (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS n FROM req GROUP BY 1)", "req")
def qps_60s(spark, sf):
    return R.rolling_rate(D.request_log(spark, sf))


_RANKS = ", ".join(f"max(latency_us) FILTER (rn = greatest(1, ceil(n * {q})::BIGINT)) AS p{round(q * 100)}" for q in (0.5, 0.95, 0.99))


@_query(f"SELECT method, {_RANKS} FROM (SELECT method, latency_us, row_number() OVER (PARTITION BY method ORDER BY latency_us) AS rn, count(*) OVER (PARTITION BY method) AS n FROM req) GROUP BY method", "req")
def sample_percentiles(spark, sf):
    return R.sample_percentiles(D.request_log(spark, sf))


# Codecs, logs and streams -----------------------------------------------------------------------


@_query("SELECT key, seq, kind, seq * 256 + kind AS encoded, upper(hex(key)) || printf('%016X', -1 - (seq * 256 + kind)) AS internal_hex FROM ev", "ev")
def encoded_key_order(spark, sf):
    log = D.event_log(spark, sf)
    encoded = codec.encode_seq(F.col("seq"), F.col("kind"))
    serialized = codec.internal_key(F.col("key"), F.col("seq"), F.col("kind"))
    key, seq, kind = codec.split_internal_key(serialized)
    return log.select(key.cast("string").alias("key"), seq.alias("seq"), kind.alias("kind"), encoded.alias("encoded"), F.hex(serialized).alias("internal_hex"))


@_query("SELECT printf('key_%016d', i) AS key, printf('%06d.wal', i) AS log_name, ceil(-(i + 1) * ln(0.01) / (ln(2) * ln(2)))::BIGINT AS bloom_bits FROM range(1000) t(i)")
def bench_keyspace(spark, sf):
    i = F.col("id")
    return spark.range(1000).select(codec.bench_key(i).alias("key"), codec.log_name(i).alias("log_name"), codec.bloom_bits(i + 1, 0.01).alias("bloom_bits"))


_NUMBER = "CAST(event_id AS BIGINT) * event_id * 7919 + event_id"
_VARINT = " || ".join(f"CASE WHEN {i} = 0 OR n >= {1 << 7 * i} THEN printf('%02X', ((n >> {7 * i}) & 127) | CASE WHEN n >= {1 << 7 * (i + 1)} THEN 128 ELSE 0 END) ELSE '' END" for i in range(8))


@_query(f"SELECT n, {_VARINT} AS encoded, n AS decoded FROM (SELECT {_NUMBER} AS n FROM events)")
def varint_codec(spark, sf):
    i = F.col("event_id").cast("long")
    numbers = D.table(spark, sf, "events").select((i * i * 7919 + i).alias("n"))
    encoded = numbers.select("n", codec.varint_column(F.col("n")).alias("bytes"))
    return encoded.select("n", F.hex("bytes").alias("encoded"), codec.read_varint_column(F.col("bytes")).alias("decoded"))


@_query(
    "SELECT event_id, string_agg(printf('%02X', n) || upper(hex(c)), '' ORDER BY pos) AS encoded, any_value(text) AS decoded FROM (SELECT event_id, text, c, count(*) AS n, min(i) AS pos FROM (SELECT event_id, text, i, substr(text, i, 1) AS c, i - row_number() OVER (PARTITION BY event_id, substr(text, i, 1) ORDER BY i) AS island FROM (SELECT event_id, text, unnest(range(1, strlen(text) + 1)) AS i FROM (SELECT event_id, CAST(event_id * 1001 AS VARCHAR) || repeat('0', CAST(event_id % 7 AS INTEGER)) AS text FROM events))) GROUP BY event_id, text, c, island) GROUP BY event_id",
)
def run_length_codec(spark, sf):
    text = F.expr("concat(cast(event_id * 1001 as string), repeat('0', cast(event_id % 7 as int)))")
    packed = D.table(spark, sf, "events").select("event_id", codec.rle_column(text.cast("binary")).alias("bytes"))
    return packed.select("event_id", F.hex("bytes").alias("encoded"), codec.read_rle_column(F.col("bytes")).cast("string").alias("decoded"))


@_query("SELECT least(length(key), 11) AS n, substr(key, 1, 11) AS prefix, count(*) AS keys FROM latest GROUP BY ALL", "latest")
def bloom_prefixes(spark, sf):
    """What bloom filters with a prefix length of 11 hold of the live keys, and for how many of them."""
    held = V.visible(D.event_log(spark, sf)).select(codec.bloom_key(F.col("key"), 11).cast("string").alias("prefix"))
    return held.groupBy(F.length("prefix").cast("long").alias("n"), "prefix").agg(F.count("*").alias("keys"))


@_query("SELECT name, CASE WHEN regexp_full_match(name, 'MANIFEST-[0-9]+') THEN CAST(substr(name, 10) AS BIGINT) END AS number FROM (SELECT CASE i % 4 WHEN 0 THEN 'CURRENT' WHEN 1 THEN 'MANIFEST-' || i WHEN 2 THEN 'MANIFEST-' || i || '.tmp' ELSE printf('MANIFEST-%06d', i) END AS name FROM range(40) t(i))")
def manifest_names(spark, sf):
    i = F.col("id")
    name = F.when(i % 4 == 0, "CURRENT").when(i % 4 == 1, F.concat(F.lit("MANIFEST-"), i)).when(i % 4 == 2, F.concat(F.lit("MANIFEST-"), i, F.lit(".tmp"))).otherwise(F.format_string("MANIFEST-%06d", i))
    return spark.range(40).select(name.alias("name")).select("name", codec.manifest_number(F.col("name")).alias("number"))


@_query("SELECT p AS part, p * (1003 // 16) + least(p, 1003 % 16) AS range_begin, (p + 1) * (1003 // 16) + least(p + 1, 1003 % 16) AS range_end FROM range(16) t(p)")
def split_ranges(spark, sf):
    begin, end = codec.split_range(1003, 16, F.col("id"))
    return spark.range(16).select(F.col("id").alias("part"), begin.alias("range_begin"), end.alias("range_end"))


def _wal_bytes(spark, sf) -> DataFrame:
    return encode_log(D.event_log(spark, sf), 5_000, batch=10)


def _decoded(spark: SparkSession, files: DataFrame, torn: bool = False) -> DataFrame:
    """Replay log bytes; ``torn`` cuts the last bytes of the log of the highest number."""
    import pyarrow as pa

    from seqlake.sources.wal import replay

    def decode(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = replay(content).rows
                if rows:
                    keys, seqs, kinds, values = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in keys]), pa.array(seqs, pa.int64()), pa.array(kinds, pa.int32()), pa.array([None if k else v.decode() for k, v in zip(kinds, values, strict=True)], pa.string())], ["key", "seq", "kind", "value"])

    content = F.col("content")
    if torn:
        last = files.agg(F.max("number")).first()[0]
        content = F.when(F.col("number") == (last or 0), F.substring("content", F.lit(1), F.octet_length("content") - 5)).otherwise(F.col("content"))
    return files.select(content.alias("content")).mapInArrow(decode, "key string, seq long, kind int, value string")


@_query("SELECT key, seq, kind, value FROM ev", "ev")
def wal_roundtrip(spark, sf):
    return _decoded(spark, _wal_bytes(spark, sf))


@_query("SELECT (seq - 1) // 5000 AS number, count(*) AS entries, max(seq) AS last_sequence, FALSE AS truncated FROM ev GROUP BY 1", "ev")
def wal_replay_stats(spark, sf):
    """What the replay of each log file finds."""
    import pyarrow as pa

    from seqlake.sources.wal import replay

    def read(batches):
        for batch in batches:
            found = [replay(content) for content in batch.column(1).to_pylist()]
            columns = [batch.column(0).cast(pa.int64()), pa.array([len(r.rows) for r in found], pa.int64()), pa.array([r.max_sequence for r in found], pa.int64()), pa.array([r.truncated for r in found])]
            yield pa.RecordBatch.from_arrays(columns, ["number", "entries", "last_sequence", "truncated"])

    return _wal_bytes(spark, sf).select("number", "content").mapInArrow(read, "number long, entries long, last_sequence long, truncated boolean")


@_query("SELECT key, seq, kind, value FROM ev, (SELECT min(seq) AS low, max(seq) AS top FROM ev) WHERE seq < low + (top - low) // 10 * 10", "ev")
def wal_torn_tail(spark, sf):
    return _decoded(spark, _wal_bytes(spark, sf), torn=True)


@_query("SELECT key, value FROM latest", "latest")
def stream_latest_view(spark, sf):
    schema = D.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    gone = F.col("event_type") == "error"
    key = F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    changes = events.select(key.alias("key"), (F.col("event_id") + 1).alias("seq"), gone.cast("int").alias("kind"), F.when(~gone, F.col("props")).alias("value"))
    top = scratch(spark, "stream")
    return S.latest_view(spark, changes, f"{top}/log", f"{top}/state")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flush and stripe-compact the event log, then scan it in reverse at a snapshot."""
    log = D.event_log(spark, sf_dir)
    held = _snapshots(log)
    return V.scan(C.compact(D.flushed(log, FLUSH_ROWS).select("key", "seq", "kind", "value"), held), ScanOptions(limit=100, reverse=True), held[1])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


