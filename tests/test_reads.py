import random

import pytest
from pyspark.sql import functions as F

from seqlake.model import LOG, OPS, ScanOptions
from seqlake.operators import compaction, reads, writes


def frame(spark, rows):
    """Rows of (key, seq, kind, value)."""
    return spark.createDataFrame([(bytearray(k), s, kind, None if v is None else bytearray(v)) for k, s, kind, v in rows], LOG)


def pairs(df):
    return [(bytes(r["key"]), bytes(r["value"])) for r in df.collect()]


def test_scan_hides_deleted_keys(spark):
    log = frame(spark, [(b"a", 1, 0, b"va"), (b"b", 2, 0, b"vb"), (b"c", 3, 0, b"vc"), (b"b", 4, 1, None)])
    assert pairs(reads.scan(log)) == [(b"a", b"va"), (b"c", b"vc")]


def test_bounds_reverse_limit(spark):
    log = frame(spark, [(f"k{i}".encode(), i, 0, f"k{i}".encode()) for i in range(1, 5)])
    assert pairs(reads.scan(log, ScanOptions(b"k2", b"k4", limit=1, reverse=True))) == [(b"k3", b"k3")]
    assert pairs(reads.scan(log, ScanOptions(b"k4", b"k2"))) == []
    assert len(pairs(reads.scan(log, ScanOptions(limit=0)))) == 4


def test_prefix_and_start(spark):
    log = frame(spark, [(k, i, 0, b"v") for i, k in enumerate([b"a1", b"a2", b"b1", b"b2"])])
    assert pairs(reads.scan(log, ScanOptions(b"b", prefix=b"a"))) == []
    assert [k for k, _ in pairs(reads.scan(log, ScanOptions(b"a2", prefix=b"a")))] == [b"a2"]


def test_snapshot_isolation(spark):
    log = frame(spark, [(b"d:1", 1, 0, b"v1"), (b"d:2", 2, 0, b"v2"), (b"d:1", 3, 0, b"v1-new"), (b"d:2", 4, 1, None)])
    assert pairs(reads.scan(log)) == [(b"d:1", b"v1-new")]
    assert pairs(reads.scan(log, read_seq=2)) == [(b"d:1", b"v1"), (b"d:2", b"v2")]


def test_keys_that_are_prefixes_of_each_other(spark):
    keys = [b"", b"a", b"a\0", b"ab", b"\x01", b"\xff", b"\xff\xff"]
    log = frame(spark, [(k, i + 1, 0, k + b"!") for i, k in enumerate(keys)])
    assert [k for k, _ in pairs(reads.scan(log))] == sorted(keys)
    for k in keys:
        assert pairs(reads.get(log, k).select("key", "value")) == [(k, k + b"!")]
    assert [k for k, _ in pairs(reads.scan(log, ScanOptions(prefix=b"\xff")))] == [b"\xff", b"\xff\xff"]


def test_empty_value_is_no_tombstone(spark):
    log = frame(spark, [(b"k", 1, 0, b"")])
    assert pairs(reads.scan(log)) == [(b"k", b"")]
    asked = spark.createDataFrame([(0, bytearray(b"k")), (1, bytearray(b"x"))], "pos int, key binary")
    assert [r["found"] for r in reads.multi_get(log, asked).orderBy("pos").collect()] == [True, False]


def test_multi_get_keeps_order_and_repeats(spark):
    log = frame(spark, [(b"k1", 1, 0, b"v1"), (b"k3", 2, 0, b"v3")])
    asked = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate([b"k3", b"no", b"k1", b"k3"])], "pos int, key binary")
    found = reads.multi_get(log, asked).orderBy("pos").collect()
    assert [r["value"] and bytes(r["value"]) for r in found] == [b"v3", None, b"v1", b"v3"]


@pytest.mark.parametrize("prefix, above", [(b"a", b"b"), (b"a\xff", b"b"), (b"\xff\xff", None), ("a", "b"), ("é", "ê"), ("퟿", ""), (b"", None)])
def test_successor(prefix, above):
    assert reads.successor(prefix) == above


def test_prefix_scan_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "log")
    frame(spark, [(f"k{i:05d}".encode(), i, 0, b"v") for i in range(1000)]).write.parquet(path)
    scanned = reads.visible(spark.read.parquet(path), 500, reads.key_range(F.col("key"), ScanOptions(prefix=b"k000")))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = scanned._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan and "LessThanOrEqual(seq" in plan


def test_batch_numbers_and_last_of_a_key_wins(spark):
    ops = spark.createDataFrame([(0, "put", bytearray(b"k1"), bytearray(b"v1")), (1, "delete", bytearray(b"k2"), None), (2, "put", bytearray(b"k1"), bytearray(b"v2"))], OPS)
    base = frame(spark, [(b"k1", 1, 0, b"old"), (b"k2", 2, 0, b"old")])
    after = writes.apply_batch(base, ops, 3)
    assert sorted(r["seq"] for r in after.collect()) == [1, 2, 3, 4, 5]
    assert pairs(reads.scan(after)) == [(b"k1", b"v2")]


def test_stripes_keep_what_snapshots_see(spark):
    log = frame(spark, [(b"k1", 30, 0, b"v30"), (b"k1", 20, 0, b"v20"), (b"k1", 10, 0, b"v10"), (b"k2", 8, 0, b"v8")])
    kept = lambda held: sorted(r["seq"] for r in compaction.compact(log, held).where(F.col("key") == F.lit(b"k1")).collect())
    assert kept([15]) == [10, 30]
    assert kept([]) == [30]


def test_against_a_model(spark):
    """Random operations: every read at every point equals that of a dictionary of versions."""
    rng = random.Random(7)
    keys = [b"a", b"a\0", b"ab", b"b", b"\xff"]
    rows = [(rng.choice(keys), i + 1, int(rng.random() < 0.3), bytes([i])) for i in range(60)]
    rows = [(k, s, kind, None if kind else v) for k, s, kind, v in rows]
    log = frame(spark, rows).cache()
    for seq in (0, 7, 30, 59, None):
        state = {}
        for k, s, kind, v in rows:
            if seq is None or s <= seq:
                state[k] = v
        live = {k: v for k, v in state.items() if v is not None}
        assert pairs(reads.scan(log, read_seq=seq)) == sorted(live.items())
        assert pairs(reads.scan(compaction.compact(log, [7, 30]), read_seq=seq if seq in (7, 30) else None)) == (sorted(live.items()) if seq in (7, 30, None) else pairs(reads.scan(log)))
        window = reads.visible(log, seq, plan="window").orderBy("key")
        assert pairs(window.select("key", "value")) == sorted(live.items())


def test_compare_and_set(spark):
    view = frame(spark, [(b"k1", 1, 0, b"v1"), (b"k2", 2, 0, b"")]).select("key", "value")
    rows = [(0, b"k1", True, b"v1"), (1, b"k1", True, b"no"), (2, b"k3", False, None), (3, b"k1", False, None), (4, b"k3", True, b"v"), (5, b"k2", True, b"")]
    asked = spark.createDataFrame([(i, bytearray(k), e, None if x is None else bytearray(x), bytearray(b"n"), False) for i, k, e, x in rows], "req int, key binary, expect_exists boolean, expected binary, new_value binary, delete boolean")
    judged = writes.compare_and_set(view, asked).orderBy("req").collect()
    assert [r["applied"] for r in judged] == [True, False, True, False, False, True]


def test_write_groups(spark):
    rows = [("q", 1, 2, 10), ("q", 2, 2, 10), ("q", 3, 1, 10), ("q", 4, 9, 10), ("q", 5, 1, 900), ("q", 6, 1, 1), ("r", 1, 1, 1)]
    df = spark.createDataFrame(rows, "queue string, pos int, ops int, bytes int")
    found = {(r["queue"], r["pos"]): r["group_id"] for r in writes.write_groups(df, 4, 100).collect()}
    assert found == {("q", 1): 0, ("q", 2): 0, ("q", 3): 1, ("q", 4): 2, ("q", 5): 3, ("q", 6): 4, ("r", 1): 0}
