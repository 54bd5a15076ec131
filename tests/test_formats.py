import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqlake.errors import Corruption
from seqlake.functions import codec
from seqlake.operators import compaction, metrics
from seqlake.operators.compaction import File
from seqlake.model import Options
from seqlake.sources import wal

RECORD = wal.encode_record(b"key", 5, 0, b"value")


@given(st.integers(0, 2**64 - 1))
def test_varint(n):
    assert codec.read_varint(codec.varint(n)) == (n, len(codec.varint(n)))


@pytest.mark.parametrize("data", [b"", b"\x80", b"\xff" * 10 + b"\x01"])
def test_bad_varint(data):
    with pytest.raises(Corruption):
        codec.read_varint(data)


@given(st.binary(max_size=600), st.integers(0, 600))
def test_run_lengths(data, n):
    data += b"x" * n
    assert codec.rle_decode(codec.rle_encode(data), len(data)) == data


@pytest.mark.parametrize("data, size", [(b"\x01", 1), (b"\x00a", 0), (b"\x02a", 1), (b"\x01a", 2)])
def test_bad_run_lengths(data, size):
    with pytest.raises(Corruption):
        codec.rle_decode(data, size)


def test_internal_keys_sort_newest_first(spark):
    rows = [(bytearray(b"a"), 1, 0), (bytearray(b"a"), 2, 1), (bytearray(b"b"), 2**55, 0)]
    df = spark.createDataFrame(rows, "key binary, seq long, kind int")
    serialized = df.withColumn("s", codec.internal_key(F.col("key"), F.col("seq"), F.col("kind")))
    assert [r["seq"] for r in serialized.orderBy("s").collect()] == [2, 1, 2**55]
    key, seq, kind = codec.split_internal_key(F.col("s"))
    assert [tuple(r) for r in serialized.select(key, seq, kind).collect()] == rows


def test_unknown_kind_is_an_error(spark):
    with pytest.raises(Exception, match="Corruption"):
        spark.range(1).select(codec.checked_kind(F.lit(7))).collect()


def test_codec_columns(spark):
    numbers = [0, 1, 127, 128, 300, 2**14 - 1, 2**14, 2**35 + 7, 2**62, 2**63 - 1, None]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").withColumn("bytes", codec.varint_column(F.col("n")))
    for row in df.withColumn("back", codec.read_varint_column(F.col("bytes"))).collect():
        assert row["back"] == row["n"] and (row["n"] is None or bytes(row["bytes"]) == codec.varint(row["n"]))
    texts = [b"", b"a", b"aaab", b"\x00" * 600, bytes(range(256)), b"\x11\x11\x10\x01\x01", None]
    df = spark.createDataFrame([(None if t is None else bytearray(t),) for t in texts], "t binary").withColumn("bytes", codec.rle_column(F.col("t")))
    for row in df.withColumn("back", codec.read_rle_column(F.col("bytes"))).collect():
        assert row["back"] == row["t"] and (row["t"] is None or bytes(row["bytes"]) == codec.rle_encode(bytes(row["t"])))


def test_bench_values(spark):
    values = [r[0] for r in spark.range(30).select(codec.bench_value(F.col("id"), 100)).collect()]
    assert values[0].startswith("abc") and values[1].startswith("bcd") and values[26] == values[0] and {len(v) for v in values} == {100}


def test_replay_of_whole_log():
    batch = wal.encode_batch([(b"a", 6, 0, b"1"), (b"b", 7, 1, b"")])
    found = wal.replay(RECORD + batch)
    assert [r[:3] for r in found.rows] == [(b"key", 5, 0), (b"a", 6, 0), (b"b", 7, 1)]
    assert not found.truncated and found.max_sequence == 7
    assert wal.read_strict(RECORD + batch) == found.rows


@pytest.mark.parametrize("cut", range(1, 80))
def test_half_a_batch_is_invisible(cut):
    batch = wal.encode_batch([(b"order:1", 100, 0, b"o"), (b"stock:1", 101, 0, b"s")])
    cut = min(cut, len(batch) - 1)
    found = wal.replay(RECORD + batch[:cut])
    assert [r[1] for r in found.rows] == [5] and found.truncated and found.good_bytes == len(RECORD)


def test_torn_logs():
    assert wal.replay(b"").rows == [] and not wal.replay(b"").truncated
    assert wal.replay(bytes.fromhex("aabbcc")).truncated
    assert wal.read_strict(bytes.fromhex("aabbcc")) == []
    short_key = struct.pack("<II", 0, 4) + b"ke"
    assert wal.replay(short_key).truncated
    with pytest.raises(Corruption):
        wal.read_strict(short_key)
    assert wal.replay(RECORD + bytes(64)).rows == [(b"key", 5, 0, b"value")]
    flipped = bytearray(RECORD)
    flipped[-1] ^= 1
    assert wal.replay(bytes(flipped)).rows == []


def test_bad_kinds_and_batches():
    with pytest.raises(Corruption):
        wal.replay(struct.pack("<II", 0, 8) + bytes.fromhex("6b65795f74657374"))
    with pytest.raises(Corruption):
        wal.replay(wal.encode_record(b"k", 1, 2, wal.BATCH_MAGIC + struct.pack("<I", 1)))
    with pytest.raises(Corruption):
        wal.replay(wal.encode_record(b"", 1, 2, wal.BATCH_MAGIC + struct.pack("<I", 0)))
    with pytest.raises(Corruption):
        wal.encode_batch([(b"a", 1, 0, b""), (b"b", 3, 0, b"")])
    gap = wal.encode_record(b"", 1, 2, wal.BATCH_MAGIC + struct.pack("<I", 2)) + wal.encode_record(b"a", 2, 0, b"")
    assert wal.replay(gap).truncated and wal.replay(gap).good_bytes == 0


def test_log_files_through_spark(spark, tmp_path):
    (tmp_path / "000001.wal").write_bytes(RECORD)
    (tmp_path / "000002.wal").write_bytes(wal.encode_batch([(b"a", 6, 1, b"")]))
    rows = wal.read_wal(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(bytes(r["key"]), r["seq"], r["kind"], r["value"] and bytes(r["value"])) for r in rows] == [(b"key", 5, 0, b"value"), (b"a", 6, 1, None)]


def _file(level, number, low, high, size=100):
    return File(level, number, f"f{number}", size, low, high, 1, 2)


def test_pick_seeds_and_expands():
    options = Options(level1_target=100, l0_compaction_trigger=4)
    assert compaction.pick([_file(0, 1, b"a", b"z")], options) is None
    files = [_file(1, 1, b"a", b"c", 80), _file(1, 2, b"d", b"f", 80), _file(2, 3, b"e", b"k"), _file(2, 4, b"x", b"z")]
    plan = compaction.pick(files, options, {1: b"c"})
    assert (plan.source, plan.target, [f.file_id for f in plan.inputs], [f.file_id for f in plan.target_inputs]) == (1, 2, [2], [3])
    assert compaction.pick(files[:2], options).trivial_move
    many = [_file(0, i, b"a", b"b") for i in range(5)]
    assert len(compaction.pick(many, options).inputs) == 5


def test_subcompaction_ranges_of_few_files(spark):
    rows = [(b"f",), (b"m",), (b"m",), (b"z",)]
    files = spark.createDataFrame([(bytearray(r[0]),) for r in rows], "largest_key binary")
    found = [(r["start_key"] and bytes(r["start_key"]), r["end_key"] and bytes(r["end_key"])) for r in compaction.subcompaction_ranges(files, 3).orderBy("part").collect()]
    assert found == [(None, b"f"), (b"f", b"m"), (b"m", None)]
    assert compaction.subcompaction_ranges(files, 1).count() == 1


def test_metrics_of_no_requests(spark):
    none = spark.createDataFrame([], "ts timestamp, method string, success boolean, latency_us long")
    assert [r["seconds"] for r in metrics.quantiles(none).collect()] == [0.0, 0.0]
    assert metrics.error_rate(none).first()["error_rate"] == 0.0
    assert 'rpc_method_requests_total{method="compare_and_set"} 0' in metrics.render(none)


def test_quantile_beyond_the_last_bound(spark):
    slow = spark.range(10).selectExpr("timestamp_seconds(id) as ts", "'get' as method", "true as success", "20000000L as latency_us")
    assert {r["seconds"] for r in metrics.quantiles(slow).collect()} == {10.0}
