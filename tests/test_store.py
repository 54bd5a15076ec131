import threading
import time

import pytest

from seqlake.errors import Conflict, Corruption, InvalidArgument, NotFound, Unavailable
from seqlake.model import Options, ScanOptions
from seqlake.operators import compaction
from seqlake.plans.store import Service, Store, delete, put


@pytest.fixture
def base(tmp_path):
    return f"file://{tmp_path}/store"


def test_writes_survive_flush_compaction_and_reopening(spark, base):
    options = Options(l0_compaction_trigger=1)
    store = Store(spark, base, options)
    store.put(b"k1", b"v1")
    first = store.create_snapshot()
    store.flush()
    store.commit_batch([put(b"k1", b"v2"), put(b"k2", b""), put(b"k3", b"x"), delete(b"k3")])
    second = store.create_snapshot()
    store.flush()
    store.put(b"bin\0key", bytes(range(256)))
    expected = [(b"bin\0key", bytes(range(256))), (b"k1", b"v2"), (b"k2", b"")]
    assert store.scan() == expected
    assert store.get(b"k1", first) == b"v1"
    assert store.get(b"k2", second) == b"" and store.get(b"k3") is None
    assert store.compact() >= 1
    assert store.scan() == expected and store.get(b"k1", first) == b"v1"
    again = Store(spark, base, options)
    assert again.scan() == expected
    assert again.last_seq == store.last_seq
    with pytest.raises(NotFound):
        again.get(b"k1", first)


def test_snapshot_ids(spark, base):
    store = Store(spark, base)
    assert (store.create_snapshot(), store.create_snapshot()) == (1, 2)
    store.release_snapshot(1)
    with pytest.raises(NotFound):
        store.release_snapshot(1)
    with pytest.raises(NotFound):
        store.release_snapshot(0)
    with pytest.raises(NotFound):
        store.scan(snapshot=1)


def test_compare_and_set(spark, base):
    store = Store(spark, base)
    store.compare_and_set(b"k", None, b"1")
    store.compare_and_set(b"k", b"1", b"2")
    before = store.last_seq
    for expected in (b"1", None):
        with pytest.raises(Conflict):
            store.compare_and_set(b"k", expected, b"3")
    assert store.last_seq == before
    store.compare_and_set(b"k", b"2", None)
    assert store.get(b"k") is None


def test_transactions(spark, base):
    store = Store(spark, base)
    store.put_batch([(b"t:a", b"va"), (b"t:b", b"vb")])

    def commits(t):
        t.delete(b"t:a")
        t.put(b"t:c", b"vc")
        assert t.get(b"t:a") is None and store.get(b"t:a") == b"va"
        assert [k for k, _ in t.scan(ScanOptions(prefix=b"t:"))] == [b"t:b", b"t:c"]
        assert t.scan(ScanOptions(reverse=True, limit=1)) == [(b"t:c", b"vc")]
        with pytest.raises(Conflict):
            t.compare_and_set(b"t:c", b"no", b"x")
        with pytest.raises(Conflict):
            store.put(b"x", b"y")
        t.commit()
        for call in (lambda: t.put(b"x", b""), lambda: t.delete(b"x"), lambda: t.compare_and_set(b"x", None, b""), t.rollback, t.commit):
            with pytest.raises(Conflict):
                call()
        return t.get(b"t:c")

    assert store.with_transaction(commits) == b"vc"
    assert [k for k, _ in store.scan()] == [b"t:b", b"t:c"]
    store.with_transaction(lambda t: t.put(b"lost", b""))

    def fails(t):
        t.put(b"lost", b"")
        t.rollback()
        t.rollback()
        t.put(b"lost", b"")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        store.with_transaction(fails)
    assert store.get(b"lost") is None


def test_shutdown(spark, base):
    store = Store(spark, base)
    store.put(b"k", b"v")
    store.shutdown()
    store.shutdown()
    assert store.get(b"k") == b"v" and not store.healthy()
    with pytest.raises(Unavailable):
        store.put(b"k", b"w")


def test_write_stop(spark, base):
    store = Store(spark, base, Options(l0_slowdown_files=1, l0_stop_files=1))
    store.put(b"k", b"v")
    store.flush()
    store.flush()  # nothing to flush
    assert store.pressure()["reason"] == "l0_stop_trigger"
    with pytest.raises(Unavailable):
        store.put(b"k", b"w")


def test_damaged_and_missing_files(spark, base):
    store = Store(spark, base)
    store.put(b"k", b"v")
    store.flush()
    store.put(b"l", b"w")
    folder = f"{base}/meta/MANIFEST-1"
    store.fs.write(f"{folder}/{store.edits:08d}.json", b'{"format_version": 1, "ad')
    store.fs.write(f"{base}/data/999999.parquet", b"orphan")
    again = Store(spark, base)
    assert again.scan() == [(b"k", b"v"), (b"l", b"w")]
    assert "999999.parquet" not in again.fs.names(f"{base}/data")
    store.fs.write(f"{folder}/{store.edits:08d}.json", b'{"format_version": 99}')
    with pytest.raises(Corruption):
        Store(spark, base)
    store.fs.delete(f"{folder}/{store.edits:08d}.json")
    store.fs.delete(store.files[0].path)
    with pytest.raises(NotFound):
        Store(spark, base)


def test_torn_log_loses_only_its_batch(spark, base):
    store = Store(spark, base)
    store.put(b"a", b"1")
    store.commit_batch([put(b"b", b"2"), put(b"c", b"3")])
    path = f"{base}/wal/000002.wal"
    store.fs.write(path, store.fs.read(path)[:-3])
    assert Store(spark, base).scan() == [(b"a", b"1")]


def test_manifest_is_rewritten(spark, base):
    store = Store(spark, base, Options(manifest_max_edits=2))
    for i in range(4):
        store.put(b"k%d" % i, b"v")
        store.flush()
    assert store.manifest > 1
    assert [k for k, _ in Store(spark, base).scan()] == [b"k0", b"k1", b"k2", b"k3"]


def test_service_checks_requests(spark, base):
    service = Service(Store(spark, base))
    for call in (lambda: service.get(b""), lambda: service.write(b"", b""), lambda: service.multi_get([]), lambda: service.multi_get([b"k"], 1), lambda: service.multi_get([b""])):
        with pytest.raises(InvalidArgument):
            call()
    service.write(b"k", b"v")
    service.delete(b"missing")
    assert service.get(b"k")["value"] == b"v" and not service.get(b"no")["found"]
    assert [r["key"] for r in service.scan(limit=0)] == [b"k"]
    service.compare_and_set(b"k", True, b"v", b"ignored", delete_on_match=True)
    assert not service.get(b"k")["found"]
    number = service.create_snapshot()["snapshot_id"]
    service.release_snapshot(number)


def test_compaction_cuts_its_output_and_writes_it_in_one_job(spark, base):
    store = Store(spark, base, Options(l0_compaction_trigger=1, max_subcompactions=3))
    for turn in range(3):
        store.put_batch([(b"%02d%03d" % (turn, i), b"v" * 20) for i in range(50)])
        store.flush()
    store.put_batch([(b"00000", b"new"), (b"02049", b"new")])
    store.flush()
    before = store.scan()
    assert store.compact() >= 1
    level = sorted((f for f in store.files if f.level == max(f.level for f in store.files)), key=lambda f: f.smallest_key)
    assert len(level) == 3 and all(a.largest_key < b.smallest_key for a, b in zip(level, level[1:], strict=False))
    assert store.scan() == before and Store(spark, base, store.options).scan() == before
    assert not [n for n in store.fs.names(f"{base}/data") if n.endswith(".tmp")]


def test_output_is_cut_where_it_would_meet_too_much_below():
    file = lambda n, low, high, size: compaction.File(1, n, "", size, low, high, 1, 1)
    inputs = [file(1, b"a", b"m", 50), file(2, b"n", b"z", 50)]
    below = [file(3 + i, b"%c0" % (97 + i), b"%c9" % (97 + i), 40) for i in range(20)]
    assert compaction.output_cuts(inputs, [], 1, 100) == []
    assert compaction.output_cuts(inputs, [], 2, 100) == [b"n"]
    cuts = compaction.output_cuts(inputs, below, 1, 100)
    for low, high in zip([b"", *cuts], [*cuts, b"~"], strict=True):
        assert sum(f.file_size for f in below if low <= f.smallest_key < high) <= 100
    assert compaction.output_cuts(inputs, below, 1, 10**9) == []
    large = [file(9, b"c", b"d", 500), file(10, b"e", b"f", 500)]
    assert compaction.output_cuts(inputs, large, 1, 100) == [b"e"]


def test_writers_that_wait_share_a_log(spark, base):
    store = Store(spark, base)
    threads = [threading.Thread(target=store.put, args=(b"k%02d" % i, b"v")) for i in range(20)]
    with store.lock:
        for t in threads:
            t.start()
        deadline = time.time() + 20
        while len(store.queue) < 20 and time.time() < deadline:
            time.sleep(0.01)
    for t in threads:
        t.join()
    assert len(store.scan()) == 20 and store.last_seq == 20
    assert len(store.fs.names(f"{base}/wal")) == 1
    assert Store(spark, base).scan() == store.scan()


def test_queue_limits_hold_writers_back(spark, base):
    store = Store(spark, base, Options(queue_max_requests=2, group_max_ops=2))
    threads = [threading.Thread(target=store.put, args=(b"k%d" % i, b"v" * 100)) for i in range(6)]
    with store.lock:
        for t in threads:
            t.start()
        time.sleep(0.5)
        assert len(store.queue) == 2
    for t in threads:
        t.join(30)
    assert len(store.scan()) == 6 and len(store.fs.names(f"{base}/wal")) >= 3
    tight = Store(spark, base + "2", Options(queue_max_bytes=10))
    tight.put(b"large", b"v" * 1000)  # larger than the queue, but alone
    assert tight.get(b"large") == b"v" * 1000


def test_a_group_that_fails_tells_every_writer(spark, base):
    store = Store(spark, base)
    store.flush_failures = store.options.flush_failure_limit
    with pytest.raises(Unavailable):
        store.put(b"k", b"v")
    assert store.queue == [] and store.ready() == {"ready": False, "reason": "flushes keep failing"}
    store.flush_failures = 0
    store.put(b"k", b"v")
    assert store.ready()["ready"] and store.live() == {"status": "alive"}


def test_backlog_of_unflushed_batches(spark, base):
    store = Store(spark, base, Options(max_unflushed_batches=2))
    store.put(b"a", b"1")
    store.put(b"b", b"2")
    with pytest.raises(Unavailable, match="wait for a flush"):
        store.put(b"c", b"3")
    again = Store(spark, base, store.options)
    with pytest.raises(Unavailable):
        again.put(b"c", b"3")
    again.flush()
    again.put(b"c", b"3")
    assert [k for k, _ in again.scan()] == [b"a", b"b", b"c"]


def test_pressure_on_the_driver_is_that_of_the_operator(spark, base):
    store = Store(spark, base, Options(l0_slowdown_files=1, l0_stop_files=9, pending_soft_bytes=1, l0_compaction_trigger=1))
    for i in range(2):
        store.put(b"k%d" % i, b"v")
        store.flush()
        mine = store.pressure()
        row = compaction.write_pressure(store.files_frame(), store.options).first()
        assert (row["l0_files"], row["pending_bytes"], row["pressure"], row["reason"]) == (mine["l0_files"], mine["pending_compaction_bytes"], mine["pressure"], mine["reason"])
    assert store.pressure()["reason"] == "l0_and_pending_compaction_slowdown"


def test_snapshot_counts(spark, base):
    store = Store(spark, base)
    store.create_snapshot()
    store.put(b"k", b"v")
    first, _ = store.create_snapshot(), store.create_snapshot()
    assert store.snapshot_counts() == [(0, 1), (1, 2)]
    store.release_snapshot(first)
    assert store.snapshot_counts() == [(0, 1), (1, 1)]


def test_a_file_is_replaced_in_one_step(spark, base):
    store = Store(spark, base)
    path = f"{base}/meta/CURRENT"
    store.fs.write(path, b"one")
    store.fs.write(path, b"two")
    assert store.fs.read(path) == b"two"
    # A crash before the rename leaves the old content and a temporary file.
    part = f"{path}.x.tmp"
    store.fs.write(part, b"three")
    assert store.fs.read(path) == b"two"
