import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqlake.llm import warc

BIG = "<html>é\r\n\r\nWARC/1.0\r\n" + "x" * 1200
PAGES = [
    (1, "http://b.com/1", BIG), (5, "http://a.com/\r\nx: y", BIG), (5, "http://a.com/2", BIG), (3, None, BIG), (2, "http://a.com/b?c#d", "small"), (4, "", "small"),
    (6, "http://c.com", None), (7, "http://c.com", ""), (None, "http://d.com", BIG), (None, None, None), (8, "http://e.com", "y" * 2_000_000),
]


def key(c):
    return c[0], c[1], c[2] is not None, c[2] or 0, c[8], c[9]


captures = st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["1", "2"]), st.one_of(st.none(), st.integers(0, 3)), st.just(""), st.just(""), st.none(), st.just(0), st.just(""), st.sampled_from(["f", "g"]), st.integers(0, 9))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(captures, max_size=6), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r, key=key) for r in runs]
    merged = list(warc.LoserTree(runs))
    assert list(map(key, merged)) == sorted(key(c) for r in runs for c in r)


@pytest.mark.parametrize("ranges", [1, 4])
def test_round_trip(spark, monkeypatch, ranges):
    monkeypatch.setattr(warc, "RANGE_CAPTURES", len(PAGES) // ranges)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    rows = warc.archive_pages(pages).orderBy("range", "position").collect()
    assert [(r["url_key"], r["captured"]) for r in rows] == sorted((r["url_key"], r["captured"]) for r in rows)
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    assert sorted((str(r["id"]), r["payload_digest"], r["payload_bytes"]) for r in rows) == sorted((str(i), digest(t), len((t or "").encode())) for i, _, t in PAGES)
    kinds = sorted((str(r["id"]), r["record_type"], r["refers_to"]) for r in rows if r["payload_digest"] == digest(BIG))
    assert kinds == [("1", "revisit", 5), ("3", "revisit", 5), ("5", "response", None), ("5", "response", None), ("None", "revisit", 5)]
    assert {r["record_type"] for r in rows if r["payload_bytes"] < 1000} == {"response"}


def test_records_are_found_by_their_offsets(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for row in warc.archive_pages(pages, path).collect():
        with open(row["archive"].removeprefix("file:"), "rb") as f:
            f.seek(row["offset"])
            record = f.read(row["length"])
        assert record.startswith(b"WARC/1.0\r\n") and record.endswith(b"\r\n\r\n")
        assert next(warc.parse_archive(record))[2] == row["id"]


def test_damage_is_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/archives"
    warc.write_archives(spark.createDataFrame([(1, "http://a.com", "payload")], "page_id long, url string, html string"), path)
    data = next(p.read_bytes() for p in (tmp_path / "archives").glob("part-*"))
    with pytest.raises(ValueError):
        list(warc.parse_archive(data.replace(b"payload", b"pay1oad")))
    with pytest.raises(ValueError):
        list(warc.parse_archive(b"x" + data))


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_keys():
    assert warc.url_key("https://Www.Example.com/A?b=C#d") == "com,example,www)/A?b=C"
    assert warc.url_key("http://a.b") == "b,a)/" and warc.url_key("") == ")/"
