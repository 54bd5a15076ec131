import pytest
from pyspark.sql import functions as F

from seqlake.llm.urls import domain_of, host_reputation, judge_urls, suffix_of

PAGES = [
    (1, "http://A.example.NET/en/1?x=1#y"), (2, "https://example.net"), (3, "https://notexample.net/en/"), (4, None), (5, "no scheme"), (6, ""),
    (7, "http://b.example.com/de/1"), (8, "http://b.example.com/dé"), (9, "http://x.org/fr/"), (10, "http://x.org#/fr/"), (11, "ftp://É.org?q=/a://b"), (12, "http://bad.example.org/x"), (12, "http://bad.example.org/x"),
]


@pytest.fixture(scope="module")
def reputation(spark):
    rows = [("bad.example.org", 1)] * 40 + [("good.example.org", 0)] * 400 + [("bad.example.org", None), (None, 1)]
    return host_reputation(spark.createDataFrame(rows, "host string, bad int"))


def test_rules_and_hosts(spark, reputation):
    pages = spark.createDataFrame(PAGES, "page_id long, url string").withColumns({"host": F.lit("x"), "low": F.lit("x"), "id": F.lit("x")})
    found = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, reputation).collect()}
    assert found[1] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert found[2] == ("example.net", "", None, "allow")
    assert found[3] == ("notexample.net", "/en/", "net/", "block")
    assert found[4] == found[5] == found[6] == ("", "", None, "allow")
    assert found[7] == ("b.example.com", "/de/1", "example.com/de/", "block")
    assert found[8] == ("b.example.com", "/dé", None, "allow")
    assert found[9][2:] == ("org/fr/", "allow") and found[10] == ("x.org", "", None, "allow")
    assert found[11][0] == "É.org"
    assert found[12] == ("bad.example.org", "/x", None, "block")
    assert judge_urls(pages, reputation).count() == len(PAGES)


def test_shrinkage(spark, reputation):
    found = {r["host"]: r for r in reputation.collect()}
    bad, good = found["bad.example.org"], found["good.example.org"]
    assert (bad["n"], bad["bad"], good["n"]) == (40, 40, 400)
    assert 40 / 440 < bad["mean"] < 1 and bad["low"] < bad["mean"] and good["mean"] < 0.1
    few = host_reputation(spark.createDataFrame([("new.example.org", 1)] + [("other.example.org", 0)] * 500 + [("third.example.org", 0)] * 500, "host string, bad int"))
    assert {r["host"]: r["low"] for r in few.collect()}["new.example.org"] < 0.5


def test_no_labels_and_no_pages(spark):
    none = host_reputation(spark.createDataFrame([], "host string, bad int"))
    pages = spark.createDataFrame(PAGES, "page_id long, url string")
    assert none.count() == 0
    assert judge_urls(pages, none).count() == len(PAGES)
    assert judge_urls(pages.limit(0), none).count() == 0


def test_registered_domains(spark):
    rows = ["a.b.co.uk", "co.uk", "b.co.uk", "x.y.example.com:8080", "user@x.example.com", "10.0.0.1:80", "[2001:db8::1]:443", "localhost", ""]
    df = spark.createDataFrame([(h,) for h in rows], "host string").select("host", domain_of(F.col("host")).alias("d"), suffix_of(F.col("host")).alias("s"))
    assert {r["host"]: (r["d"], r["s"]) for r in df.collect()} == {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"),
        "x.y.example.com:8080": ("example.com", "com"), "user@x.example.com": ("example.com", "com"),
        "10.0.0.1:80": ("10.0.0.1", "#address"), "[2001:db8::1]:443": ("[2001:db8::1]", "#address"), "localhost": ("localhost", "localhost"), "": ("", ""),
    }


def test_a_hot_site_tells_nothing_of_another_under_the_same_suffix(spark):
    rows = [("a.bad.co.uk", 1)] * 500 + [("b.bad.co.uk", 1)] * 500 + [(f"h{i}.co.uk", 0) for i in range(300)] + [("new.other.co.uk", 0)]
    found = {r["host"]: r["mean"] for r in host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    apart = {r["host"]: r["mean"] for r in host_reputation(spark.createDataFrame(rows, "host string, bad int"), suffixes=()).collect()}
    assert found["a.bad.co.uk"] > 0.9 and found["new.other.co.uk"] < apart["new.other.co.uk"]
