import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from seqlake.llm import pii

from .edge import CLASHING, docs, empty

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fails = (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits))) or (kind == "phone" and not 8 <= len(digits) <= 15)
            if not fails:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    "a@b.c%x@d.e a@b.c.d. .@-.- a@b a@b. x%+y@z-.q", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111",
    "+1 (988) 555-2485 +12345678 +1(2 +1.) +49 30 123456-- ++1 234 5678", "é😀 4111111111111111 😀 a@b.co", "", None, "1 " * 20_000, "a@b.cc " * 2000, "x" * 100_000, "1." * 20_000, "+1" + " " * 20_000,
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return TEXTS + ["".join(rng.choice("a1@.+- ()%9é\n4") for _ in range(rng.randint(0, 50))) for _ in range(1500)]


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), sample=2000)


def test_base_spans_against_brute_force(spark, texts, model):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find_spans(df, model).select("doc_id", pii.span_text(F.col("base_spans")).alias("base"), pii.span_text(F.col("spans")).alias("every")).collect()
    for row in found:
        assert row["base"] == ",".join(base(texts[row["doc_id"]]))
        assert set(filter(None, row["base"].split(","))) <= set(row["every"].split(","))


def test_added_spans_are_secrets_and_clean_texts_have_none(spark, model):
    assert model.trees and set(model.thresholds) == set(pii.KINDS)
    rows = [(1, 'Then token = "1beb58b8af68854f0e01b5a0f2b7c8d9e0f1a2b3" was there'), (2, "Nothing but 12 plain words of 2024 here"), (3, "Antidisestablishmentarianism and co-operation-of-all-people in 1999")]
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [s["kind"] for s in found[0]["spans"]] == ["secret"]
    assert found[1]["spans"] == [] and found[2]["spans"] == []


def test_planted_cases_of_other_documents(spark, model):
    """Of cases planted into documents that the trees didn't learn from, nearly all are told apart."""
    cases = pii.planted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), sample=2000).where("part = 1")
    hit = F.expr("exists(spans, x -> x.kind = kind and x.start < `end` and x.end > `start`)").cast("int")
    found = {(r["kind"], r["label"]): r["hit"] for r in pii.find_spans(cases, model).groupBy("kind", "label").agg(F.avg(hit).alias("hit")).collect()}
    assert {k for k, _ in found} == set(pii.KINDS)
    assert all(share > 0.9 if label else share < 0.15 for (_, label), share in found.items()), found


def test_scores_against_plain_trees(spark, model):
    text = 'call (017) 555-7713 or ann (at) mail (dot) org, token = "1beb58b8af68854f0e01b5a0f2b7c8d9e0f1a2b3", 2001:db8:0:1::7, 978-3-1614-8410-0 and co-operation-of-all-people'
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    names = {k: f"l_{k}" for k in pii.LOOSE}
    row = pii._searched(df, "text", {}, names).select(*[pii._candidates(n, k).alias(n) for k, n in names.items()]).first()
    expected = []
    for kind, name in names.items():
        for c in row[name]:
            score = model.bias
            for (root, cut), low, high in model.trees:
                g, at_most, value, otherwise = low if c[f"f{root}"] <= cut else high
                score += value if c[f"f{g}"] <= at_most else otherwise
            expected += [(kind, c["start"], c["end"])] if score >= model.thresholds[kind] else []
    base_spans = {tuple(s) for s in pii.find_spans(df, pii.Trees()).first()["base_spans"]}
    spans = [tuple(s) for s in pii.find_spans(df, model).first()["spans"]]
    assert sorted(set(expected) | base_spans) == sorted(spans)
    assert {k for k, *_ in expected} >= {"phone", "email", "secret", "ip"}


def test_long_text(spark, model):
    text = "plain words go on " * 1_150_000 + "a@b.co " + "1." * 50_000
    [row] = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [tuple(s) for s in row["base_spans"]] == [("email", 20_700_000, 20_700_006)]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail é a@b.co or +1 (988) 555-2485 now"), (2, None)], "doc_id long, text string")
    done = pii.redact(pii.find_spans(df, pii.Trees())).orderBy("doc_id").collect()
    assert done[0]["redacted"] == "mail é [EMAIL] or [PHONE] now" and done[1]["redacted"] == ""


def test_edge_rows(spark, model):
    found = pii.find_spans(docs(spark), model)
    assert found.count() == docs(spark).count() and found.columns[-2:] == ["base_spans", "_spans"]
    assert all(r[c] == "x" for r in found.collect() for c in CLASHING)
    assert pii.find_spans(empty(spark), pii.fit(empty(spark))).count() == 0
    assert pii.fit(empty(spark)).thresholds == {}


def test_digest_of_no_spans(spark):
    row = pii.find_spans(empty(spark).union(spark.createDataFrame([(1, "x", "en", "s")])), pii.Trees()).select(F.sha2(pii.span_text(F.col("base_spans")), 256)).first()
    assert row[0] == hashlib.sha256(b"").hexdigest()
