import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.llm import mixing

from .edge import docs, empty


def compact(spark, rows):
    return spark.createDataFrame([(int(t), [float(x) for x in p]) for t, p in rows], "tokens long, posterior array<double>")


def test_rates_reach_the_targets_as_plain_descent_does(spark):
    rng = np.random.RandomState(0)
    p = rng.dirichlet((0.3, 0.3, 0.3), 400)
    t = rng.randint(1, 500, 400)
    targets = [30_000.0, 20_000.0, 1_000.0]
    df = compact(spark, zip(t, p, strict=True))
    fitted = mixing.fit_rates(df, targets)
    rows = df.withColumn("rate", mixing._rates("posterior", fitted.steps)["rate"]).collect()
    rate = np.array([r["rate"] for r in rows])
    assert (rate >= 0).all()
    assert np.abs((t * rate) @ p - targets).sum() <= 2 * mixing.TOLERANCE * sum(targets)
    assert (t * rate) @ p == pytest.approx(fitted.totals)
    plain = before = np.ones(400)
    for on, *step in fitted.steps:
        ahead = plain + on * (plain - before)
        assert step == pytest.approx(((t * ahead) @ p - targets) / (t @ p))
        plain, before = np.maximum(0, ahead - p @ step), plain
    assert rate == pytest.approx(plain)


@pytest.mark.parametrize("floor", [1.0])
def test_unreachable_targets_settle_where_a_solver_does(spark, floor):
    rng = np.random.RandomState(1)
    p = rng.dirichlet((6, 1, 1), 60)
    t = rng.randint(1, 500, 60)
    targets = [20_000.0, 10.0, 10.0]
    fitted = mixing.fit_rates(compact(spark, zip(t, p, strict=True)), targets, held=0, floor=floor)
    low = np.where(p[:, 0] >= p.max(axis=1), floor, 0.0)
    moments, plain = t @ p, np.ones(60)
    for _ in range(20_000):
        plain = np.maximum(low, plain - p @ (((t * plain) @ p - targets) / moments))
    best = ((((t * plain) @ p - targets) ** 2) / moments).sum()
    got = ((np.array(fitted.totals) - targets) ** 2 / moments).sum()
    assert best * 0.999 <= got <= best * 1.2 + 1
    assert fitted.residual == pytest.approx(np.abs(np.array(fitted.totals) - targets).sum() / sum(targets))


def test_softmax_against_plain_descent():
    rng = np.random.RandomState(2)
    found = np.hstack([(rng.rand(80, 5) < 0.4).astype(float), np.ones((80, 1))])
    of = rng.randint(0, 3, 80)
    stands = rng.rand(80) + 0.5
    got = mixing._softmax(found, of, stands, 3)
    slow = np.zeros((6, 3))
    prior = np.array([1, 1, 1, 1, 1, 0.0])[:, None]
    for _ in range(4000):
        e = np.exp(found @ slow)
        likely = e / e.sum(axis=1, keepdims=True)
        slow -= 0.01 * (found.T @ ((likely - np.eye(3)[of]) * stands[:, None]) + prior * slow)
    a, b = (np.exp(found @ w) for w in (got, slow))
    assert a / a.sum(axis=1, keepdims=True) == pytest.approx(b / b.sum(axis=1, keepdims=True), abs=1e-3)


def features_of(text):
    words = [w for w in re.split(r"[\s.,;:!?()\"']+", text.lower()) if w]
    marks = {"#mark " + m for m in re.split(r"[^\W]+|\s+", re.sub(r"[\w\s]+", " ", text)) if m}
    again = min(12, math.floor(2 * math.log2(max(1, len(words)) / max(1, len(set(words))))))
    return len(words), set(words) | marks | {f"#again {again}"}


def test_posteriors_rates_and_copies_against_brute_force(spark):
    """Posteriors, rates and copies of 200 documents, recomputed in plain Python from the model."""
    from seqlake.llm.queries import TARGET_WEIGHTS, label_domains

    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = label_domains(spark, documents, sf)
    rows = mixing.mix(documents, model, TARGET_WEIGHTS).collect()
    assert len(rows) == documents.count() and len({r["residual"] for r in rows}) == 1
    texts = {r["doc_id"]: r["text"] for r in rows}
    p, t = [], []
    for r in rows:
        tokens, found = features_of(r["text"] or "")
        scores = np.array(model.base)
        for j, feature in enumerate(model.features):
            if feature in found:
                scores = scores + np.array([w[j] for w in model.weights])
        likely = np.exp(scores - scores.max())
        assert r["tokens"] == tokens
        assert r["posterior"] == pytest.approx((likely / likely.sum()).round(4), abs=2e-4)
        p.append(r["posterior"])
        t.append(tokens)
    p, t, rate = np.array(p), np.array(t, float), np.array([r["rate"] for r in rows])
    total = (t @ p)[model.names.index("good")] / TARGET_WEIGHTS["good"]
    targets = np.array([total * TARGET_WEIGHTS[n] for n in model.names])
    assert rows[0]["residual"] == pytest.approx(np.abs((t * rate) @ p - targets).sum() / targets.sum(), abs=1e-6)
    assert all(r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) for r in rows)
    assert len(texts) == len(rows)


def test_callers_columns_stay(spark):
    clashing = spark.createDataFrame([(1, "a b", "x", "y", "z")], "doc_id long, text string, tokens string, rate string, copies string")
    model = mixing.learn_domains(empty(spark).withColumn("domain", F.lit("a")))
    [row] = mixing.mix(clashing, model, {"a": 1.0}).collect()
    assert row[:5] == (1, "a b", "x", "y", "z") and row.__fields__[5:] == ["_tokens", "posterior", "residual", "_rate", "_copies"]


def test_classifier_and_rounding(spark):
    rows = [(i, f"plain text number{i} here", "good") for i in range(200)] + [(1000 + i, f"awful nasty text number{i}", "bad") for i in range(60)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    model = mixing.learn_domains(labelled)
    assert model.names == ["bad", "good"] and {"awful", "nasty"} <= set(model.features)
    mixed = mixing.mix(labelled.drop("domain"), model, {"good": 0.99, "bad": 0.01}, rounding="nearest")
    assert mixed.where("doc_id < 1000 and copies = 1").count() == 200
    assert mixed.where("doc_id >= 1000 and copies = 0").count() == 60
    drawn = mixing.mix(labelled.drop("domain"), model, {"good": 0.5, "bad": 0.5}, total=2600.0)
    expected, got = drawn.agg(F.sum(F.col("rate")), F.sum("copies")).first()
    assert got == pytest.approx(expected, rel=0.15)


def test_edge_rows(spark):
    labelled = docs(spark).withColumn("domain", F.when(F.col("doc_id") < 6, "a").when(F.col("doc_id") < 9, "b"))
    model = mixing.learn_domains(labelled)
    mixed = mixing.mix(docs(spark), model, {"a": 0.5, "b": 0.5})
    tokens, _, _, rate, copies = mixed.columns[-5:]
    assert [str(r) for r in mixed.select(*docs(spark).columns).orderBy("doc_id", "text").collect()] == [str(r) for r in docs(spark).orderBy("doc_id", "text").collect()]
    assert mixed.where(f"{rate} < 0 or {rate} is null or {copies} is null").count() == 0
    assert mixed.where(f"text is null and {tokens} <> 0").count() == 0


def test_no_labels_and_no_rows(spark):
    model = mixing.learn_domains(empty(spark).withColumn("domain", F.lit("a")))
    assert {r[-1] for r in mixing.mix(docs(spark), model, {"a": 1.0}).collect()} == {1}
    assert mixing.mix(empty(spark), model, {"a": 1.0}).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_low_and_toxic_documents_are_recognised(spark, sf):
    from seqlake.llm.queries import label_domains

    documents = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    model = label_domains(spark, documents, f"/root/testdata/{sf}")
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good")
    rows = mixing.with_posteriors(documents.join(labels, "doc_id"), model, "text", "tokens", "posterior")
    good = F.avg((F.col("posterior")[model.names.index("good")] > 0.5).cast("int"))
    taken_for_good = dict(rows.groupBy(kind).agg(good).collect())
    assert taken_for_good["good"] > 0.95 and taken_for_good["low"] < 0.3
    assert taken_for_good["toxic"] < (0.6 if sf == "sf0.001" else 0.3)


def test_held_out_accuracy(spark):
    """Learned from the even half of the labelled rows, tried on the odd half."""
    sf = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good").alias("domain")
    labelled = documents.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", kind), "doc_id")
    model = mixing.learn_domains(labelled.where("doc_id % 2 = 0"))
    rows = mixing.with_posteriors(labelled.where("doc_id % 2 = 1"), model, "text", "tokens", "posterior")
    named = F.array(*[F.lit(n) for n in model.names])
    best = F.element_at(named, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    right = dict(rows.groupBy("domain").agg(F.avg((best == F.col("domain")).cast("int"))).collect())
    assert right["good"] > 0.98 and right["low"] > 0.85 and right["toxic"] > 0.6


def test_a_mark_that_two_domains_share_tells_them_from_the_third(spark):
    rows = [(i, f"plain text number{i}", "good") for i in range(300)] + [(1000 + i, f"plain | text number{i}", "low") for i in range(40)]
    rows += [(2000 + i, f"plain {'|' if i < 20 else ''} awful text number{i}", "toxic") for i in range(40)]
    model = mixing.learn_domains(spark.createDataFrame(rows, "doc_id long, text string, domain string"))
    assert "#mark |" in model.features and "awful" in model.features
