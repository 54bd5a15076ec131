import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seqlake.llm import quality

from .edge import CLASHING, docs, empty

TRUSTED = ["the cat sat on the mat and the dog sat on the log", "a cat and a dog sat there", "the end", "café au lait et thé", "on and on and on the cat went"] * 2


def reference(texts):
    """Interpolated modified Kneser-Ney over bytes, written plainly."""
    grams = {5: Counter()}
    for text in texts:
        data = b"\xff" * 4 + text.encode()
        for i in range(4, len(data)):
            grams[5][data[i - 4 : i + 1]] += 1
    for k in (4, 3, 2, 1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    discounts = {}
    for k in grams:
        n = [sum(v == i for v in grams[k].values()) for i in range(5)]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2] if n[3] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] and n[4] else 1.5)
            discounts[k] = [min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.95, 2.95), strict=True)]
        else:
            discounts[k] = [0.5, 0.75, 0.9]

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / 256
        after = {g: c for g, c in grams[k].items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return p(gram[1:])
        take = lambda c: discounts[k][min(c, 3) - 1]
        own = after[gram] - take(after[gram]) if gram in after else 0
        return own / total + sum(map(take, after.values())) / total * p(gram[1:])

    return p


@pytest.fixture(scope="module")
def model(spark):
    return quality.train(spark.createDataFrame([(t,) for t in TRUSTED], "text string"))


def losses(spark, model, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["id"]: (r["loss"], r["error"]) for r in quality.log_perplexity(df, model, **more).collect()}


TEXTS = ["the cat", "the dog and the cat sat on a mat", "zzz ZZZ", "x", "", None, "thé 日本" * 40]


def test_against_plain_model(spark, model):
    p = reference(TRUSTED)
    found = losses(spark, model, TEXTS)
    for i, text in enumerate(TEXTS):
        if not text:
            assert i not in found
            continue
        data = b"\xff" * 4 + text.encode()
        costs = [-math.log(p(data[j - 4 : j + 1])) for j in range(4, len(data))]
        assert found[i] == pytest.approx((np.mean(costs), np.std(costs) / math.sqrt(len(costs))), rel=1e-4, abs=1e-4)


def test_shards_change_nothing(spark, model):
    assert len(quality.shards(model, 20)) > 3
    one, many = losses(spark, model, TEXTS), losses(spark, model, TEXTS, entries=20)
    assert one.keys() == many.keys()
    for i in one:
        assert one[i] == pytest.approx(many[i], rel=1e-6)


def test_broadcast_models_are_gone_when_scored(spark, model, monkeypatch):
    kind, sent = type(spark.sparkContext), []
    real = kind.broadcast
    monkeypatch.setattr(kind, "broadcast", lambda self, value: sent.append(real(self, value)) or sent[-1])
    found = losses(spark, model, TEXTS, entries=60)
    assert len(sent) > 1 and not any(os.path.exists(shared._path) for shared in sent)
    assert set(found) == {i for i, t in enumerate(TEXTS) if t}


def test_probabilities_add_up():
    p = reference(TRUSTED)
    assert sum(p(b"he c" + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_table_of_collisions():
    keys = np.random.RandomState(1).permutation(10_000).astype(np.int64)[:5000]
    table = quality.Table(keys, keys.astype(np.float32))
    found, value = table.get(np.arange(10_000))
    assert set(np.flatnonzero(found)) == set(keys) and (value[keys] == keys).all()


def test_junk_goes_and_clean_text_stays(spark):
    sf = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.classify(documents, labels.where("quality = 1").select(F.col("doc_id").alias("id"))).join(labels, "doc_id")
    clean = found.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    junk = found.where("quality = 0 and text like '%!!%'").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert clean > 0.99 and junk < 0.05


def test_edge_rows(spark):
    trusted = spark.createDataFrame([(1,), (2,), (6,), (None,), (1,)], "id long")
    found = quality.classify(docs(spark), trusted)
    assert found.count() == docs(spark).count() and found.columns[-3:] == ["perplexity", "perplexity_limit", "_kept"]
    rows = found.collect()
    assert all(r[c] == "x" for r in rows for c in CLASHING)
    kept = {(r["doc_id"], r["text"]): r["_kept"] for r in rows}
    good = quality.keep_good(docs(spark), trusted)
    assert good.columns == docs(spark).columns
    assert sorted(str(tuple(r)) for r in good.collect()) == sorted(str(tuple(r[: len(good.columns)])) for r in rows if r["_kept"])
    assert kept[3, ""] is False and kept[4, None] is False and kept[1, "The quick brown fox jumps over the lazy dog"] is True
    nothing = quality.classify(docs(spark), trusted.limit(0))
    assert {r["_kept"] for r in nothing.where("length(text) > 0").collect()} == {True}
    assert quality.classify(empty(spark), trusted).count() == 0


def test_unseen_clean_text_stays_in_thin_languages_too(spark):
    sf = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").join(documents.select("doc_id", "lang"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id")))
    room = F.when(F.col("lang") == "es", 8).when(F.col("lang") == "fr", 20).when(F.col("lang") == "de", 16).otherwise(100)
    trusted = labels.where("quality = 1").withColumn("rank", rank).where(F.col("rank") <= room).select(F.col("doc_id").alias("id"))
    found = quality.classify(documents, trusted).join(trusted, F.col("doc_id") == F.col("id"), "left_anti").join(labels.drop("lang"), "doc_id")
    kept = F.avg(F.col("kept").cast("int"))
    clean = dict(found.where("quality = 1").groupBy("lang").agg(kept).collect())
    assert set(clean) == {"en", "de", "fr", "es"} and min(clean.values()) >= 0.95, clean
    assert found.where("quality = 0 and text like '%!!%'").agg(kept).first()[0] < 0.05


def test_limits_of_thin_languages_and_of_none(spark):
    rows = [("en", 1.0 + i / 1000) for i in range(100)] + [("es", 2.0), ("es", 2.01)]
    by_lang, loosest = quality.thresholds(spark.createDataFrame(rows, "lang string, loss double"))
    limits = dict(by_lang.collect())
    # Two documents alone would say 2.01.
    assert limits["es"] > 2.1 and loosest == limits["es"]
    texts = spark.createDataFrame([(i, "a cat and a dog sat there", "en") for i in range(40)] + [(99, "ÄÖÜ ÄÖÜ xq" * 9, "de"), (98, "ÄÖÜ ÄÖÜ xq" * 9, "en")], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(texts, texts.where("doc_id < 40").select(F.col("doc_id").alias("id"))).collect()}
    assert kept[99]


def test_limits_and_verdicts_against_brute_force(spark):
    """Every trusted text scored by a plain model of the other fold; quantiles by sorting."""
    rng = np.random.RandomState(3)
    words = {"en": ["the", "cat", "dog", "sat", "mat", "on", "and", "log"], "de": ["der", "hund", "und", "die", "katze", "sitzt", "auf"]}
    rows = [(i, " ".join(rng.choice(words[lang], rng.randint(4, 14))), lang) for i, lang in enumerate(["en"] * 34 + ["de"] * 14)]
    rows += [(100, "Zq%% Xw## Vk$$ Jj!! " * 4, "en"), (101, "the cat sat on the log", "en"), (102, "der hund sitzt", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in quality.classify(df, df.where("doc_id < 100").select(F.col("doc_id").alias("id"))).collect()}
    fold = {r["doc_id"]: r["f"] for r in df.select("doc_id", quality.fold_of(F.xxhash64("text")).alias("f")).collect()}

    def cost(p, text):
        data = b"\xff" * 4 + text.encode()
        costs = [-math.log(p(data[j - 4 : j + 1])) for j in range(4, len(data))]
        return np.mean(costs), np.std(costs) / math.sqrt(len(costs))

    others = [reference([t for i, t, _ in rows if i < 100 and fold[i] != f]) for f in range(2)]
    held = [(lang, cost(others[fold[i]], text)[0]) for i, text, lang in rows if i < 100]
    at = lambda values, q: sorted(values)[math.ceil(q * len(values)) - 1]
    spread = lambda values: at(values, quality.HIGH) - at(values, 0.5)
    by = {lang: [x for y, x in held if y == lang] for lang in words}
    widest = max(spread([x for _, x in held]), spread(by["en"]))
    limits = {lang: at(v, 0.5) + (len(v) * spread(v) + quality.LEAST_DOCS * max(spread(v), widest)) / (len(v) + quality.LEAST_DOCS) for lang, v in by.items()}
    whole = reference([t for i, t, _ in rows if i < 100])
    for i, text, lang in rows:
        loss, error = cost(whole, text)
        limit = limits.get(lang, max(limits.values()))
        assert math.log(found[i]["perplexity"]) == pytest.approx(loss, rel=1e-3, abs=1e-3)
        assert math.log(found[i]["perplexity_limit"]) == pytest.approx(limit, rel=1e-3, abs=1e-3)
        assert found[i]["kept"] == (loss - quality.CERTAIN * error <= limit)
    assert not found[100]["kept"] and found[101]["kept"]
