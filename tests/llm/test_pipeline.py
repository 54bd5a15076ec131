from pyspark.sql import functions as F

import corpus_pipeline
from seqlake.llm import mixing
from seqlake.llm.common import materialize

from .edge import components, lower, shingles

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = results[name] = materialize(stage(spark, docs, SF), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    rows = {n: df.collect() for n, df in results.items()}
    by_text = {}
    for r in rows["quality_classifier"]:
        by_text.setdefault(lower(r["text"]), []).append(r["doc_id"])
    exact = sorted(max(v) for v in by_text.values())
    assert sorted(r["doc_id"] for r in rows["exact_dedup"]) == exact
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows["exact_dedup"]}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert sorted(r["doc_id"] for r in rows["ngram_jaccard"]) == sorted(i for i, c in components(sets, links).items() if i == c)
    mixed = sorted(r["doc_id"] for r in rows["source_mixing"])
    assert set(mixed) <= {r["doc_id"] for r in rows["ngram_jaccard"]}
    assert sorted(r["doc_id"] for r in rows["best_fit_packing"] if r["piece"] == 0) == mixed
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    left = {r["doc_id"] for r in rows["ngram_jaccard"]}
    assert len(clean & left & set(mixed)) >= 0.97 * len(clean & left)


def test_run_returns_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns[:3] == ["doc_id", "piece", "start"]


def test_mixing_stage_follows_the_rates_and_keeps_good_documents(spark, monkeypatch):
    kinds = [("good", i, "plain") for i in range(60)] + [("low", i, "junk" if i % 4 else "plain") for i in range(600)]
    rows = [(n, f"{word} text number{i} here", kind) for n, (kind, i, word) in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    model = mixing.learn_domains(docs)
    monkeypatch.setattr(corpus_pipeline, "label_domains", lambda *_: model)
    monkeypatch.setattr(corpus_pipeline, "TARGET_WEIGHTS", {"good": 0.2, "low": 0.8})
    plain = docs.drop("domain")
    rates = mixing.mix(plain, model, {"good": 0.2, "low": 0.8}, anchor="good", floor=1.0)
    expected = rates.agg(F.sum("rate")).first()[0]
    mixed = corpus_pipeline.source_mixing(spark, plain, SF)
    assert abs(mixed.count() - expected) < 0.1 * expected
    top = rates.where(F.col("posterior")[model.names.index("good")] >= F.array_max("posterior"))
    assert top.where("rate < 1 or copies < 1").count() == 0
