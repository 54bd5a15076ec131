import numpy as np

from seqlake.llm import langid, textbuf
from seqlake.llm.queries import op4_language_id

from .edge import CLASHING, docs, empty


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = op4_language_id(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97
    assert ((found.score >= 0) & (found.score <= 1)).all()


def test_scores_equal_a_plain_sum(spark):
    model = langid.train(docs(spark, clash=False))
    text = "The fox"
    buf = next(textbuf.buffers(langid._encode([text]), 4, langid.ORDER - 1, b" \0\0\0"))
    sums = model.log_prior + model.log_prob[langid._grams(buf.units, buf.ends()).ravel()].sum(axis=0)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = langid.predict(df, model).first()
    assert row["lang_pred"] == model.languages[int(np.argmax(sums))]
    assert abs(row["score"] - 1 / np.exp(sums - sums.max()).sum()) < 1e-5


def test_edge_rows(spark):
    model = langid.train(docs(spark))
    found = {str(r["doc_id"]) + str(r["text"])[:3]: r for r in langid.predict(docs(spark), model).collect()}
    assert {found[k]["lang_pred"] for k in ("3", "4Non", "5 \n\t", "10!!!", "11² ½")} == {"und"}
    assert found["6wor"]["lang_pred"] == "en"
    rows = langid.predict(docs(spark), model).collect()
    assert len(rows) == docs(spark).count() and rows[0].__fields__[-2:] == ["lang_pred", "_score"]
    assert all(r[c] == "x" for r in rows for c in CLASHING)


def test_training_against_brute_force(spark):
    """Counts of hashed 1- to 3-grams, priors and predictions, written plainly in Python."""
    rows = [("the fox and the hound", "en"), ("the end", "en"), ("der Fuchs und der Hund", "de"), ("é😀 À", "fr"), (None, "fr"), ("x", None)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    counts = {lang: [0.5] * (1 << langid.BITS) for lang in ("de", "en", "fr")}

    def buckets(text):
        units = [32, 32, *map(ord, text.lower())]
        for i in range(2, len(units)):
            for k in range(3):
                code = sum(units[i - j] << (21 * j) for j in range(k + 1))
                yield (code * int(langid._MIX[k])) % 2**64 >> (64 - langid.BITS)

    for text, lang in rows:
        for b in buckets(text) if text and lang else ():
            counts[lang][b] += 1
    priors = {"de": 1 / 4, "en": 2 / 4, "fr": 1 / 4}
    assert model.languages == ["de", "en", "fr"]
    for j, lang in enumerate(model.languages):
        assert np.allclose(model.log_prob[:, j], np.log(np.array(counts[lang]) / sum(counts[lang])), atol=1e-5)
        assert np.isclose(model.log_prior[j], np.log(priors[lang]))
    tried = ["the hound", "und der", "À", "fox Hund"]
    found = {r["text"]: r for r in langid.predict(spark.createDataFrame([(t,) for t in tried], "text string"), model).collect()}
    for text in tried:
        sums = np.array([np.log(priors[la]) + sum(np.log(counts[la][b] / sum(counts[la])) for b in buckets(text)) for la in model.languages])
        assert found[text]["lang_pred"] == model.languages[int(sums.argmax())]
        assert np.isclose(found[text]["score"], 1 / np.exp(sums - sums.max()).sum(), atol=1e-4)


def test_long_text(spark):
    model = langid.train(docs(spark, clash=False))
    df = spark.createDataFrame([(1, "the quick brown fox " * 1_000_000), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, model).collect()} == {1: "en", 2: "und"}


def test_nothing_learned(spark):
    model = langid.train(empty(spark))
    assert {r["lang_pred"] for r in langid.predict(docs(spark), model).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


def test_pieces_of_long_texts_count_once():
    texts = [b"abcdefghij" * 5, b"", b"xyz"]
    whole = list(textbuf.buffers(texts, 1, 2, b" "))
    cut = list(textbuf.buffers(texts, 1, 2, b" ", limit=7))

    def grams(found):
        out = []
        for buf in found:
            for j, owner in enumerate(buf.owner):
                for e in buf.ends()[buf.starts[j] : buf.starts[j + 1]]:
                    out.append((owner, bytes(buf.units[e - 2 : e + 1])))
        return sorted(out)

    assert grams(whole) == grams(cut) and len(grams(cut)) == 53
