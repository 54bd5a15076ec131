"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams in numpy task by task and adds the counts up by (language, bucket)
in Spark, so the shuffle holds at most languages x buckets rows a task whatever the texts
are. The model is a matrix of log probabilities whose size is fixed by its parameters; it is
broadcast, and batches are scored with one gather and one segmented sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, prepare
from .textbuf import buffers, slices

#: Buckets of the hash, longest n-gram, and languages that a model may hold: the broadcast
#: matrix has at most MAX_LANGUAGES * 2**BITS floats (64 MB).
BITS, ORDER, MAX_LANGUAGES = 16, 3, 256
UNDETERMINED = "und"
#: Odd multipliers of the hash, one for each order.
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # [bucket, language]


def _grams(units: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of every order that end at ``ends``: [len(ends), ORDER]."""
    out = np.empty((len(ends), ORDER), np.uint32)
    code = np.zeros(len(units), np.uint64)
    shifted = units.astype(np.uint64)
    for k in range(ORDER):
        code[k:] |= shifted[: len(units) - k] << np.uint64(21 * k)
        out[:, k] = ((code * _MIX[k]) >> np.uint64(64 - BITS))[ends]
    return out


def _encode(texts: list[str]) -> list[bytes]:
    return [t.lower().encode("utf-32-le", "replace") for t in texts]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in slices(batches):
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            rows[lang] = rows.get(lang, 0) + len(texts)
            total = totals.setdefault(lang, np.zeros(1 << BITS, np.int64))
            for buf in buffers(_encode(texts), 4, ORDER - 1, b" \0\0\0"):
                total += np.bincount(_grams(buf.units, buf.ends()).ravel(), minlength=1 << BITS)
    for lang, total in totals.items():
        bucket = np.flatnonzero(total)
        bucket_col = np.concatenate(([-1], bucket))
        count_col = np.concatenate(([rows[lang]], total[bucket]))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket_col)), pa.array(bucket_col, pa.int64()), pa.array(count_col, pa.int64())], ["lang", "bucket", "n"])


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """Learn from every row whose language and text are not null; without any, nothing.

    Raises ValueError if there are more than MAX_LANGUAGES languages, since the model has to
    fit a broadcast: clean the labels first. Long texts count whole, buffer by buffer.
    """
    prepare(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.limit((MAX_LANGUAGES + 1) * ((1 << BITS) + 1)).toArrow()
    listed = found["lang"].combine_chunks().dictionary_encode()
    lang, names = listed.indices.to_numpy(), listed.dictionary.to_pylist()
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    languages = sorted(names)
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    matrix, prior = np.full((1 << BITS, len(languages)), smoothing), np.ones(len(languages))
    for j, name in enumerate(languages):
        own = lang == names.index(name)
        counted = own & (bucket >= 0)
        matrix[bucket[counted], j] += n[counted]
        prior[j] = n[own & (bucket < 0)].sum()
    return Model(languages, np.log(prior / prior.sum()), np.log(matrix / matrix.sum(axis=0)).astype(np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred, score``.

    No column of the caller is replaced: the new ones are the last two, and one whose name is
    taken gets a ``_`` before it. ``lang_pred`` is a learned language or ``und`` where the text is null or has no letter
    (score 0) or where nothing was learned; ``score`` is the posterior of the language. Whole
    texts count, buffer by buffer. Letters are what Unicode calls so (``str.isalpha``). Repeated
    rows are judged alike; no rows give none. Of languages that are equally likely the first by name is given.
    """
    prepare(docs.sparkSession)
    new = fresh(docs, "lang_pred", "score")
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            real = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))] if learned.languages else []
            sums = np.tile(learned.log_prior, (len(real), 1))
            for buf in buffers(_encode([texts[i] for i in real]), 4, ORDER - 1, b" \0\0\0"):
                grams = _grams(buf.units, buf.ends())
                part = learned.log_prob[grams[:, 0]].astype(np.float64)
                for k in range(1, ORDER):
                    part += learned.log_prob[grams[:, k]]
                np.add.at(sums, buf.owner, np.add.reduceat(part, buf.starts[:-1], axis=0))
            pred, posterior = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if real:
                best = sums.argmax(axis=1)
                likely = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                posterior[real] = likely
                for i, j in zip(real, best, strict=True):
                    pred[i] = learned.languages[j]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(posterior)], [*batch.schema.names, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{fields}, `{new[0]}` string, `{new[1]}` double")
