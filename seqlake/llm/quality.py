"""Quality classification by an interpolated modified Kneser-Ney n-gram model.

The units are UTF-8 bytes, so five of them pack into one long without hashing and one model
serves all languages. Counts come from all trusted text: numpy counts 5-grams task by task
and Spark adds them up; continuation counts, discounts and interpolated probabilities of all
orders are then group-bys and joins over n-gram tables, whose keys have at most 256
successors each. For scoring, the table is cut into shards by the two bytes before the
scored one. Each shard has at most ``SHARD_ENTRIES`` entries, and is joined to the n-grams of
all documents from a broadcast hash table, so memory is bounded at any size of the corpus.

A model knows the texts that it was learned from, so their perplexities say little about those
of other texts. Limits therefore are quantiles, language by language, over trusted documents
scored out of fold: texts fall into FOLDS by hash, and each fold is scored by a model of the
others. Grams are counted once, by fold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, fresh, marks, materialize, prepare, tidy, with_mark
from .textbuf import buffers, slices

ORDER = 5
#: Entries of a broadcast shard (16 bytes each in a table that is at most half full: 128 MB).
SHARD_ENTRIES = 4_000_000
#: Distinct n-grams that a counting task holds before it hands them on.
TASK_GRAMS = 1_000_000
#: A document is rejected if its log perplexity is above the HIGH quantile of the trusted
#: documents of its language. The quantile's distance from their median is averaged with a safe
#: wider one that counts like LEAST_DOCS documents.
HIGH, LEAST_DOCS, CERTAIN = 0.99, 30, 2.0
#: Parts of the trusted texts, each scored by a model of the others; copies fall into one.
FOLDS = 2
_PAD = b"\xff"  # never in UTF-8
_GAMMA = 8  # orders of context weights are stored above this


def _packed(units: np.ndarray, ends: np.ndarray) -> np.ndarray:
    code = np.zeros(len(units), np.int64)
    wide = units.astype(np.int64)
    for k in range(ORDER):
        code[k:] |= wide[: len(units) - k] << (8 * k)
    return code[ends]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        grams, back = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
        return grams, np.bincount(back, weights=np.concatenate([n for _, n in held])).astype(np.int64)

    def handed(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["gram", "n"])

    for batch in slices(batches):
        folds = batch.column(0).to_numpy() << 8 * ORDER
        texts = [t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
        for buf in buffers(texts, 1, ORDER - 1, _PAD):
            owner = np.repeat(buf.owner, np.diff(buf.starts))
            held.append(np.unique(_packed(buf.units, buf.ends()) | folds[owner], return_counts=True))
            if sum(len(g) for g, _ in held) > TASK_GRAMS:
                held = [merged()]
                if len(held[0][0]) > TASK_GRAMS // 2:
                    yield handed(held.pop())
    if held:
        yield handed(merged())


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two and three or more."""
    have = {r[0]: r[1] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*")).collect()}  # at most four rows
    n1, n2, n3, n4 = (have.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2 if n3 else 1.0
    d3 = 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5
    return tuple(min(max(d, 0.05), top) for d, top in ((d1, 0.95), (d2, 1.95), (d3, 2.95)))


def train(trusted: DataFrame, text_col: str = "text") -> DataFrame:
    """The model as a table ``key, value``: log probabilities and log context weights.

    Key is ``order << 40 | bytes`` of an n-gram, or of a context with 8 added to its order.
    Null and empty texts add nothing; without any text the table is empty.
    """
    counted = count_folds(trusted, text_col)
    model = fit(counted)
    drop_table(counted)
    return model


def fold_of(digest: Column) -> Column:
    """The fold of a text whose xxhash64 is ``digest``."""
    return F.pmod(digest, F.lit(FOLDS))


def count_folds(trusted: DataFrame, text_col: str = "text") -> DataFrame:
    """``fold, gram, n``: 5-grams of the texts that aren't null, counted by fold of the text."""
    texts = trusted.select(fold_of(F.xxhash64(text_col)).alias("fold"), text_col).where(F.col(text_col).isNotNull())
    grams = texts.mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    plain = F.col("gram").bitwiseAND(F.lit((1 << 8 * ORDER) - 1)).alias("gram")
    return materialize(grams.select(F.shiftright("gram", 8 * ORDER).alias("fold"), plain, "n"), "lm-folds")


def fit(counted: DataFrame) -> DataFrame:
    """The model, see :func:`train`, of all rows of :func:`count_folds` that are given."""
    by_order = {ORDER: materialize(counted.groupBy("gram").agg(F.sum("n").alias("n")), "lm-grams5")}
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
        by_order[k] = materialize(by_order[k + 1].select(shorter).groupBy("gram").agg(F.count("*").alias("n")), f"lm-grams{k}")
    tables: list[DataFrame] = []
    handed: list[DataFrame] = [*by_order.values()]
    lower = None
    for k in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(by_order[k])
        n = F.col("n")
        context = F.shiftright("gram", 8).alias("context")
        weight = F.sum(F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)) / F.sum("n")
        contexts = materialize(by_order[k].groupBy(context).agg(F.sum("n").alias("total"), weight.alias("gamma")), f"lm-contexts{k}")
        joined = by_order[k].select("gram", "n", context).join(contexts, "context")
        if lower is None:
            below = joined.withColumn("below", F.lit(1 / 256))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
            below = joined.withColumn("suffix", suffix).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        seen = (n - F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)) / F.col("total")
        lower = materialize(below.select("gram", (seen + F.col("gamma") * F.col("below")).alias("p")), f"lm-p{k}")
        tables.append(lower.select(F.col("gram").bitwiseOR(F.lit(k << 40)).alias("key"), F.log("p").cast("float").alias("value")))
        tables.append(contexts.select(F.col("context").bitwiseOR(F.lit((_GAMMA + k - 1) << 40)).alias("key"), F.log("gamma").cast("float").alias("value")))
        handed += [contexts, lower]
    model = materialize(reduce(DataFrame.unionByName, tables), "lm-model")
    for part in handed:
        drop_table(part)
    tidy(counted.sparkSession)
    return model


def _pair(key: Column) -> Column:
    """The two bytes before the scored one; -1 for entries that every shard needs."""
    order = F.shiftright(key, 40)
    of_gram, of_context = F.shiftright(key, 8).bitwiseAND(F.lit(0xFFFF)), key.bitwiseAND(F.lit(0xFFFF))
    return F.when((order < 3) | order.isin(_GAMMA, _GAMMA + 1), -1).when(order < _GAMMA, of_gram).otherwise(of_context)


def shards(model: DataFrame, entries: int = SHARD_ENTRIES) -> list[list[int]]:
    """Byte pairs of each shard, so that none has more than ``entries`` (one pair may)."""
    sizes = model.groupBy(_pair(F.col("key")).alias("pair")).agg(F.count("*").alias("n")).where("pair >= 0").collect()
    out: list[list[int]] = []
    room = 0
    for pair, n in sorted(sizes, key=lambda r: r["pair"]):
        if not out or n > room:
            out.append([])
            room = entries
        out[-1].append(pair)
        room -= n
    return out or [[]]


class Table:
    """Open-addressing hash table from long to float, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, math.ceil(math.log2(2 * len(keys) + 1)))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]] = keys[left[won]]
            self.values[slot[won]] = values[left[won]]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, slot = left[lost], (slot[lost] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value or 0) for each key."""
        slot = self._slot(keys)
        at = self.keys[slot]
        found = at == keys
        value = np.where(found, self.values[slot], np.float32(0))
        left = np.flatnonzero(~found & (at != -1))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            at = self.keys[slot]
            hit = at == keys[left]
            found[left[hit]] = True
            value[left[hit]] = self.values[slot[hit]]
            on = ~hit & (at != -1)
            left, slot = left[on], slot[on]
        return found, value


def _log_probs(grams: np.ndarray, model: Table) -> np.ndarray:
    out = np.zeros(len(grams))
    left, weight = np.arange(len(grams)), np.zeros(len(grams))
    for k in range(ORDER, 0, -1):
        own = grams[left] & ((1 << 8 * k) - 1)
        found, value = model.get(own | (k << 40))
        out[left[found]] = weight[found] + value[found]
        left, weight, own = left[~found], weight[~found], own[~found]
        if not len(left):
            return out
        weight = weight + model.get((own >> 8) | ((_GAMMA + k - 1) << 40))[1]
    out[left] = weight - math.log(256)
    return out


def log_perplexity(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", entries: int = SHARD_ENTRIES) -> DataFrame:
    """One row per distinct ``id, digest`` (xxhash64 of the text): with ``loss, error``.

    ``loss`` is the log perplexity per byte of the whole text, ``error`` its standard error
    over the bytes. Texts that are null or empty have no row; repeated rows have one. The rows
    are written out, so the broadcast model is gone when this returns.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    parts, sent = [], []
    pairs = shards(model, entries)
    rest = np.array(sorted(p for own in pairs[1:] for p in own), np.int64)
    for i, own in enumerate(pairs):
        entry = model.where(_pair(F.col("key")).isin(-1, *own)) if len(pairs) > 1 else model
        got = entry.select("key", "value").toArrow()
        loaded = Table(got["key"].to_numpy(), got["value"].to_numpy())
        # The first shard also has the pairs that no entry ends in.
        shared = spark.sparkContext.broadcast((loaded, np.array(sorted(own), np.int64) if i else rest, bool(i)))
        del got, loaded
        sent.append(shared)
        parts.append(rows.mapInArrow(_scorer(shared), f"id {rows.schema['id'].dataType.simpleString()}, digest long, units long, nats double, squares double"))
    # Every shard has a row for each row of docs, so sums over copies are divided by their number.
    copies = F.count("*") / len(pairs)
    sums = reduce(DataFrame.unionByName, parts).groupBy("id", "digest").agg(*[(F.sum(c) / copies).alias(c) for c in ("units", "nats", "squares")])
    loss = F.col("nats") / F.col("units")
    error = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("units") - loss * loss) / F.col("units"))
    found = materialize(sums.select("id", "digest", loss.alias("loss"), error.alias("error")), "lm-losses")
    for shared in sent:
        shared.destroy()
    tidy(spark)
    return found


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, listed, own = shared.value
        for batch in slices(batches):
            texts = [t.encode("utf-8", "replace") for t in batch.column(2).to_pylist()]
            units, nats, squares = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            for buf in buffers(texts, 1, ORDER - 1, _PAD):
                grams = _packed(buf.units, buf.ends())
                owner = np.repeat(buf.owner, np.diff(buf.starts))
                if own or len(listed):
                    mine = np.isin((grams >> 8) & 0xFFFF, listed, invert=not own)
                    grams, owner = grams[mine], owner[mine]
                units += np.bincount(owner, minlength=len(texts))
                cost = -_log_probs(grams, model)
                nats += np.bincount(owner, weights=cost, minlength=len(texts))
                squares += np.bincount(owner, weights=cost * cost, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units), pa.array(nats), pa.array(squares)], ["id", "digest", "units", "nats", "squares"])

    return score


def thresholds(trusted: DataFrame, high: float = HIGH, least: int = LEAST_DOCS) -> tuple[DataFrame, float | None]:
    """From ``lang, loss`` of trusted documents scored out of fold: ``lang, limit`` and the loosest limit.

    The limit is the ``high`` quantile. Few documents say little about it, so its distance from
    the median is averaged, by the number of documents against ``least``, with the widest among
    its own, that of all documents together and those of languages with ``least`` documents.
    """
    quantiles = F.percentile_approx("loss", F.array(F.lit(0.5), F.lit(high)), 10_000).alias("q")
    own = F.col("q")[1] - F.col("q")[0]
    langs = materialize(trusted.groupBy("lang").agg(quantiles, F.count("*").alias("n")).select("lang", "n", F.col("q")[0].alias("middle"), own.alias("own")), "lm-spreads")
    pooled = trusted.agg(quantiles).select(own).first()[0]
    widest = langs.where(F.col("n") >= least).agg(F.max("own")).first()[0]
    safe = F.greatest("own", F.lit(max(pooled or 0.0, widest or 0.0)))
    limit = F.col("middle") + (F.col("n") * F.col("own") + least * safe) / (F.col("n") + least)
    limits = langs.select("lang", limit.alias("limit"))
    return limits.where("lang is not null"), limits.agg(F.max("limit")).first()[0]


def _losses_out_of_fold(docs: DataFrame, counted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, digest, loss`` of all rows, each scored by the model of the folds that its text isn't in."""
    parts = []
    for fold in range(FOLDS):
        model = fit(counted.where(F.col("fold") != fold))
        held_out = docs.where(fold_of(F.xxhash64(text_col)) == fold)
        parts.append(log_perplexity(held_out, model, id_col, text_col).select("id", "digest", "loss"))
        drop_table(model)
    return reduce(DataFrame.unionByName, parts)


def classify(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", high: float = HIGH) -> DataFrame:
    """All columns of ``docs`` with ``perplexity, perplexity_limit, kept``.

    ``trusted_ids`` (one column ``id``) names the documents that the model and the limits are
    learned from. A document is kept unless its perplexity per byte is above the limit of its
    language, or the loosest limit where its language is null, by more than CERTAIN standard
    errors (a short text says little about its perplexity). Of a language that no trusted
    document has, the model knows nothing: there is no limit. A text that is null or empty has
    no perplexity and isn't kept; long ones count whole, buffer by buffer. Where nothing is
    trusted, every document that has a text is kept. Repeated rows are judged alike; ids may be
    null; no rows give no rows. No column of the caller is replaced: the new ones are the last
    three, and one whose name is taken gets a ``_`` before it.
    """
    own = docs.columns
    perplexity, perplexity_limit, kept = fresh(docs, "perplexity", "perplexity_limit", "kept")
    id_, digest, loss, error, lang, limit, own_digest = fresh(docs, "_id", "_digest", "_loss", "_error", "_lang", "_limit", "_own_digest")
    trusted_ids = trusted_ids.select(F.col("id").alias(id_)).where(F.col(id_).isNotNull()).distinct()
    texts = docs.select(F.col(id_col).alias(id_), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    # Few rows are shuffled that aren't trusted.
    maybe = with_mark(texts, marks(trusted_ids, id_), "marked", id_).where("marked").drop("marked")
    trusted = maybe.join(trusted_ids.hint("merge"), id_, "left_semi")
    counted = count_folds(trusted)
    held_out = _losses_out_of_fold(docs, counted, id_col, text_col).withColumnsRenamed({"id": id_, "digest": digest})
    langs = texts.select(id_, F.xxhash64("text").alias(digest), "lang")
    seen = langs.join(trusted_ids, id_, "left_semi").join(held_out, [id_, digest]).select("lang", "loss")
    by_lang, loosest = thresholds(materialize(seen, "lm-trusted"), high)
    limits = materialize(by_lang.select(F.col("lang").alias(lang), F.col("limit").alias(limit)), "lm-limits")
    model = fit(counted)
    drop_table(counted)
    losses = log_perplexity(docs, model, id_col, text_col).withColumnsRenamed({"id": id_, "digest": digest, "loss": loss, "error": error})
    drop_table(model)
    keyed = docs.withColumn(own_digest, F.xxhash64(text_col))
    judged = keyed.join(losses.hint("merge"), keyed[id_col].eqNullSafe(losses[id_]) & (keyed[own_digest] == losses[digest]), "left").join(limits, keyed[lang_col] == limits[lang], "left")
    most = F.when(keyed[lang_col].isNull(), F.lit(loosest).cast("double")).otherwise(F.col(limit))
    good = F.when(F.col(loss).isNull(), F.lit(False)).otherwise(F.coalesce(F.col(loss) - CERTAIN * F.col(error) <= most, F.lit(True)))
    return judged.select(*[keyed[c] for c in own], F.exp(loss).alias(perplexity), F.exp(most).alias(perplexity_limit), good.alias(kept))


def keep_good(docs: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", high: float = HIGH) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with all their columns.

    Only rows that may have to go are shuffled: those whose id has a mark of a rejected one.
    """
    id_, digest, marked, own = fresh(docs, "_id", "_digest", "_marked", "_own_digest")
    judged = classify(docs.select(id_col, text_col, lang_col), trusted_ids, id_col, text_col, lang_col, high)
    gone = judged.where(~F.col(judged.columns[-1])).select(F.col(id_col).alias(id_), F.xxhash64(text_col).alias(digest), F.col(lang_col).alias("lang"))
    gone = materialize(gone.distinct(), "lm-gone")
    flagged = with_mark(docs, marks(gone, id_), marked, id_col)
    maybe = flagged.where(F.col(marked)).drop(marked).withColumn(own, F.xxhash64(text_col))
    same = maybe[id_col].eqNullSafe(gone[id_]) & (maybe[own] == gone[digest]) & maybe[lang_col].eqNullSafe(gone["lang"])
    left = maybe.join(gone.hint("merge"), same, "left_anti").drop(own)
    return flagged.where(~F.col(marked)).drop(marked).unionByName(left)
