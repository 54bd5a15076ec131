"""Mixing documents to target weights of domains, with soft memberships.

A softmax regression learned from labelled rows gives each document a posterior over domains,
from the words and marks that set domains apart; its tokens count towards each domain in proportion. Document rates (how often a
document is taken) then solve a nonnegative least-squares problem: expected tokens per domain
shall match their targets. Texts are read once: tokens and posteriors are written out, and the
rates are fitted on the tokens summed up by distinct posterior. A projected gradient step needs
only one sum per domain over that table, and a rate is a function of a document's posterior and
the gradients so far, so nothing per document is kept between steps. DataFrame expressions only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, fresh, materialize

#: Labelled documents of a domain that the classifier is fitted on, about, and its features.
PER_DOMAIN, VOCABULARY = 2000, 512
#: A feature is telling if it sets two domains apart by this chi-square (corrected for small
#: counts, so one document isn't enough) and is so many times as common in one as in the other
#: (words that only tell long texts from short ones are less than that).
CHI_SQUARE, LIFT = 10.0, 3.0
#: Steps of the regression's descent, which end near its only minimum.
DESCENT = 300
#: The relative residual at which steps end, and the relative change of the weighted squares
#: in a step, on average over the last few, at which they have settled.
TOLERANCE, SETTLED, SETTLING = 1e-3, 1e-3, 10
#: Places of the table that finds a feature's weight by its hash; no two features share one.
SLOTS = 4096
_BREAKS = r"[\s.,;:!?()\"']+"
_BETWEEN_MARKS = r"[\p{L}\p{N}_\s]+"


@dataclass
class Domains:
    """Names, scores of a document without features, and what each feature that is there adds to them."""

    names: list[str]
    base: list[float]
    features: list[str]
    weights: list[list[float]]  # [domain][feature]
    slots: list[int]  # of each feature


def _words(text: Column) -> Column:
    """Lower-case words without the punctuation between them."""
    return F.array_remove(F.split(F.lower(text), _BREAKS), "")


def _with_features(docs: DataFrame, text_col: str, tokens: str, features: str) -> DataFrame:
    """``docs`` with the number of words and the distinct features of a text.

    These are words, runs of marks, and how often words repeat on average, in half powers of
    two. The names of the last two hold a space, which no word has.
    """
    words, marks, own = *fresh(docs, "_words", "_marks"), docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.transform(F.array_distinct(F.array_remove(F.split(text, _BETWEEN_MARKS), "")), lambda run: F.concat(F.lit("#mark "), run))
    out = docs.select(*own, _words(text).alias(words), found.alias(marks))
    out = out.select(*own, F.size(words).cast("long").alias(tokens), F.array_distinct(words).alias(words), marks)
    again = F.least(F.lit(12), F.floor(2 * F.log2(F.greatest(F.lit(1), F.col(tokens)) / F.greatest(F.lit(1), F.size(words))))).cast("string")
    return out.select(*own, tokens, F.concat(words, marks, F.array(F.concat(F.lit("#again "), again))).alias(features))


def _slot(feature: Column) -> Column:
    return F.pmod(F.xxhash64(feature), F.lit(SLOTS)).cast("int")


def learn_domains(labelled: DataFrame, text_col: str = "text", domain_col: str = "domain", id_col: str = "doc_id", per_domain: int = PER_DOMAIN, vocabulary: int = VOCABULARY) -> Domains:
    """Fit the classifier on about ``per_domain`` documents of each domain, chosen by hash.

    Rows with a null domain teach nothing; a null text is empty; copies count once; without
    rows there is no domain. The features are those whose presence differs most between any two
    domains, by chi-square; of two that share a slot the better one.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(domain_col).alias("domain"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("domain is not null")
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    names = sorted(sizes)
    if not names:
        return Domains([], [], [], [], [])
    kept = F.lit(False)
    for name in names:
        part = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < max(1, int(1_000_000 * min(1.0, per_domain / sizes[name])))
        kept = kept | ((F.col("domain") == name) & part)
    sample = materialize(_with_features(rows.where(kept).select("domain", "text").distinct(), "text", "tokens", "features").select("domain", "features"), "mix-sample")
    docs = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    by_domain = [F.count(F.when(F.col("domain") == name, 1)).alias(f"n{i}") for i, name in enumerate(names)]
    counts = sample.select("domain", F.explode("features").alias("word")).where("word is not null and word <> ''").groupBy("word").agg(*by_domain)
    apart = F.lit(0.0)
    for i, j in combinations(range(len(names)), 2):
        apart = F.greatest(apart, _chi_square(F.col(f"n{i}"), F.col(f"n{j}"), docs.get(names[i], 0), docs.get(names[j], 0)))
    telling = counts.withColumn("apart", apart).where(F.col("apart") >= CHI_SQUARE).orderBy(F.desc("apart"), "word").limit(vocabulary)
    slots: dict[int, tuple] = {}
    for row in telling.withColumn("slot", _slot(F.col("word"))).collect():
        slots.setdefault(row["slot"], row)
    features = [row["word"] for row in slots.values()]
    at = {slot: i for i, slot in enumerate(slots)}
    known = sample.select("domain", F.transform(F.array_intersect("features", _listed(features)), _slot).alias("slots")).collect()
    drop_table(sample)
    found = np.zeros((len(known), len(features) + 1))
    found[:, -1] = 1
    for i, row in enumerate(known):
        found[i, [at[slot] for slot in row["slots"]]] = 1
    of = np.array([names.index(row["domain"]) for row in known])
    # Each sampled document stands for as many as its domain has for one of them.
    stands = np.array([sizes[name] / docs.get(name, 1) for name in names])[of]
    weights = _softmax(found, of, stands * len(known) / stands.sum(), len(names))
    return Domains(names, weights[-1].tolist(), features, weights[:-1].T.tolist(), list(slots))


def _softmax(found: np.ndarray, of: np.ndarray, stands: np.ndarray, k: int) -> np.ndarray:
    """Weights [feature, domain] of the multinomial logistic regression, by accelerated descent.

    The last feature is the constant; the others' weights have a normal prior of variance 1.
    """
    prior = np.full((found.shape[1], 1), 1.0)
    prior[-1] = 0
    weights = ahead = np.zeros((found.shape[1], k))
    step = 1 / (0.5 * np.linalg.norm(found * np.sqrt(stands)[:, None], 2) ** 2 + 1)
    momentum = 1.0
    for _ in range(DESCENT):
        scores = found @ ahead
        likely = np.exp(scores - scores.max(axis=1, keepdims=True))
        likely /= likely.sum(axis=1, keepdims=True)
        likely[np.arange(len(of)), of] -= 1
        after = ahead - step * (found.T @ (likely * stands[:, None]) + prior * ahead)
        following = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, weights, momentum = after + (momentum - 1) / following * (after - weights), after, following
    return weights


def _chi_square(some: Column, others: Column, of_some: int, of_others: int) -> Column:
    """Of the presence of a feature in two domains, with Yates' correction; 0 below LIFT."""
    every, both = of_some + of_others, some + others
    gap = F.greatest(F.lit(0.0), F.abs(some * of_others - others * of_some) - every / 2)
    spread = (both * (every - both)).cast("double") * float(of_some) * float(of_others)
    rate, other = (some + 0.5) / (of_some + 1.0), (others + 0.5) / (of_others + 1.0)
    telling = (spread > 0) & (F.greatest(rate, other) >= LIFT * F.least(rate, other))
    return F.when(telling, every * gap * gap / spread).otherwise(0.0)


def _listed(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def with_posteriors(docs: DataFrame, model: Domains, text_col: str, tokens: str, posterior: str) -> DataFrame:
    """``docs`` with columns named ``tokens`` (long) and ``posterior`` (array by domain), which it must not have."""
    found, scores, mass = fresh(docs, "_found", "_scores", "_mass")
    own = docs.columns
    out = _with_features(docs, text_col, tokens, found).select(*own, tokens, F.array_intersect(found, _listed(model.features)).alias(found))

    def score(base: float, weights: list[float]) -> Column:
        by_slot = ["0"] * SLOTS
        for slot, weight in zip(model.slots, weights, strict=True):
            by_slot[slot] = repr(weight)
        value = F.split(F.lit(",".join(by_slot)), ",").cast("array<double>")  # folded into one literal
        return F.aggregate(found, F.lit(base), lambda acc, w: acc + value[_slot(w)])

    out = out.select(*own, tokens, F.array(*[score(b, w) for b, w in zip(model.base, model.weights, strict=True)]).cast("array<double>").alias(scores))
    top = F.array_max(scores)
    out = out.select(*own, tokens, F.transform(scores, lambda s: F.exp(s - top)).alias(mass))
    # Four digits leave few distinct posteriors.
    return out.select(*own, tokens, F.transform(mass, lambda m: F.round(m / F.aggregate(mass, F.lit(0.0), lambda a, b: a + b), 4)).alias(posterior))


def _lowest(posterior: Column, held: int | None, floor: float) -> Column:
    """``floor`` where the domain ``held`` is the most probable one, else 0."""
    if held is None or not floor:
        return F.lit(0.0)
    return F.when(posterior[held] >= F.array_max(posterior), F.lit(float(floor))).otherwise(F.lit(0.0))


def _rates(posterior: str, steps: list[list[float]], held: int | None = None, floor: float = 0.0, first: Column | None = None) -> Column:
    """``struct(rate, before)`` after the given steps, from ``first`` or rates of 1 on.

    A step is the momentum by which a rate moves on, and what each domain then takes off it;
    rates are kept at the lowest allowed or above after each.
    """
    one = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("before")) if first is None else first
    if not steps:
        return one
    flat = F.split(F.lit(";".join(",".join(map(repr, s)) for s in steps)), ";")
    listed = F.transform(flat, lambda s: F.split(s, ",").cast("array<double>"))
    p = F.col(posterior)
    lowest = _lowest(p, held, floor)

    def follow(r: Column, step: Column) -> Column:
        ahead = r["rate"] + step[0] * (r["rate"] - r["before"])
        taken = sum((p[k] * step[k + 1] for k in range(len(steps[0]) - 1)), F.lit(0.0))
        return F.struct(F.greatest(lowest, ahead - taken).alias("rate"), r["rate"].alias("before"))

    return F.aggregate(listed, one, follow)


@dataclass
class Fit:
    """Steps of the descent, and what they reach: totals by domain and the relative residual."""

    steps: list[list[float]]
    totals: list[float]
    residual: float


def fit_rates(compact: DataFrame, targets: Sequence[float], tokens: str = "tokens", posterior: str = "posterior", held: int | None = None, floor: float = 0.0) -> Fit:
    """Steps that lead the rates of ``compact`` to expected domain totals near ``targets``.

    Squared residuals are weighted by the inverse row sums of the moment matrix of all
    documents, under which a step of length one never overshoots (posteriors add up to one, so
    these row sums are first moments). Steps have Nesterov's momentum, which is dropped when
    the squares grow. They end when the residual is small, or when the squares have settled at
    what nonnegative rates can reach.
    """
    k = len(targets)
    p, t, whole = F.col("posterior"), F.col("tokens"), sum(targets) or 1.0
    groups = materialize(compact.groupBy(F.col(posterior).alias("posterior")).agg(F.sum(F.col(tokens).cast("double")).alias("tokens")).withColumn("rates", _rates("posterior", [])), "mix-groups")
    moments = [x or 0.0 for x in groups.agg(*[F.sum(t * p[i]) for i in range(k)]).first()]
    steps: list[list[float]] = []
    written, momentum, older = 0, 1.0, moments
    squares: list[float] = []
    while True:
        state = groups.withColumn("now", _rates("posterior", steps[written:], held, floor, F.col("rates"))["rate"])
        reached = [x or 0.0 for x in state.agg(*[F.sum(t * p[i] * F.col("now")) for i in range(k)]).first()]
        residual = sum(abs(a - b) for a, b in zip(reached, targets, strict=True)) / whole
        squares.append(sum((a - b) ** 2 / m for a, b, m in zip(reached, targets, moments, strict=True) if m))
        past, last = squares[:-SETTLING], squares[-SETTLING:]
        if residual < TOLERANCE or past and past[-1] - min(last) < SETTLED * SETTLING * last[-1]:
            break
        momentum = 1.0 if len(last) > 1 and last[-1] > last[-2] else momentum
        following = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        on, momentum = (momentum - 1) / following, following
        ahead = [a + on * (a - b) for a, b in zip(reached, older, strict=True)]
        older = reached
        steps.append([on, *((a - b) / m if m else 0.0 for a, b, m in zip(ahead, targets, moments, strict=True))])
        if len(steps) - written == 50:
            before, groups = groups, materialize(groups.withColumn("rates", _rates("posterior", steps[written:], held, floor, F.col("rates"))), "mix-groups")
            written = len(steps)
            drop_table(before)
    drop_table(groups)
    return Fit(steps, reached, residual)


def mix(docs: DataFrame, model: Domains, weights: Mapping[str, float], total: float | None = None, anchor: str | None = None, text_col: str = "text", id_col: str = "doc_id", rounding: str = "hash", floor: float = 0.0, columns: Sequence[str] | None = None) -> DataFrame:
    """All columns of ``docs`` (or those of ``columns``) with ``tokens, posterior, residual, rate, copies``.

    ``weights`` are the domains' shares of the expected tokens (others get none), ``total``
    their sum; without it, the domain ``anchor`` (or the one of most weight) keeps its present
    expected tokens. ``copies`` rounds the rate: to the nearest number, or up with a
    probability that makes the expected copies the rate, drawn from a hash of id and text.
    No document that is most probably of the anchor gets a rate below ``floor``; the others
    make up for it. ``residual`` says by how much of ``total`` the expected totals miss their
    targets, the same in every row: nonnegative rates can't reach every target.

    Without a model, or with no tokens at all, every rate is 1. A null text has no tokens and
    the posterior of an empty text; a text counts whole, however long; repeated rows have equal
    rates; no rows give no rows. No column of the caller is replaced: the five new ones are the
    last, and one whose name is taken gets a ``_`` before it.
    """
    own = list(docs.columns if columns is None else columns)
    tokens, posterior, residual, rate, copies, draw = fresh(docs, "tokens", "posterior", "residual", "rate", "copies", "_draw")
    found = with_posteriors(docs, model, text_col, tokens, posterior)
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    rows = materialize(found.select(*own, tokens, posterior, drawn.alias(draw)), "mix-posteriors")
    fitted = fit_for(rows, model, weights, total, anchor, floor, tokens, posterior)
    up = F.lit(0.5) if rounding == "nearest" else F.col(draw)
    rated = rows.select(*own, tokens, posterior, F.lit(fitted.residual).alias(residual), _rates(posterior, fitted.steps, _held(model, weights, anchor), floor)["rate"].alias(rate), draw)
    return rated.select(*own, tokens, posterior, residual, rate, F.floor(F.col(rate) + up).cast("long").alias(copies))


def fit_for(rows: DataFrame, model: Domains, weights: Mapping[str, float], total: float | None = None, anchor: str | None = None, floor: float = 0.0, tokens: str = "tokens", posterior: str = "posterior") -> Fit:
    """The fit of :func:`fit_rates` for shares of tokens, see :func:`mix`."""
    if not model.names:
        return Fit([], [], 0.0)
    held = _held(model, weights, anchor)
    anchor = anchor or model.names[held]
    if total is None:
        kept = rows.agg(F.sum(F.col(tokens) * F.col(posterior)[held])).first()[0] or 0.0
        total = kept / weights[anchor] if weights.get(anchor) else 0.0
    return fit_rates(rows, [total * weights.get(n, 0.0) for n in model.names], tokens, posterior, held, floor) if total else Fit([], [], 0.0)


def _held(model: Domains, weights: Mapping[str, float], anchor: str | None) -> int | None:
    """Which domain is the anchor."""
    if not model.names:
        return None
    return model.names.index(anchor or max(model.names, key=lambda n: weights.get(n, 0.0)))
