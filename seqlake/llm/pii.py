"""Personal data: fixed patterns with checks, and candidates chosen by boosted trees.

Everything is a DataFrame expression. The base kinds (email, ip, card, phone) are regular
expressions whose matches must pass a check. Looser generators of every kind propose more spans,
which may overlap; gradient-boosted trees over format and context features score them, and a
threshold calibrated to a wanted precision selects those that are added. The trees learn from
planted cases: into a bounded sample of the corpus's own texts, made-up personal data and
look-alikes (dates, versions, serial numbers, long words) are set in varying contexts, so a label
says what was planted, not what a pattern sees. Learning and calibration use different documents.

A text is read once; no shuffle is needed for finding spans.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: Documents, about, that cases are planted into: half for the trees, half for their threshold.
SAMPLE = 4_000
TREES, RATE, PRECISION = 24, 0.4, 0.98
#: Characters of context on either side that features see.
CONTEXT = 24
#: Matches that one step of the running sum handles; its cost grows with this times matches.
_CHUNK = 256

#: Base patterns. Possessive forms match the same as greedy ones here, since no character of
#: a run can start what follows it; the look-behind starts a run only once, in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Loose generators, by the kind of the spans that they add.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:[(\[{](?i:at)[)\]}]| (?i:at) ) ?[A-Za-z0-9-]{2,64}+(?: ?(?:\.|[(\[{](?i:dot)[)\]}]| (?i:dot) ) ?[A-Za-z0-9-]{2,64}+){1,4}+",
    "ip": r"(?<![0-9A-Za-z:.])[0-9a-fA-F]{1,4}(?:::?[0-9a-fA-F]{1,4}){2,7}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z+.-])[0-9](?:[ -]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9+A-Za-z])(?<!\+[0-9]{1,3}[ .-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\"?[ ]{0,2}[=:][ ]{0,2}\"?[^\s\"',;]{6,}+|(?<![A-Za-z0-9_-])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
}
#: What a text must hold for a loose pattern to be tried, where that isn't a digit.
_LOOSE_GUARD = {"email": r"[(\[{](?i:at)[)\]}]| (?i:dot) ", "ip": "[0-9a-fA-F]:[0-9a-fA-F:]", "card": "[0-9][0-9 -]{11,}[0-9]", "secret": "[A-Za-z0-9_-]{16}|(?i:pass|pwd|secret|token|key)"}
KINDS = ("email", "ip", "card", "phone", "secret")
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
_GUARD = {"email": "@", "phone": r"\+"}


def _digits(value: Column) -> Column:
    return F.translate(value, "+ ().-", "")


def _passes(kind: str, value: Column, before: Column | None = None) -> Column:
    """The check of a base kind."""
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


#: Planted cases: kind, whether it is personal data, and SQL of what stands before it, of itself
#: and of what follows. ``s`` is a random hex string of 40, ``d`` one of 30 digits, ``w`` letters.
_PLANTED = (
    ("email", True, "'write to '", "concat(left(w, 5), '.', substring(w, 6, 4), ' (at) ', substring(w, 10, 6), ' (dot) com')", "' soon'"),
    ("email", True, "'contact: '", "concat(left(w, 6), '[at]', substring(w, 10, 6), '.example.org')", "'.'"),
    ("email", True, "'mail '", "concat(left(w, 4), ' at ', substring(w, 10, 6), ' dot net')", "','"),
    ("email", False, "'they met '", "concat('all at ', substring(w, 10, 6), '. ', left(w, 4))", "' later'"),
    ("email", False, "'was there '", "concat(left(w, 4), ' at ', substring(w, 10, 4), '. The')", "' rest'"),
    ("ip", True, "'from '", "concat(left(s, 4), ':', substring(s, 5, 4), ':', substring(s, 9, 3), '::', substring(s, 13, 4))", "' port'"),
    ("ip", True, "'host ['", "concat(left(s, 4), ':', substring(s, 5, 4), ':', substring(s, 9, 4), ':', substring(s, 13, 4), ':', substring(s, 17, 4), ':', substring(s, 21, 4), ':', substring(s, 25, 4), ':', substring(s, 29, 4))", "']'"),
    ("ip", False, "'at '", "concat(int(left(d, 2)) % 24, ':', 10 + int(substring(d, 3, 2)) % 50, ':', 10 + int(substring(d, 5, 2)) % 50)", "' sharp'"),
    ("ip", False, "'ratio '", "concat(left(d, 1), ':', substring(d, 2, 1), ':', substring(d, 3, 2))", "' of'"),
    ("card", True, "'paid by card '", "filter(transform(sequence(0, 9), i -> concat('3', substring(d, 1, 13), i)), x -> luhn_check(x))[0]", "' today'"),
    ("card", True, "'card no. '", "regexp_replace(filter(transform(sequence(0, 9), i -> concat('4', substring(d, 1, 11), i)), x -> luhn_check(x))[0], '^(....)(....)(.....)$', '$1 $2 $3')", "', exp'"),
    ("card", True, "' '", "filter(transform(sequence(0, 9), i -> concat('5', substring(d, 1, 14), i)), x -> luhn_check(x))[0]", "'.'"),
    ("card", False, "'isbn '", "filter(transform(sequence(0, 9), i -> concat('978-', substring(d, 1, 1), '-', substring(d, 2, 4), '-', substring(d, 6, 4), '-', i)), x -> not luhn_check(replace(x, '-', '')))[0]", "' ed.'"),
    ("card", False, "'serial '", "filter(transform(sequence(0, 9), i -> concat(substring(d, 1, 14), i)), x -> not luhn_check(x))[1]", "' of'"),
    ("card", False, "' '", "filter(transform(sequence(0, 9), i -> concat('8', substring(d, 1, 14), i)), x -> not luhn_check(x))[2]", "'.'"),
    ("phone", True, "'call '", "concat('(', substring(d, 1, 3), ') ', substring(d, 4, 3), '-', substring(d, 7, 4))", "' now'"),
    ("phone", True, "'Tel: '", "concat(substring(d, 1, 3), '-', substring(d, 4, 3), '-', substring(d, 7, 4))", "'.'"),
    ("phone", True, "'phone '", "concat(substring(d, 1, 3), '.', substring(d, 4, 3), '.', substring(d, 7, 4))", "','"),
    ("phone", True, "' '", "concat('(', substring(d, 1, 3), ') ', substring(d, 4, 3), '-', substring(d, 7, 4))", "' '"),
    ("phone", False, "'sums of '", "concat(substring(d, 1, 2), ' ', substring(d, 4, 3), ' ', substring(d, 7, 3))", "' and'"),
    ("phone", False, "'version '", "concat(substring(d, 1, 2), '.', substring(d, 4, 3), '.', substring(d, 7, 4))", "' of'"),
    ("phone", False, "'in '", "concat('19', substring(d, 1, 2), ' ', 1800 + int(substring(d, 3, 2)), ' ', 2000 + int(substring(d, 5, 2)))", "' there'"),
    ("secret", True, "''", "concat('token = \"', s, '\"')", "' was'"),
    ("secret", True, "''", "concat('password: ', left(w, 6), substring(d, 1, 3), '!')", "' then'"),
    ("secret", True, "''", "concat('password: ', w)", "' then'"),
    ("secret", True, "' '", "concat('AKIA', upper(left(s, 16)))", "' '"),
    ("secret", True, "'key '", "concat('sk-', left(s, 12), upper(left(w, 6)), substring(s, 13, 14))", "'.'"),
    ("secret", False, "' '", "concat(w, left(w, 6))", "' '"),
    ("secret", False, "' '", "concat(left(w, 6), '-', substring(w, 7, 5), '-', substring(w, 3, 9))", "', '"),
    ("secret", False, "' '", "upper(concat(w, '_', left(w, 4)))", "' '"),
    ("secret", False, "' '", "initcap(concat(w, substring(w, 2, 3 + int(left(d, 1)))))", "' and'"),
    ("secret", False, "'the '", "concat(left(w, 2), '-', substring(w, 3, 3 + int(left(d, 1))), '-', substring(w, 2, 2), '-', substring(w, 5, 3), '-', left(w, 6))", "' in'"),
    ("secret", False, "'on '", "concat('2024-05-', 10 + int(left(d, 1)), '-', left(w, 8))", "' '"),
    ("secret", False, "'see '", "concat(left(w, 5), '_', substring(w, 6, 7), '_', left(d, 4))", "' of'"),
)


def with_matches(docs: DataFrame, text: str, patterns: dict[str, str], needs: dict[str, str | None]) -> DataFrame:
    """``docs`` with a column of spans for each name of ``patterns``.

    Spans are leftmost and don't overlap; start and end count code points, end exclusive. A
    text in which what a pattern needs (a digit if nothing is named) isn't found isn't searched. Between two matches lies
    one piece of the split text, so positions are a running sum of lengths; it goes chunk by
    chunk, as appending to one array would cost the square of the matches.
    """
    names = list(patterns)
    guard = {n: F.col(text).rlike(needs[n] or "[0-9]") for n in names}
    out = docs.withColumns(
        {n: F.when(guard[n], F.arrays_zip(F.split(F.col(text), p, -1), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).cast("array<struct<p:string,v:string>>")) for n, p in patterns.items()}
    )
    out = out.withColumns({n: F.when(F.size(n) > 1, _chunks(F.col(n))) for n in names})
    return out.withColumns({n: F.coalesce(_running(F.col(n)), F.array().cast(_SPAN)) for n in names})


def _chunks(pairs: Column) -> Column:
    """Pieces of ``_CHUNK`` items, each with the first item of the next."""
    return F.transform(F.sequence(F.lit(0), ((F.size(pairs) - 1) / _CHUNK).cast("int")), lambda c: F.slice(pairs, c * _CHUNK + 1, F.lit(_CHUNK + 1)))


def _running(chunks: Column) -> Column:
    length = lambda x: F.coalesce(F.length(x), F.lit(0))

    def within(chunk: Column) -> Column:
        """(length of the chunk's texts, spans from its start); its last item is the next chunk's first."""
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))
        count = F.least(F.size(chunk), F.lit(_CHUNK))

        def add(acc: Column, pair: Column) -> Column:
            item, following = pair["a"], pair["b"]
            start = acc["at"] + length(item["p"])
            span = F.struct(
                start.alias("start"), (start + length(item["v"])).alias("end"), item["v"].alias("value"),
                F.right(item["p"], F.lit(CONTEXT)).alias("before"), F.left(following["p"], F.lit(CONTEXT)).alias("after"),
            )
            return F.struct((start + length(item["v"])).alias("at"), F.when(item["v"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

        pairs = F.arrays_zip(F.slice(chunk, 1, count), F.slice(chunk, 2, F.lit(_CHUNK))).cast("array<struct<a:struct<p:string,v:string>,b:struct<p:string,v:string>>>")
        return F.aggregate(pairs, zero, add)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<off:int,spans:{_SPAN}>>").alias("parts"))
    placed = F.aggregate(
        F.transform(chunks, within),
        zero,
        lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["parts"], F.array(F.struct(acc["at"].alias("off"), c["spans"].alias("spans")))).alias("parts")),
        lambda acc: acc["parts"],
    )
    moved = lambda part: F.transform(part["spans"], lambda s: F.struct((s["start"] + part["off"]).alias("start"), (s["end"] + part["off"]).alias("end"), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after")))
    return F.flatten(F.transform(placed, moved))


def _features(kind: str, span: Column) -> list[Column]:
    """Format and context of a candidate as small integers."""
    value, before, after = span["value"], span["before"], span["after"]
    n = F.length(value)
    share = lambda pattern: (8 * F.length(F.regexp_replace(value, pattern, "")) / n).cast("int")
    yes = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    return [
        F.lit(KINDS.index(kind)),
        F.least(n.cast("int"), F.lit(40)),
        share("[^0-9]"),
        share("[^A-Z]"),
        share("[^a-z]"),
        share("[A-Za-z0-9]"),
        F.least(F.length(_digits(F.regexp_replace(value, "[^0-9]", ""))).cast("int"), F.lit(24)),
        yes(value.rlike(r"^[A-Z]{3,5}[A-Z0-9]*[0-9]")),
        yes(value.rlike("[=:]")),
        yes(value.rlike(r"[0-9]{3}[ .-][0-9]{4}$")),
        yes(before.rlike(r"(?i)(?:tel|phone|call|fax|mobile|cell)\W{0,4}$")),
        yes(before.rlike(r"(?i)(?:card|visa|pay|paid|no)\W{0,4}$")),
        yes(before.rlike(r"(?i)(?:key|token|password|secret|auth)\W{0,4}$")),
        yes(value.rlike(r"(?i)^(?:password|passwd|pwd|secret|token|api|access)")),
        yes(value.rlike(r"(?i)dot|[(\[{]at|\.[a-z]+$")),
        F.coalesce(F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", "")), F.lit(False)).cast("int"),
        F.least(F.length(F.regexp_replace(F.regexp_replace(value, "[^0-9]+", "a"), "[0-9]+", "")).cast("int"), F.lit(12)),
        yes(before.rlike(r"[\s\"'(<\[=:]$") | (before == "")),
        yes(after.rlike(r"^[\s\"')>\].,;!?]") | (after == "")),
    ]


FEATURES = 19


def _candidates(spans: str, kind: str) -> Column:
    """Spans with their features."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *[x.alias(f"f{i}") for i, x in enumerate(_features(kind, s))]))


def _passing(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: _passes(kind, s["value"]))


def _of_kind(spans: str, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


@dataclass
class Trees:
    """Boosted trees of depth two over integer features, and thresholds of their sum by kind."""

    bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    # root (feature, at most), then for each side (feature, at most, value if so, value if not)
    trees: list[tuple] = field(default_factory=list)

    def score(self, f: list[Column]) -> Column:
        out = F.lit(self.bias)
        for (root, cut), *sides in self.trees:
            low, high = (F.when(f[g] <= c, a).otherwise(b) for g, c, a, b in sides)
            out = out + F.when(f[root] <= cut, low).otherwise(high)
        return out


def _histograms(rows: DataFrame, model: Trees, node: Column) -> dict[int, dict[tuple[int, int], tuple[float, float]]]:
    """(gradient, curvature) of the log loss by node, feature and value."""
    p = 1 / (1 + F.exp(-model.score([F.col(f"f{i}") for i in range(FEATURES)])))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"f{i}").alias("v")) for i in range(FEATURES)])).alias("c")
    sums = rows.select(node.alias("node"), (F.col("label") - p).alias("g"), (p * (1 - p)).alias("h"), cells).groupBy("node", "c.i", "c.v").agg(F.sum("g"), F.sum("h"))
    out: dict = {}
    for at, i, v, g, h in sums.collect():
        out.setdefault(at, {})[i, v] = (g, h)
    return out


def _best(cells: dict[tuple[int, int], tuple[float, float]]) -> tuple[int, int, float, float]:
    """The split (feature, at most) of most gain, and the values of both sides."""
    value = lambda g, h: RATE * g / (h + 1)
    best, found = -1.0, (0, 0, 0.0, 0.0)
    for i in range(FEATURES):
        own = sorted((v, g, h) for (j, v), (g, h) in cells.items() if j == i)
        total_g, total_h = sum(x[1] for x in own), sum(x[2] for x in own)
        left_g = left_h = 0.0
        for v, g, h in own:
            left_g, left_h = left_g + g, left_h + h
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1)
            if gain > best + 1e-9:
                best, found = gain, (i, v, value(left_g, left_h), value(right_g, right_h))
    return found


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Cases planted into about ``sample`` texts chosen by hash of the id: ``part, kind, label, text, start, end``.

    ``part`` is 0 for learning and 1 for calibration, by document. Each text gives two cases,
    which stand between its first and its next characters.
    """
    n = docs.count()
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.where(F.pmod(F.xxhash64("id", F.lit("chosen")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(n, 1))) + 1)
    texts = texts.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"), F.left("text", F.lit(200)).alias("ahead"), F.substring("text", 201, 200).alias("behind"))
    texts = texts.select("*", F.sha1(F.concat_ws("-", "id", "turn")).alias("s"))
    texts = texts.select("*", F.translate("s", "0123456789abcdef", "ghijklmnopqrstuv").substr(1, 15).alias("w"), F.expr("concat(lpad(pmod(xxhash64(s), 1000000000000000), 15, '4'), lpad(pmod(xxhash64(s, 1), 1000000000000000), 15, '7'))").alias("d"))
    cases = F.expr("array(" + ", ".join(f"struct('{kind}' as kind, {int(label)} as label, {lead} as lead, {value} as value, {tail} as tail)" for kind, label, lead, value, tail in _PLANTED) + ")")
    texts = texts.withColumn("case", F.element_at(cases, F.pmod(F.xxhash64("s", F.lit("case")), F.lit(len(_PLANTED))).cast("int") + 1))
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(2)).alias("part")
    # Written out in between, since what follows names these columns many times.
    texts = materialize(texts.select(part, "turn", "ahead", "behind", "case.*"), "pii-cases")
    ahead = F.concat("ahead", F.lit(" "), "lead")
    out = texts.select("part", "kind", "label", F.concat(ahead, "value", "tail", F.lit(" "), "behind").alias("text"), F.length(ahead).alias("start"), F.length(F.concat(ahead, "value")).alias("end"))
    return materialize(out, "pii-planted")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, precision: float = PRECISION) -> Trees:
    """Fit and calibrate the trees on cases planted into about ``sample`` texts of ``docs``.

    A candidate counts if it overlaps a case of its kind. A kind's threshold is the lowest score
    of a right one down to which ``precision`` of its held-out candidates are right. Without candidates of both labels,
    as in an empty table, nothing is added to the base spans.
    """
    rows, names = planted(docs, id_col, text_col, sample), {k: f"l_{k}" for k in LOOSE}
    found = _searched(rows, "text", {}, names).select("part", "kind", "label", "start", "end", F.array(*[F.struct(F.lit(k).alias("kind"), _candidates(n, k).alias("found")) for k, n in names.items()]).alias("each"))
    one = found.select("*", F.explode("each").alias("of")).where("of.kind = kind").select("part", "kind", "label", "start", "end", F.explode("of.found").alias("c"))
    rows = materialize(one.where("c.start < end and c.end > start").select("part", "kind", "label", *[f"c.f{i}" for i in range(FEATURES)]), "pii-sample")
    learn, held = rows.where("part = 0"), rows.where("part = 1")
    n, positive = learn.agg(F.count("*"), F.sum("label")).first()
    if not n or not positive or positive == n:
        return Trees()
    model = Trees(bias=math.log(positive / (n - positive)))
    for _ in range(TREES):
        root, cut, *_ = _best(_histograms(learn, model, F.lit(0))[0])
        below = _histograms(learn, model, F.when(F.col(f"f{root}") <= cut, 0).otherwise(1))
        model.trees.append(((root, cut), *(_best(below[side]) if side in below else (0, 0, 0.0, 0.0) for side in (0, 1))))
    score = F.round(model.score([F.col(f"f{i}") for i in range(FEATURES)]), 2).alias("score")
    right, seen = dict.fromkeys(KINDS, 0), dict.fromkeys(KINDS, 0)
    for value, kind, good, count in sorted(held.groupBy(score, "kind").agg(F.sum("label"), F.count("*")).collect(), reverse=True):
        right[kind], seen[kind] = right[kind] + good, seen[kind] + count
        if good and right[kind] >= precision * seen[kind]:
            model.thresholds[kind] = value - 0.005
    return model


def find_spans(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``base_spans`` and ``spans``: arrays of (kind, start, end).

    Both are ordered by kind as in ``KINDS``, then start. Base spans are all in ``spans``;
    those of the same place and kind stand once. A null text counts as empty and has none;
    each row is searched for itself, so repeated rows get the same spans, and no rows give
    none. Long texts are searched whole; matches are numbered chunk by chunk. No column of the
    caller is replaced: the new ones are the last two, and one whose name is taken gets a
    ``_`` before it.
    """
    base_spans, spans = fresh(docs, "base_spans", "spans")
    text, *names = fresh(docs, "_text", *[f"b_{k}" for k in BASE], *[f"l_{k}" for k in LOOSE])
    own = docs.columns
    found = docs.select(*own, F.coalesce(F.col(text_col), F.lit("")).alias(text))
    base_names, loose_names = dict(zip(BASE, names, strict=False)), dict(zip(LOOSE, names[len(BASE) :], strict=True))
    loose_names = {k: n for k, n in loose_names.items() if k in model.thresholds}
    adds = bool(loose_names)
    found = _searched(found, text, base_names, loose_names)
    found = found.withColumns({n: _passing(n, k) for k, n in base_names.items()})
    if adds:
        found = found.withColumns({n: _candidates(n, k) for k, n in loose_names.items()})

        def chosen(kind: str) -> Callable[[Column], Column]:
            return lambda s: model.score([s[f"f{i}"] for i in range(FEATURES)]) >= model.thresholds[kind]

        found = found.withColumns({n: F.filter(n, chosen(k)) for k, n in loose_names.items()})
    every = []
    for kind in KINDS:
        lists = [_of_kind(names[kind], kind) for names in (base_names, loose_names) if kind in names and (adds or names is base_names)]
        every += [F.array_sort(F.array_distinct(F.concat(*lists)))] if len(lists) > 1 else lists
    return found.select(*own, F.concat(*[_of_kind(n, k) for k, n in base_names.items()]).alias(base_spans), F.concat(*every).alias(spans))


def _searched(docs: DataFrame, text: str, base: dict[str, str], loose: dict[str, str]) -> DataFrame:
    """``docs`` with the matches of both sets of patterns under the given names."""
    patterns = {n: BASE[k] for k, n in base.items()} | {n: LOOSE[k] for k, n in loose.items()}
    needs = {n: _GUARD.get(k) for k, n in base.items()} | {n: _LOOSE_GUARD.get(k) for k, n in loose.items()}
    return with_matches(docs, text, patterns, needs)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``docs`` of :func:`find_spans` with ``redacted`` (which it must not have): spans replaced by ``[KIND]``.

    Of overlapping spans the first by start counts, the longer one at equal starts.
    """
    spans = F.array_sort(F.transform(spans_col, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def add(acc: Column, s: Column) -> Column:
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct((-s["less"]).alias("at"), out.alias("out")))

    return docs.withColumn("redacted", F.aggregate(spans, zero, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))
