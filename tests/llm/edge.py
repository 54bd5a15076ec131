"""A documents table with nulls, empty and long texts, ties, repeats and clashing columns."""

import re

LONG = "word " * 30_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "s"),
    (2, "the QUICK brown fox jumps over the lazy dog", "en", None),
    (2, "the QUICK brown fox jumps over the lazy dog", "en", None),
    (3, "", "fr", "s"),
    (4, None, None, None),
    (5, " \n\t ", "fr", "s"),
    (6, LONG, "en", "s"),
    (7, "two words", None, "s"),
    (8, "Two  words", "de", "s"),
    (None, "The quick brown fox jumps over the lazy dog", "en", "s"),
    (None, None, None, None),
    (9, "1234 é😀 ÀÉ", "fr", "s"),
    (10, "!!!", "en", "s"),
    (11, "² ½ ①", "en", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Columns that operators use inside or return.
CLASHING = ["id", "sha256", "kept", "length", "_norm", "rate", "copies", "tokens", "n", "component", "_id", "_loss", "_digest", "_found", "spans", "_text", "score", "token"]


def docs(spark, clash=True):
    df = spark.createDataFrame(ROWS, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING}) if clash else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}
