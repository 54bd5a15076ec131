import hashlib
from collections import defaultdict

from seqlake.llm import common
from seqlake.llm.exactdedup import drop_exact_copies, exact_groups

from .edge import CLASHING, ROWS, docs, empty, lower


def expected():
    groups = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[hashlib.sha256(lower(text).encode()).hexdigest()].append(doc_id)
    out = []
    for digest, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = ids.index(keep)
        out += [(i, keep, len(ids), at == first, digest) for at, i in enumerate(ids)]
    return sorted(map(str, out))


def test_against_brute_force(spark):
    names = ["id", "keep_id", "group_size", "kept", "sha256"]
    assert sorted(map(str, map(tuple, exact_groups(docs(spark), digest_all=True).select(*names).collect()))) == expected()
    without = lambda rows: sorted(str(eval(r)[:4]) for r in rows)  # noqa: E731, S307
    assert sorted(map(str, map(tuple, exact_groups(docs(spark)).select(*names[:4]).collect()))) == without(expected())


def test_kept_rows_have_all_columns(spark):
    kept = drop_exact_copies(docs(spark))
    assert kept.columns == docs(spark).columns
    assert all(r[c] == "x" for r in kept.collect() for c in CLASHING)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["2", "4", "5", "6", "7", "8", "9", "10", "11"])


def test_empty_table(spark):
    assert exact_groups(empty(spark)).count() == 0
    assert drop_exact_copies(empty(spark)).count() == 0


def test_marks_by_chance_change_nothing(spark, monkeypatch):
    """With a table of marks that is full, every row takes the exact way."""
    monkeypatch.setattr(common, "MARK_WORDS", 1)
    rows = [(i, f"text {i % 300}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in drop_exact_copies(df).collect()) == list(range(200, 500))


def test_only_colliding_texts_are_hashed(spark):
    same_start = "x" * 100
    rows = [(1, "alone"), (2, "equal length a" + "y"), (3, same_start + "a"), (4, same_start + "b"), (5, "TWICE"), (6, "twice"), (7, "z" * 20_000_000)]
    found = {r["id"]: (r["keep_id"], r["sha256"] is None) for r in exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[5] == found[6] == (6, False)
    assert found[1][1] and found[2][1] and found[7][1]
    assert found[3] == (3, False) and found[4] == (4, False)
