import pickle
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqlake.llm import jaccard
from seqlake.llm.components import connected_components
from seqlake.llm.shingles import shingle_sets

from .edge import ROWS, components, docs, empty, shingles


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB é\n\t\x0b\x1c", max_size=60), min_size=1, max_size=8))
def test_shingles(texts):
    found = {}
    for first, sizes, hashes in shingle_sets([t.encode() for t in texts]):
        for i, part in enumerate(np.split(hashes, np.cumsum(sizes)[:-1])):
            found[first + i] = set(part.tolist())
    for i, a in enumerate(texts):
        assert len(found[i]) == len(shingles(a))
        for j, b in enumerate(texts):
            assert len(found[i] & found[j]) == len(shingles(a) & shingles(b))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(sets, links).items()}


def families():
    """Near copies on both sides of the threshold, exact copies, and a passage that many share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = []
    for family in range(6):
        base = [word() for _ in range(rng.choice((30, 80, 150)))]
        for copy in range(25):
            words = list(base)
            for _ in range(copy // 3 if family % 2 else 1):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows), " ".join(words if copy % 5 else base)))
    for _ in range(60):
        rows.append((len(rows), " ".join([word() for _ in range(rng.randint(5, 60))] + passage)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("task_rows", "rounds"), [(2_000_000, 2), (50, 0)])
def test_against_brute_force(spark, monkeypatch, task_rows, rounds):
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "LISTED", 256 if rounds else 4)
    monkeypatch.setattr(jaccard, "TASK_ROWS", task_rows)
    rows = families()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r["id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(df).collect()}
    assert found == brute(rows)


def test_edge_rows(spark):
    found = sorted(str((r["id"], r["n_shingles"], r["component_id"])) for r in jaccard.similar_components(docs(spark)).collect())
    expected = brute([r[:2] for r in ROWS if r[0] is not None])
    assert found == sorted(str((i, len(shingles(t)), None if i is None else expected[i][1])) for i, t, *_ in ROWS)
    kept = jaccard.drop_similar(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "7", "9", "10", "11", "None", "None"])


def test_rows_that_share_an_id_are_one(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f g h")
    df = spark.createDataFrame([(5, a), (5, b), (9, a), (3, b), (7, c)], "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in jaccard.similar_components(df).collect()} == {5: 3, 9: 3, 3: 3, 7: 7}


def test_long_texts(spark):
    """Texts beyond a buffer have the sets that they have word by word, and are linked."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400_000)]
    long = " ".join(words) + " " + "x" * 1_500_000
    near = " ".join(words[:390_000])
    [(_, sizes, hashes)] = shingle_sets([long.encode()])
    assert sizes.tolist() == [len(shingles(long))] and len(np.unique(hashes)) == len(hashes)
    df = spark.createDataFrame([(1, long), (2, near), (3, "y " + near), (4, "short text")], "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in jaccard.similar_components(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_filters_let_every_link_pass(spark):
    rows = [(i, t) for i, t in families() if i % 3]
    sketch = jaccard.Sketch(np.full(1 << jaccard.CELL_BITS - 2, 255, np.uint8), np.zeros(1 << jaccard.COARSE_BITS, np.uint8))
    [(_, sizes, hashes)] = shingle_sets([t.encode() for _, t in rows])
    columns = jaccard._signatures(sizes, hashes, sketch, 75)
    sets = [shingles(t) for _, t in rows]
    unlike = 0
    df = spark.createDataFrame([(i, int(sizes[i]), *[int(c[i]) for c in columns]) for i in range(len(rows))], ["i", "n", *jaccard._SIGNATURE])
    passing = {(r[0], r[1]) for r in df.alias("x").join(df.alias("y"), jaccard._filters(75, "x", "y")).select("x.i", "y.i").collect()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert 100 * len(a & b) < 75 * len(a | b) or (i, j) in passing
            unlike += (i, j) not in passing
    assert unlike > 0.5 * len(sets) ** 2


@pytest.mark.parametrize("operator", [jaccard.similar_components, jaccard.drop_similar])
def test_texts_without_neighbours_leave_no_rows(spark, monkeypatch, operator):
    """With a sketch that a large corpus has filled up, too, only what may have a neighbour is written out."""
    full = jaccard.Sketch(np.full(1 << jaccard.CELL_BITS - 2, 255, np.uint8), np.zeros(1 << jaccard.COARSE_BITS, np.uint8))
    monkeypatch.setattr(jaccard, "build_sketch", lambda parts: full)
    monkeypatch.setattr(jaccard, "TASK_ROWS", 2000)
    written, real = {}, jaccard.materialize

    def counted(df, label):
        out = real(df, label)
        if label == "jac-found":
            written[label] = {r["id"] for r in out.select("id").distinct().collect()}
        return out

    monkeypatch.setattr(jaccard, "materialize", counted)
    rng = random.Random(4)
    texts = [[f"{rng.randrange(10**6)}" for _ in range(80)] for _ in range(150)]
    near = [texts[0][:-1], texts[0][1:], texts[1][2:]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts + near + [texts[2]])]
    found = operator(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expected = brute(rows)
    if operator is jaccard.similar_components:
        assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected
    else:
        assert {r["doc_id"] for r in found} == {i for i, (_, c) in expected.items() if i == c}
    assert {0, 1, 150, 151, 152} <= written["jac-found"] and len(written["jac-found"]) <= 10


def test_driver_holds_no_whole_sketch(spark):
    """Of few tokens the driver has few bytes; the sketch that workers load has all their cells."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(50)] + [(99, " ".join(f"w7x{k}" for k in range(31)))]
    parts = jaccard.materialize(spark.createDataFrame(rows, "id long, text string").mapInArrow(jaccard._cells(jaccard.WIDTH), "chunk int, cells binary"), "test-cells")
    jaccard.build_sketch(parts)  # imports and caches aren't counted
    tracemalloc.start()
    stored = pickle.dumps(jaccard.build_sketch(parts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    sketch = pickle.loads(stored)
    expected = np.zeros(1 << jaccard.CELL_BITS, np.uint8)
    for _, _, hashes in shingle_sets([t.encode() for _, t in rows], jaccard.WIDTH):
        np.add.at(expected, (jaccard.mix(hashes, 7) >> np.uint64(64 - jaccard.CELL_BITS)).astype(np.int64), 1)
    assert (sketch.cells == jaccard._quads(np.minimum(expected, 2))).all() and len(sketch.coarse) == 1 << jaccard.COARSE_BITS


def test_empty_table(spark):
    assert jaccard.similar_components(empty(spark)).count() == 0
    assert jaccard.drop_similar(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    df = spark.createDataFrame([*edges, (7, 7), (None, 1), edges[0]], "a long, b long")
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    expected = components({n for e in edges for n in e}, edges)
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == {n: expected[n] for n in nodes}
    assert connected_components(df.limit(0)).count() == 0
