import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.llm import embdedup

from .edge import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def cloud(seed, groups, members, spread, dimension=32):
    rng = np.random.RandomState(seed)
    centres = rng.randn(groups, dimension)
    return [(centres[g] + spread * rng.randn(dimension)).astype(np.float32) for g in range(groups) for _ in range(members)]


def brute(rows):
    good = {}
    for i, v, label in rows:
        x = None if v is None or label is None or any(c is None for c in v) else np.array(v, float)
        if x is not None and np.isfinite(x).all() and x.any():
            good[i] = (x / np.linalg.norm(x), label)
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= 0.93]
    found = components([r[0] for r in rows], links)
    return {i: (sum(i in e for e in links), found[i], found[i] == i) for i, *_ in rows}


@pytest.mark.parametrize("block", [512, 8])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embdedup, "BLOCK", block)
    vectors = cloud(1, 12, 12, 0.02) + [cloud(1, 12, 12, 0.02)[5]] * 15
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None] * 32, 1), (904, rows[0][1], None), (905, [float("inf")] + [0.0] * 31, 1), (906, [], 1), (907, rows[0][1][:31], 0), (908, [1e-30 * x for x in rows[0][1]], 0), (909, [-0.0] * 31 + [1.0], 0), (910, [0.0] * 31 + [1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("x"), "weight": F.lit("x"), "id": F.lit("x"), "least": F.lit(1)})
    found = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embdedup.similar_vectors(df).collect()}
    assert found == brute(rows)


def test_recall_at_the_threshold():
    rng = np.random.RandomState(0)
    for n, d in ((10**5, 64), (10**9, 64), (10**5, 384)):
        plan, m = embdedup.plan_for(n, d), 1000
        x = rng.randn(m, d)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.randn(m, d)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        keys = [embdedup.table_keys(v, np.zeros(m, np.uint64), plan) for v in (x, y)]
        assert (keys[0][:, :, None] == keys[1][:, None, :]).any(axis=(1, 2)).mean() >= 0.95


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [1.0, 0.01], 0)]
    found = sorted((str(r["id"]), r["n_links"], r["component_id"], r["kept"]) for r in embdedup.similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == [("1", 2, 1, True), ("1", 2, 1, True), ("2", 2, 1, False), ("None", 0, None, False)]


def test_empty_table(spark):
    assert embdedup.similar_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
