"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rounds after which something is wrong: their number grows with the logarithm of the nodes.
MAX_ROUNDS = 60


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, least of u and its neighbours); ``edges`` go one way."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = materialize(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-both")
    least = materialize(_smallest(both), "cc-least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v."""
    least = materialize(_smallest(edges), "cc-least")
    joined = edges.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges ``a, b`` (longs): ``node, component`` for every node that has an edge.

    ``component`` is the smallest node that can be reached. Loops and repeated edges add
    nothing; an edge with a null end is none. A node with very many edges costs each task one
    row in the sums and a join that AQE splits. Tables written between the rounds cut lineage.
    """
    valid = edges.where("a is not null and b is not null and a <> b")
    state = materialize(valid.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = materialize(_small_star(materialize(_large_star(state), "cc-large")), "cc-small")
        found = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == before or not found[0]:
            break
        before = found
    else:
        raise RuntimeError("components didn't settle")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
