"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

A vector is turned by sign flips and Hadamard transforms, three times over; the axis that it
is then closest to, with its sign, is one hash. Several hashes make the key of a table, and
each vector also probes the key in which its least certain hash takes the runner-up. Vectors
that share a key are compared exactly in double precision. The numbers of hashes and tables
follow from the number of vectors and the wanted recall at the threshold.

Equal vectors are one class with a multiplicity. Keys that one class has alone go no further.
Buckets beyond ``BLOCK`` are cut into blocks that meet two by two in different tasks; pairs
are counted where they are found and links leave a block as a spanning forest. A pair that
shares several keys counts at the first only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

THRESHOLD = 0.93
#: Wanted recall of pairs at the threshold, and the share of such pairs that agree in one
#: hash or its probe (0.88 to 0.68 measured for one to four hashes, 0.67 at 384 dimensions).
RECALL, AGREE = 0.98, 0.70
PROBES = 2
#: Vectors of a block; two of them meet in a task.
BLOCK = 512


@dataclass(frozen=True)
class Plan:
    hashes: int
    tables: int
    seed: int = 20_240_229


def plan_for(vectors: int, dimension: int, recall: float = RECALL) -> Plan:
    """So many hashes that a bucket of unrelated vectors stays small, and tables for the recall."""
    hashes = max(1, round(math.log(max(2, vectors)) / math.log(2 * max(2, dimension))))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - AGREE**hashes))
    return Plan(hashes, max(2, tables))


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def table_keys(vectors: np.ndarray, salt: np.ndarray, plan: Plan) -> np.ndarray:
    """Keys [vector, table * PROBES + probe] of unit vectors; ``salt`` keeps labels apart."""
    size = 1 << max(1, (vectors.shape[1] - 1).bit_length())
    padded = np.zeros((len(vectors), size))
    padded[:, : vectors.shape[1]] = vectors
    out = np.empty((len(vectors), plan.tables * PROBES), np.int64)
    rows = np.arange(len(vectors))
    for t in range(plan.tables):
        codes, runners, gaps = [], [], []
        for k in range(plan.hashes):
            signs = np.random.RandomState((plan.seed + 7919 * t + 104_729 * k) % 2**32).choice([-1.0, 1.0], (3, size))
            x = padded
            for s in signs:
                x = _hadamard(x * s) / math.sqrt(size)
            both = np.concatenate((x, -x), axis=1)
            top = both.argmax(axis=1)
            best = both[rows, top]
            both[rows, top] = -np.inf
            second = both.argmax(axis=1)
            codes.append(top)
            runners.append(second)
            gaps.append(best - both[rows, second])
        codes, runners, weak = np.array(codes), np.array(runners), np.array(gaps).argmin(axis=0)
        probed = codes.copy()
        probed[weak, rows] = runners[weak, rows]
        for p, code in enumerate((codes, probed)):
            key = salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t)
            for c in code:
                key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c.astype(np.uint64)
            key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            out[:, t * PROBES + p] = (key ^ (key >> np.uint64(29))).view(np.int64)
    return out


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as unit rows in double precision, shorter ones filled with zeros."""
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), lengths.max(initial=1)))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    # Scaled first, so that squares of very large or small components neither overflow nor vanish.
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _hash(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(2))
            keys = table_keys(vectors, batch.column(1).to_numpy().view(np.uint64), plan)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))], ["node", "keys"])

    return run


def _compare(plan: Plan, threshold: float):
    """Rows sorted by block -> (node, links, other): links found, and an edge of the forest."""

    def found(group: np.ndarray, key: np.ndarray, chunk: np.ndarray, cross: np.ndarray, node: np.ndarray, weight: np.ndarray, vectors: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        counts = np.zeros(len(node), np.int64)
        left, right = [], []
        at, step = np.arange(len(group)), 0
        shaped = keys.reshape(len(node), plan.tables, PROBES)
        while len(at):
            step += 1
            at = at[at + step < len(group)]
            at = at[group[at] == group[at + step]]
            # In a block of two chunks only pairs between them count; each chunk has its own.
            one = at[~cross[at] | (chunk[at] != chunk[at + step])]
            for part in np.array_split(one, max(1, len(one) // 100_000)):
                x, y = part, part + step
                near = (vectors[x] * vectors[y]).sum(axis=1) >= threshold
                x, y = x[near], y[near]
                if not len(x):
                    continue
                same = shaped[x][:, :, :, None] == shaped[y][:, :, None, :]
                table = same.any(axis=(2, 3)).argmax(axis=1)
                rows = np.arange(len(x))
                shared = np.where(same[rows, table].any(axis=2), shaped[x, table], np.iinfo(np.int64).max).min(axis=1)
                first = shared == key[x]
                x, y = x[first], y[first]
                np.add.at(counts, x, weight[y])
                np.add.at(counts, y, weight[x])
                left.append(x)
                right.append(y)
        x, y = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))
        # A forest: every row ends at the least row of its part.
        root = np.arange(len(node))
        while len(x):
            low = np.minimum(root[x], root[y])
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            root = root[root]
            if (root[x] == root[y]).all():
                break
        keep = (counts > 0) | (root != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(counts[keep]), pa.array(node[root[keep]])], ["node", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def worked(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            key, low, high = (rows[c].to_numpy() for c in ("key", "low", "high"))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            keys = rows["keys"].combine_chunks().flatten().to_numpy().reshape(len(key), -1)
            return found(np.cumsum(new), key, rows["chunk"].to_numpy(), low != high, rows["node"].to_numpy(), rows["weight"].to_numpy(), _matrix(rows["vector"].combine_chunks()), keys)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            key, low, high = (held[c].to_numpy() for c in ("key", "low", "high"))
            last = np.flatnonzero((key != key[-1]) | (low != low[-1]) | (high != high[-1]))
            if len(last):  # what lies before the last block is whole
                yield worked(held.slice(0, last[-1] + 1))
                held = held.slice(last[-1] + 1)
        if held is not None:
            yield worked(held)

    return run


def similar_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row: ``id, n_links, component_id, kept``.

    Rows are linked if their labels are equal and not null (with ``label_col`` None: always),
    their vectors have the same length and the cosine in double precision is at least
    ``threshold``; pairs are found with about the wanted ``recall``, and none below the
    threshold is. ``component_id`` is the smallest id that links reach, ``kept`` says whether
    it is the row's own. Vectors that are null, zero or hold null or non-finite components
    link with nothing, and neither do rows whose id is null (null component, not kept).
    Repeated rows are vectors of their own; an empty table gives no rows.
    """
    label = F.col(label_col) if label_col else F.lit(0)
    given = rows.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).alias("vector"))
    good = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    plain = F.transform("vector", lambda x: F.when(x == 0, x * 0 + F.abs(x)).otherwise(x))  # -0.0 is 0.0
    tagged = given.withColumn("node", F.when(good, F.xxhash64("label", plain)))
    classes = materialize(
        tagged.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("vector").alias("vector")),
        "emb-classes",
    )
    many, longest = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    plan = plan_for(many, longest or 2, recall)
    salted = classes.select("node", F.xxhash64("label", F.size("vector")).alias("salt"), "vector")
    hashed = materialize(salted.mapInArrow(_hash(plan), "node long, keys array<long>"), "emb-keys")
    entries = hashed.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    shared = materialize(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "emb-buckets")
    met = materialize(entries.join(shared, "key"), "emb-met")
    chunks = F.ceil(F.col("size") / BLOCK)
    placed = met.withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64("node"), chunks)})
    blocks = placed.select("node", "key", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("with"))
    blocks = blocks.select("node", "key", "chunk", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"))
    full = blocks.join(classes.select("node", "weight", "vector"), "node").join(hashed, "node")
    ready = full.select("key", "low", "high", "chunk", "node", "weight", "vector", "keys").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    pairs = materialize(ready.mapInArrow(_compare(plan, threshold), "node long, links long, other long"), "emb-pairs")
    links = pairs.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(pairs.select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = classes.select("node", "least", "weight").join(links, "node", "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = materialize(known, "emb-known")
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    result = materialize(known.join(names, "component").select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "emb-result")
    slim = materialize(tagged.select("id", "node"), "emb-rows")
    joined = slim.join(result, "node", "left")
    component = F.coalesce("component_id", "id")
    return joined.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
