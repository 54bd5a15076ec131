"""N-gram Jaccard join: prefix filters under several global token orders, then verification.

A document is the set of its word shingles. One that is linked with another shares t of its tokens
with it, so a document with more tokens that no other has is none's neighbour, whatever the order.
Half of all tokens (by hash) are packed, four bytes each, and dealt by hash to find those; only what
is left, one text a class of equal sets, goes through the steps below, so their tables grow with
the copies in a corpus and not with its size.

Pairs of Jaccard similarity t share a token in the first n - ceil(t n) + 1 tokens of each, under any
global order. The orders here put rare tokens first, so that texts without a near copy have no
prefix token that another text could share. How rare a token is comes from two sketches of fixed
size over what is left: cells that exactly one token occurrence of it fell into (that token is in no
other document), and coarse counts that push frequent tokens to the end. Sketches only choose the
orders: any order gives right results. Ties are broken by another hash in each order.

Candidates share a prefix token under the first order. Before a text is looked at, a candidate
must pass the filters of all orders together: sizes, prefix tokens under each other order (as
256 bits each, which two prefixes with a common token can't have disjoint), and parities of 512
cells of the whole sets (the cells that differ are at most the tokens that differ). What is left
is verified exactly.

Documents that share a prefix token aren't paired with each other. Those of a token are linked to
one of them, a row each, and verified links give components. Then stars around other documents
join what lies in different components. What still does is compared across components alone, a
token's largest component with what lies outside it, where all filters hold and the token is the
first that both have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, fresh, marks, materialize, prepare, tidy, with_mark
from .components import connected_components
from .shingles import mix, shingle_sets
from .textbuf import slices

WIDTH, PERCENT, ORDERS = 5, 75, 3
#: log2 of the cells of the sketch of single tokens (2 bits each: 64 MB) and of the sketch of
#: frequent ones (8 bits each: 1 MB). Both are broadcast; their size doesn't grow.
CELL_BITS, COARSE_BITS = 28, 20
#: While they are added up, sketches lie in so many rows each.
_CHUNKS = 256
#: Rows of a chunk that one task adds up.
_CHUNK_ROWS = 256
_PROFILE = "id long, n long, h1 long, h2 long, bucket int, part long, marks binary, owners binary"
#: Tokens that a task holds before it hands on a sketch, or a part, of them.
TASK_ROWS = 1_000_000
#: One of 2^SAMPLE_BITS tokens is looked up to find documents without neighbours, in 2^BUCKET_BITS buckets.
SAMPLE_BITS, BUCKET_BITS = 1, 9
#: Rounds of stars over what lies in different components before it is compared.
STAR_ROUNDS = 1
#: Open tokens of a document up to which pairs are told apart by their first common one. Pairs
#: of longer documents come once a token, and are made distinct later.
LISTED = 256
#: Longs of the parities, and of the prefix tokens of each order but the first.
_PARITIES, _BITS = 8, 4
_SIGNATURE = [f"p{i}" for i in range(_PARITIES)] + [f"q{j}{i}" for j in range(1, ORDERS) for i in range(_BITS)]


class Sketch:
    """Cells with one occurrence (1) or more (2), and log2 of coarse counts over their mean."""

    def __init__(self, cells: np.ndarray, coarse: np.ndarray):
        self.cells, self.coarse = cells, coarse

    def __getstate__(self) -> tuple[bytes, bytes]:
        # Broadcast files lie on the disk of every executor; sparse sketches are small there.
        return zstandard.compress(self.cells.tobytes(), 1), zstandard.compress(self.coarse.tobytes(), 1)

    def __setstate__(self, state: tuple[bytes, bytes]) -> None:
        self.cells, self.coarse = (np.frombuffer(zstandard.decompress(x), np.uint8) for x in state)

    def keys(self, hashes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in the order, whether the token can be in another document) of each token."""
        cell = mix(hashes, 7) >> np.uint64(64 - CELL_BITS)
        shared = ((self.cells[cell >> np.uint64(2)] >> (2 * (cell & np.uint64(3))).astype(np.uint8)) & 3) != 1
        level = self.coarse[mix(hashes, 8) >> np.uint64(64 - COARSE_BITS)].astype(np.uint64)
        rank = np.where(shared, level + np.uint64(1), np.uint64(0))
        return (rank << np.uint64(58)) | (mix(hashes, 20 + order) >> np.uint64(6)), shared


class PackedSketch:
    """A sketch as the driver has it: compressed chunks of cells, and log2 of coarse counts.

    Pickled, it is loaded as a :class:`Sketch`, so that only workers hold all cells.
    """

    def __init__(self, chunks: dict[int, bytes], coarse: np.ndarray):
        self.chunks, self.coarse = chunks, coarse

    def __reduce__(self):
        return _whole, (self.chunks, zstandard.compress(self.coarse.tobytes(), 1))


def _whole(chunks: dict[int, bytes], coarse: bytes) -> Sketch:
    cells = np.zeros((1 << CELL_BITS) // 4, np.uint8)
    width = len(cells) // _CHUNKS
    for c, blob in chunks.items():
        cells[c * width : (c + 1) * width] = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return Sketch(cells, np.frombuffer(zstandard.decompress(coarse), np.uint8))


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    return (percent * n + 99) // 100


def _prefixes(sizes: np.ndarray, hashes: np.ndarray, sketch: Sketch, order: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set index, token, place) of the prefix tokens that another document could have, and how
    many of each set's tokens another could have."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    key, shared = sketch.keys(hashes, order)
    by = np.argsort(key)
    by = by[np.argsort(owner[by].astype(np.uint32), kind="stable")]
    rank = np.arange(len(by)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    length = sizes - least_overlap(sizes, percent) + 1
    taken = (rank < length[owner]) & shared[by]
    take = by[taken]
    return owner[take], hashes[take], rank[taken], np.bincount(owner, weights=shared, minlength=len(sizes)).astype(np.int64)


def _digests(sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of scrambled hashes: equal sets have equal ones."""
    first = np.concatenate(([0], np.cumsum(sizes)))
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes, s)))) for s in (11, 12)]
    return tuple((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)


def _texts(column: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "replace") if t else b"" for t in column.to_pylist()]


def _pack(numbers: np.ndarray) -> bytes:
    """uint32 numbers, byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True) if len(numbers) else b""


def _unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint32)
    size = zstandard.frame_content_size(blob)
    planes = np.frombuffer(pa.decompress(blob, size, codec="zstd"), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def _firsts(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether each set is the first of those equal to it."""
    keep = np.zeros(len(h1), bool)
    keep[np.unique(np.stack([h1, h2]), axis=1, return_index=True)[1]] = True
    return keep


def _part(tokens: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, marks, owners) of the sampled tokens: 32 bits of each hash, ascending, and its owner."""
    key = mix(tokens, 9)
    own = np.flatnonzero(key >> np.uint64(64 - SAMPLE_BITS) == 0)
    own = own[np.argsort(key[own])]
    key, owner = key[own], owner[own]
    # That a token is in several sets is said by two of its rows.
    keep = np.ones(len(key), bool)
    keep[2:] = key[2:] != key[:-2]
    key, owner = key[keep], owner[keep].astype(np.uint32)
    width = 64 - SAMPLE_BITS - BUCKET_BITS
    cut = np.searchsorted(key, np.arange(1, 1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(width))
    low = (key >> np.uint64(width - 32)).astype(np.uint32)
    for c, (marks_, owners) in enumerate(zip(np.split(low, cut), np.split(owner, cut), strict=True)):
        if len(marks_):
            yield c, _pack(np.diff(marks_, prepend=np.uint32(0))), _pack(owners)


def _profile(width: int, percent: int):
    """Rows of documents (id, n, h1, h2), of buckets of parts (bucket, part, marks, owners) and of
    parts (part, marks: ids, owners: how many tokens that no other set has rule out a link)."""
    names = ["id", "n", "h1", "h2", "bucket", "part", "marks", "owners"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        part = TaskContext.get().partitionId() << 32

        def packed() -> Iterator[pa.RecordBatch]:
            sizes = np.concatenate([x[1] for x in held])
            rows = [(-1, np.concatenate([x[0] for x in held]).tobytes(), _pack((sizes - least_overlap(sizes, percent) + 1).astype(np.uint32)))]
            rows += _part(np.concatenate([x[2] for x in held]), np.repeat(np.arange(len(sizes)), sizes))
            k = len(rows)
            buckets, first, second = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64())] * 4 + [pa.array(buckets, pa.int32()), pa.array([part] * k, pa.int64()), pa.array(first, pa.binary()), pa.array(second, pa.binary())], names)

        for batch in slices(batches):
            ids = batch.column(0)
            for first, sizes, hashes in shingle_sets(_texts(batch.column(1)), width):
                h1, h2 = _digests(sizes, hashes)
                k = len(sizes)
                own = ids.slice(first, k)
                yield pa.RecordBatch.from_arrays([own, pa.array(sizes, pa.int64()), pa.array(h1), pa.array(h2), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), *[pa.nulls(k, pa.binary())] * 2], names)
                # Equal sets of this buffer count once: their copies are the same class anyway.
                keep = (sizes > 0) & own.is_valid().to_numpy(zero_copy_only=False)
                keep[keep] = _firsts(h1[keep], h2[keep])
                if keep.any():
                    held.append((own.filter(pa.array(keep)).to_numpy(zero_copy_only=False).astype(np.int64), sizes[keep], hashes[np.repeat(keep, sizes)]))
                if sum(len(x[2]) for x in held) >= TASK_ROWS:
                    yield from packed()
                    held, part = [], part + 1
        if held:
            yield from packed()

    return run


def _alone(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's rows (part, marks, owners): how many tokens each owner has that no other has."""
    owners = [_unpack(blob) for blob in rows["owners"]]
    first = np.concatenate(([0], np.cumsum([int(x.max()) + 1 for x in owners])))
    tokens = np.concatenate([np.cumsum(_unpack(blob), dtype=np.uint64) << np.uint64(32) | (x + np.uint64(at)) for blob, x, at in zip(rows["marks"], owners, first, strict=False)])
    tokens.sort()
    again = tokens[1:] >> np.uint64(32) == tokens[:-1] >> np.uint64(32)
    alone = np.ones(len(tokens), bool)
    alone[1:] &= ~again
    alone[:-1] &= ~again
    n = np.bincount((tokens[alone] & np.uint64(2**32 - 1)).astype(np.int64), minlength=first[-1]).astype(np.uint32)
    return pd.DataFrame({"part": rows["part"], "marks": None, "owners": [_pack(x) for x in np.split(n, first[1:-1])]})


def _left(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a part's rows (its ids and limits, and counts by bucket): the ids of fewer lone tokens than their limit."""
    listed = rows["marks"].notna()
    [(ids, limits)] = rows.loc[listed, ["marks", "owners"]].itertuples(index=False)
    limits = _unpack(limits)
    n = np.zeros(len(limits), np.int64)
    for blob in rows.loc[~listed, "owners"]:
        counts = _unpack(blob)
        n[: len(counts)] += counts
    return pd.DataFrame({"id": np.frombuffer(ids, np.int64)[n < limits]})


def _neighboured(profile: DataFrame) -> DataFrame:
    """Ids that may have a neighbour: of a linked set, ``percent`` of the tokens are in another one."""
    schema = "part long, marks binary, owners binary"
    counts = profile.where("bucket >= 0").select("bucket", "part", "marks", "owners").groupBy("bucket").applyInPandas(_alone, schema)
    parts = profile.where("bucket < 0").select("part", "marks", "owners")
    return parts.unionByName(counts).groupBy("part").applyInPandas(_left, "id long")


def _cells(width: int):
    """Rows of sketches (chunk, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sketches() -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate(held)
            cells = np.sort((mix(tokens, 7) >> np.uint64(64 - CELL_BITS)).astype(np.uint32))
            step = (1 << CELL_BITS) // _CHUNKS
            cut = np.searchsorted(cells, np.arange(_CHUNKS + 1, dtype=np.uint64) * np.uint64(step))
            # Cells ascend, so steps from one to the next take about a byte.
            blobs = [_pack(np.diff(cells[cut[c] : cut[c + 1]] & np.uint32(step - 1), prepend=np.uint32(0))) for c in range(_CHUNKS)]
            coarse = np.bincount((mix(tokens, 8) >> np.uint64(64 - COARSE_BITS)).astype(np.int64), minlength=1 << COARSE_BITS).astype(np.uint32)
            blobs += [_pack(x) for x in coarse.reshape(_CHUNKS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "cells"])

        for batch in slices(batches):
            for _, sizes, hashes in shingle_sets(_texts(batch.column(1)), width):
                held.append(hashes[np.repeat(_firsts(*_digests(sizes, hashes)), sizes)])
                if sum(map(len, held)) >= TASK_ROWS:
                    yield from sketches()
                    held = []
        if held:
            yield from sketches()

    return run


def _quads(cells: np.ndarray) -> np.ndarray:
    """Cells of 0 to 2 as two bits each."""
    four = cells.reshape(-1, 4)
    return four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6


def _add_chunks(rows: pd.DataFrame) -> pd.DataFrame:
    """Add up rows of one chunk, which are lists of cells if ``listed``, else sums; cells stay at 2."""
    chunk, listed = int(rows["chunk"].iloc[0]), rows["listed"].iloc[0]
    if chunk >= _CHUNKS:
        total = sum(_unpack(blob).astype(np.uint64) for blob in rows["cells"])
        return pd.DataFrame({"chunk": [chunk], "listed": [False], "cells": [_pack(np.minimum(total, 2**32 - 1).astype(np.uint32))]})
    cells = np.zeros((1 << CELL_BITS) // _CHUNKS, np.uint8)
    for blob in rows["cells"]:
        if listed:
            own, n = np.unique(np.cumsum(_unpack(blob)), return_counts=True)
            cells[own] = np.minimum(cells[own] + n, 2)
        else:
            quads = np.frombuffer(zstandard.decompress(blob), np.uint8)
            cells = np.minimum(cells + np.stack([quads >> s & 3 for s in (0, 2, 4, 6)], axis=1).ravel(), 2)
    return pd.DataFrame({"chunk": [chunk], "listed": [False], "cells": [zstandard.compress(_quads(cells).tobytes(), 1)]})


def build_sketch(parts: DataFrame) -> PackedSketch:
    """Add up the sketch rows of ``parts``; in two steps if a chunk has very many."""
    rows = parts.select("chunk", F.lit(True).alias("listed"), "cells")
    split = -(-rows.where("chunk = 0").count() // _CHUNK_ROWS)
    schema = "chunk int, listed boolean, cells binary"
    if split > 1:
        rows = rows.groupBy("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(split)).alias("_s")).applyInPandas(_add_chunks, schema)
    chunks: dict[int, bytes] = {}
    coarse = np.zeros((_CHUNKS, (1 << COARSE_BITS) // _CHUNKS), np.uint32)
    for row in rows.groupBy("chunk").applyInPandas(_add_chunks, schema).collect():
        c, blob = row["chunk"], bytes(row["cells"])
        if c < _CHUNKS:
            chunks[c] = blob
        else:
            coarse[c - _CHUNKS] = _unpack(blob)
    usual = max(1.0, coarse.mean())
    return PackedSketch(chunks, np.concatenate([np.clip(np.log2(np.maximum(x / usual, 1)), 0, 60).astype(np.uint8) for x in coarse]))


def _bits(owner: np.ndarray, at: np.ndarray, k: int, longs: int, odd: bool) -> np.ndarray:
    """[k, longs]: bits ``at`` of each owner that were hit (an odd number of times, if ``odd``)."""
    n = np.bincount(owner * (64 * longs) + at, minlength=k * 64 * longs)
    return np.packbits((n & 1 if odd else n > 0).reshape(k, -1), axis=1, bitorder="little").view(np.int64)


def _signatures(sizes: np.ndarray, hashes: np.ndarray, sketch: Sketch, percent: int) -> list[np.ndarray]:
    """A column for each name of _SIGNATURE."""
    k = len(sizes)
    place = lambda tokens, salt, longs: (mix(tokens, salt) % np.uint64(64 * longs)).astype(np.int64)
    parts = [_bits(np.repeat(np.arange(k), sizes), place(hashes, 31, _PARITIES), k, _PARITIES, True)]
    for order in range(1, ORDERS):
        owner, tokens, _, _ = _prefixes(sizes, hashes, sketch, order, percent)
        parts.append(_bits(owner, place(tokens, 32, _BITS), k, _BITS, False))
    return [np.ascontiguousarray(c) for part in parts for c in part.T]


def _candidates(shared, width: int, percent: int):
    """Rows (token, id, rank, n, reach) of the prefix tokens of sets, and (id, n, h1, signature, text)
    of those that have any. Of equal sets of a buffer only the first is given.

    ``reach`` is the largest set that this token can be the first common one with: what stands
    before it isn't shared then, so the overlap is at most what is left.

    ``rank`` is the share of the set's tokens that no other text has: of texts that were made
    from one another, the one of least rank is nearest to all.
    """
    names = ["token", "id", "rank", "reach", "n", "h1", *_SIGNATURE, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value

        def row(columns: dict) -> pa.RecordBatch:
            k = len(columns["id"])
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(k, pa.int32() if c in ("rank", "reach") else pa.string() if c == "text" else pa.int64())) for c in names], names)

        for batch in slices(batches):
            ids, column = batch.column(0).to_numpy(), batch.column(1)
            for first, sizes, hashes in shingle_sets(_texts(column), width):
                own, token, place, common = _prefixes(sizes, hashes, sketch, 0, percent)
                has = np.zeros(len(sizes), bool)
                has[own] = True
                h1, h2 = _digests(sizes, hashes)
                has &= _firsts(h1, h2)
                if not has.any():
                    continue
                rank = (1000 * (sizes - common) // np.maximum(sizes, 1)).astype(np.int32)
                keep = has[own]
                own, token, n = own[keep], token[keep], sizes[own[keep]]
                reach = ((n - place[keep]) * (100 + percent) // percent - n).astype(np.int32)
                yield row({"token": pa.array(token.view(np.int64)), "id": pa.array(ids[first + own]), "rank": pa.array(rank[own]), "reach": pa.array(reach), "n": pa.array(n)})
                at = np.flatnonzero(has)
                signature = _signatures(sizes[at], hashes[np.repeat(has, sizes)], sketch, percent)
                texts = column.take(pa.array(first + at))
                yield row({"id": pa.array(ids[first + at]), "n": pa.array(sizes[at]), "h1": pa.array(h1[at]), "text": texts.cast(pa.string())} | {c: pa.array(x) for c, x in zip(_SIGNATURE, signature, strict=True)})

    return run


def _verify(width: int, percent: int):
    """Of rows (a, b, text a, text b) those whose sets pass the exact test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=16)
        def known(text: str) -> np.ndarray:
            [(_, _, hashes)] = shingle_sets([text.encode("utf-8", "replace")], width)
            return hashes

        def linked(x: str, y: str) -> bool:
            a, b = known(x), known(y)
            both = len(np.intersect1d(a, b, assume_unique=True))
            return 100 * both >= percent * (len(a) + len(b) - both)

        for batch in slices(batches):
            keep = [linked(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _filters(percent: int, x: str, y: str) -> Column:
    """What sizes and signatures of two linked sets must fulfil."""
    differ = " + ".join(f"bit_count({x}.p{i} ^ {y}.p{i})" for i in range(_PARITIES))
    met = [" or ".join(f"({x}.q{j}{i} & {y}.q{j}{i}) <> 0" for i in range(_BITS)) for j in range(1, ORDERS)]
    # Sets of overlap o differ in n + m - 2 o tokens, and 100 o >= percent (n + m - o).
    sizes = f"{percent} * greatest({x}.n, {y}.n) <= 100 * least({x}.n, {y}.n)"
    return F.expr(f"{sizes} and {100 + percent} * ({differ}) <= {100 - percent} * ({x}.n + {y}.n) and " + " and ".join(f"({m})" for m in met))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``id, n_shingles, component_id``.

    Two documents are linked when 100 * intersection >= ``percent`` * union of their sets of
    shingles. ``component_id`` is the smallest id that links reach. A null text, or one
    without words, has an empty set and links with nothing, as has a row whose id is null
    (its component is null). Ids are integers; rows that share one are one node. Repeated rows
    give repeated rows; an empty table gives none. Whole texts count: a long one is a batch of
    its own, about ten times its size in memory. Only the two columns named are read, so other
    columns can't clash.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profile = materialize(texts.mapInArrow(_profile(width, percent), _PROFILE), "jac-profile")
    own = materialize(profile.where("n is not null").select("id", "n", "h1", "h2"), "jac-own")
    near = materialize(_neighboured(profile), "jac-near")
    drop_table(profile)
    tidy(spark)

    # Equal sets are one class, a node named by its least id; nothing has to be verified for them.
    named = own.where("id is not null and n > 0")
    leasts = materialize(named.groupBy("n", "h1", "h2").agg(F.min("id").alias("node")), "jac-least")
    classes = materialize(named.join(leasts, ["n", "h1", "h2"]).select("id", "node", "h1").distinct(), "jac-classes")
    drop_table(leasts)
    # One text of each class that may have a neighbour, and what its marks don't tell from those.
    wanted = materialize(near.join(classes, "id").select("node").distinct(), "jac-wanted")
    [marked] = fresh(texts, "marked")
    texts = with_mark(texts.where("id is not null"), marks(wanted, "node"), marked, "id").where(marked).drop(marked)
    drop_table(near)
    drop_table(wanted)

    parts = materialize(texts.mapInArrow(_cells(width), "chunk int, cells binary"), "jac-cells")
    sketch = spark.sparkContext.broadcast(build_sketch(parts))
    drop_table(parts)
    tidy(spark)
    schema = f"token long, id long, rank int, reach int, n long, h1 long, {', '.join(f'{c} long' for c in _SIGNATURE)}, text string"
    found = materialize(texts.mapInArrow(_candidates(sketch, width, percent), schema), "jac-found")
    sketch.destroy()
    # Tokens that more than one row has, without the rows that reach none of the token's sizes.
    rows = found.where("token is not null").select("token", "id", "rank", "reach", F.col("n").cast("int").alias("n"))
    several = rows.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("n").alias("least")).where("low < high").select("token", "least")
    several = materialize(several, "jac-several")
    useful = rows.drop("n").join(several.hint("merge"), "token").where("reach >= least").select("token", "id", "rank")
    members = materialize(useful.join(classes.select("id", "node"), "id").select("token", "node", "rank").distinct(), "jac-members")
    drop_table(several)
    tidy(spark)
    bodies = materialize(_bodies(found.where("token is null").drop("token", "rank", "reach"), classes, members), "jac-bodies")
    drop_table(found)
    tidy(spark)

    stars = members.groupBy("token").agg(F.min(F.struct("rank", "node")).alias("top"), F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    stars = materialize(stars.select("token", F.col("top.node").alias("top")), "jac-tops")
    pairs = members.join(stars, "token").where("node <> top").select(F.least("node", "top").alias("a"), F.greatest("node", "top").alias("b")).distinct()
    tested = materialize(_passing(pairs, bodies, percent), "jac-edges")
    drop_table(stars)
    # Rows that share an id are one, so their classes are linked.
    shared = classes.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("id", "a")
    same = materialize(classes.join(shared, "id").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "jac-same")
    links = same.unionByName(_verified(tested, bodies, width, percent))

    # What shares a prefix token but lies in different components.
    components = materialize(connected_components(links), "jac-components")
    for number in range(STAR_ROUNDS + 1):
        placed = members.join(components, "node", "left").select("token", "node", F.coalesce("component", "node").alias("component"))
        placed = materialize(placed, "jac-placed")
        open_tokens = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
        open_tokens = materialize(open_tokens, "jac-open")
        rest = materialize(placed.join(open_tokens, "token", "left_semi"), "jac-rest")
        drop_table(placed)
        drop_table(open_tokens)
        if rest.isEmpty():
            break
        if number < STAR_ROUNDS:
            pivots = materialize(rest.groupBy("token").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(number))).alias("pivot")), "jac-pivots")
            pairs = rest.join(pivots, "token").where("component <> pivot.component")
            pairs = _passing(pairs.select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct(), bodies, percent)
        else:
            pairs = _across(rest, bodies, percent)
        untested = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "jac-pairs")
        drop_table(rest)
        more, tested = _verified(untested, bodies, width, percent), tested.unionByName(untested)
        if not more.isEmpty():
            # Links between components, and what each node is in, say it all.
            links = components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
            components = materialize(connected_components(links), "jac-components")
    whole = classes.join(components, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    # A class is in one component; its least id may differ from that of the rows that share an id.
    whole = materialize(whole.groupBy("id").agg(F.min("component").alias("component")), "jac-whole")
    drop_table(bodies)
    joined = own.select("id", F.col("n").alias("n_shingles")).join(whole, "id", "left")
    return joined.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def _bodies(found: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """Size, signature and text of each class that shares a token: ``node, n, signature, text``.

    Of rows of one class, which have equal sets, the one of the least id.
    """
    wanted = members.select("node").distinct()
    of = found.join(classes, ["id", "h1"]).join(wanted, "node", "left_semi").drop("h1")
    firsts = of.groupBy("node").agg(F.min("id").alias("id"))
    return of.join(firsts, ["node", "id"], "left_semi").drop("id").dropDuplicates(["node"])


def _passing(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of nodes whose sizes and signatures allow a link."""
    small = bodies.select("node", "n", *_SIGNATURE)
    x, y = small.alias("x"), small.alias("y")
    return pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(_filters(percent, "x", "y")).select("a", "b")


def _across(rest: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of nodes in different components that share a token and pass every filter.

    A token's largest component is its home. What lies outside is paired with the home and with
    each other, so no pair within a component and none of the home's many rows is looked at.
    """
    sizes = rest.groupBy("token", "component").agg(F.count("*").alias("size"))
    home = materialize(sizes.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("home")), "jac-home")
    lists = rest.groupBy("node").agg(F.count("*").alias("k"), F.collect_list("token").alias("tokens"))
    lists = lists.select("node", F.when(F.col("k") <= LISTED, F.col("tokens")).alias("tokens"))
    full = rest.join(lists, "node").join(bodies.select("node", "n", *_SIGNATURE), "node").join(home, "token")
    full = materialize(full.withColumn("inside", F.expr("component = home")).drop("home"), "jac-rows")
    x, y = full.where("not inside").alias("x"), full.alias("y")
    first = F.expr("coalesce(array_min(array_intersect(x.tokens, y.tokens)) = x.token, true)")
    apart = F.expr("x.token = y.token and x.component <> y.component and (y.inside or x.node < y.node)")
    pairs = x.join(y, apart & _filters(percent, "x", "y") & first)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _verified(pairs: DataFrame, bodies: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that are links, written out. A centre's text goes with each of its pairs."""
    of_a, of_b = bodies.select(F.col("node").alias("a"), F.col("text").alias("ta")), bodies.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "ta", "tb")
    return materialize(both.mapInArrow(_verify(width, percent), "a long, b long").distinct(), "jac-links")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those of a component whose smallest id is another one.

    Rows with a null id stay, and of repeated rows all or none. All columns stay as they are.
    Only rows that may have to go are shuffled: those whose id has a mark of a dropped one.
    """
    node, marked = fresh(docs, "_node", "_marked")
    found = similar_components(docs, id_col, text_col, width, percent)
    gone = materialize(found.where("id <> component_id").select(F.col("id").alias(node)).distinct(), "jac-gone")
    flagged = with_mark(docs, marks(gone, node), marked, F.col(id_col).cast("long"))
    maybe = flagged.where(F.col(marked)).drop(marked)
    return flagged.where(~F.col(marked)).drop(marked).unionByName(maybe.join(gone.hint("merge"), maybe[id_col] == gone[node], "left_anti"))
