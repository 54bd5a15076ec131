"""Best-fit packing of token sequences by the sum-of-squares rule.

Documents become token pieces of at most ``capacity``. Pieces are dealt by hash into shards
of about ``SHARD_PIECES`` and packed shard by shard, largest first: a piece goes into that open
bin where the sum over gaps of the squared number of open bins with that gap becomes smallest,
which keeps bins of every gap in supply so that the next piece finds an exact fit. A bin is
opened only where no open one has room: as all pieces are known, nothing is gained by more.
Shards hold a bounded number of pieces whatever the input, and the bins they leave poorly
filled are packed once more.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, prepare
from .textbuf import slices

CAPACITY = 2048
END_ID = 0
#: Pieces of a shard on average. Rest gaps of a shard's last bins are the loss of dealing.
SHARD_PIECES = 2000
#: Entries of a worker's caches of encoded words and of words with their punctuation
#: (about 200 bytes each); a full cache is emptied.
CACHE_WORDS, CACHE_CHUNKS = 300_000, 150_000
#: Characters of a chunk that is still cached, and of a text's part that is split at once.
CACHED_CHARS, PART_CHARS = 64, 1 << 20
_PLAIN_BELOW = "\u0130"
_NEVER = np.iinfo(np.int64).max
_TAIL = ".,;:!?|*%&$#\"()[]-+=/"


class Encoder:
    """Token ids of whole texts as little-endian bytes, word by word from a cache.

    White space ends every pre-token of the vocabulary and is in no special token, so the ids
    of a text are those of its words in order. Words of plain letters below U+0130 (where NFC
    changes nothing and lower case goes letter by letter) with a tail of ASCII punctuation go
    straight to the BPE model; all others, special tokens among them, to the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.mapped = {chr(c): level.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, ord(_PLAIN_BELOW)) if chr(c).isalpha()}
        self.words: dict[str, bytes] = {}
        self.chunks = _Chunks(self)

    def whole(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            symbols = word if word.isascii() else "".join(map(self.mapped.__getitem__, word))
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(symbols)]).tobytes()
            if len(word) <= CACHED_CHARS:
                self.words[word] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(_TAIL)
        if not word.isalpha() or not (word.isascii() or max(word) < _PLAIN_BELOW):
            return self.whole(chunk) if chunk else b""
        if len(word) == len(chunk):
            return self.word(word.lower())
        return self.word(word.lower()) + self.chunks[chunk[len(word) :]]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._part, _parts(text.replace("\n", " "))))

    def _part(self, text: str) -> bytes:
        if len(self.chunks) >= CACHE_CHUNKS:
            self.chunks.clear()
        return b"".join(map(self.chunks.__getitem__, text.split(" ")))


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about PART_CHARS, cut at blanks, so that few words exist at a time."""
    at = 0
    while at <= len(text):
        end = text.find(" ", at + PART_CHARS) if len(text) - at > PART_CHARS else -1
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end + 1


class _Chunks(dict):
    """Ids of what stands between blanks, computed when first asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> bytes:
        found = self.encoder.chunk(chunk)
        if len(chunk) <= CACHED_CHARS:
            self[chunk] = found
        return found


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A text's ids are those of the vocabulary itself, so strings that it names as special
    tokens are these tokens. A null text counts as empty: its document is the closing id alone.
    Each row of ``docs`` is a document of its own, also where ids repeat or are null; no rows
    give no pieces. A long text is split part by part, so it takes a few times its size. Other
    columns aren't read, so their names can't clash.
    """
    prepare(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        close = np.array([END_ID], "<u4").tobytes()
        step = 4 * capacity
        names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
        for batch in slices(batches):
            doc_ids = batch.column(0).to_pylist()
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = (encoder.encode(text) if text else b"") + close
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    owner.append(doc_ids[i])
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [pa.array(owner, batch.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, schema)


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum-of-squares packing of ``sizes``, largest first: (bin of each, offset in it).

    Equal sizes are taken in the order given.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap
    members: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        # Change of the sum: a bin of gap g becomes one of gap g - size; full bins don't count.
        change = 2 * (open_bins[: capacity - size + 1] - open_bins[size:]) + 2
        change[0] = 1 - 2 * open_bins[size]
        change[open_bins[size:] == 0] = _NEVER
        # Of equal changes the smallest gap; a new bin if none has room.
        at = int(change.argmin())
        gap = size + at if change[at] != _NEVER else capacity
        if gap == capacity:
            chosen, made = made, made + 1
        else:
            chosen = members[gap].pop()
            open_bins[gap] -= 1
        bins[i], offsets[i] = chosen, capacity - gap
        if gap > size:
            members[gap - size].append(chosen)
            open_bins[gap - size] += 1
    return bins, offsets


def _pack_round(rest: DataFrame, shards: int, number: int, capacity: int) -> DataFrame:
    """Pack each shard of ``rest``; adds ``sequence_id, offset, fill``. Sequence ids of different rounds differ."""
    columns = rest.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # Rows come in any order; sorted, they are packed alike each time.
        rows = rows.sort_values([c for c in ("length", "id", "piece", "start", "ids_crc32") if c in columns], kind="stable")
        sizes = rows["length"].to_numpy()
        bins, offsets = pack_sizes(sizes, capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        first = (number << 56) + (int(key[0]) << 24)
        return rows[columns].assign(sequence_id=first + bins, offset=offsets, fill=fill[bins])

    # Rows are dealt by their place in the written table, so repeated rows spread like any others.
    (name,) = fresh(rest, "_shard")
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias(name)
    return rest.select("*", shard).groupBy(name).applyInPandas(one, f"{schema}, sequence_id long, offset long, fill long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = 2, full_enough: float = 0.97) -> DataFrame:
    """``pieces`` (which have a ``length`` from 1 to ``capacity``) with ``sequence_id, offset``.

    Pieces of full length are sequences of their own and aren't shuffled. All others are
    packed in shards; the members of sequences under ``full_enough`` go to the next round.
    Equal and repeated pieces are packed one by one; no pieces give no rows. A shard holds
    about ``SHARD_PIECES`` pieces at any size of the input.
    """
    pieces = materialize(pieces, "pack-pieces")
    full = pieces.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done = pieces.where(F.col("length") < capacity), [full]
    names = pieces.columns
    for number in range(1, rounds + 1):
        shards = max(1, -(-rest.count() // SHARD_PIECES))
        packed = _pack_round(rest, shards, number, capacity)
        last = number == rounds or shards == 1
        if last:
            done.append(packed.drop("fill"))
            break
        packed = materialize(packed, f"pack-round{number}")
        enough = F.col("fill") >= full_enough * capacity
        done.append(packed.where(enough).drop("fill"))
        rest = packed.where(~enough).select(*names)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
