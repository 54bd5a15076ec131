"""Texts as flat numpy buffers, in pieces of bounded size, for vectorised n-gram work."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units (characters or bytes) that one buffer holds at most, besides separators.
BUFFER_UNITS = 1 << 18


#: glibc's call for that, where there is one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Rows of an Arrow batch, and about the bytes, whose texts are Python objects at the same time.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def give_back() -> None:
    """Hand freed memory back to the system: workers are used again and would keep it, as would the driver."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces, so that few texts are copied at a time; a longer text is alone.

    When the last is done, memory that the task has freed goes back to the system.
    """
    try:
        yield from _slices(batches)
    finally:
        give_back()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > at and (i - at >= SLICE_ROWS or held + size > SLICE_BYTES):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += size
        if batch.num_rows > at:
            yield batch.slice(at)


class Buffer:
    """Units of several texts one after another.

    ``units``: every piece stands behind ``context`` padding units or the units that came
    before it in its text. ``starts[j]:starts[j + 1]`` are the n-gram end positions of piece
    ``j``, which belongs to text ``owner[j]``; each unit of a text ends exactly one n-gram.
    """

    def __init__(self, units: np.ndarray, starts: np.ndarray, owner: np.ndarray, context: int):
        self.units, self.starts, self.owner, self.context = units, starts, owner, context

    def ends(self) -> np.ndarray:
        """Positions in ``units`` that are ends of n-grams, piece by piece."""
        keep = np.ones(len(self.units), bool)
        first = np.concatenate(([0], self.starts[1:-1] + self.context * np.arange(1, len(self.starts) - 1))) if len(self.starts) > 1 else np.zeros(0, int)
        for k in range(self.context):
            keep[first + k] = False
        return np.flatnonzero(keep)


def buffers(texts: list[bytes], width: int, context: int, pad: bytes, limit: int = BUFFER_UNITS) -> Iterator[Buffer]:
    """Group encoded texts into buffers; a text beyond ``limit`` is split, its context repeated.

    ``width`` is the bytes of a unit (1: bytes, 4: code points in UTF-32), ``pad`` the unit
    that stands before a text's first.
    """
    parts: list[bytes] = []
    sizes: list[int] = []
    owner: list[int] = []
    held = 0

    def done() -> Buffer:
        units = np.frombuffer(b"".join(parts), np.uint8 if width == 1 else np.uint32)
        return Buffer(units, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), np.array(owner, np.int64), context)

    for i, text in enumerate(texts):
        n = len(text) // width
        for at in range(0, n, limit):
            size = min(limit, n - at)
            before = text[max(0, at - context) * width : at * width]
            parts.append(pad * (context - len(before) // width) + before + text[at * width : (at + size) * width])
            sizes.append(size)
            owner.append(i)
            held += size
            if held >= limit:
                yield done()
                parts, sizes, owner, held = [], [], [], 0
    if sizes:
        yield done()
