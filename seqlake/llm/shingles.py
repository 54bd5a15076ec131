"""Word shingles of many texts as sorted 64-bit hashes, computed in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text handled at once; a longer text is alone, its words hashed piece by piece.
BUFFER_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Lower-cases A-Z in UTF-8, whose other letters have no byte below 128.
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Blanks are 0x20 and 0x09 to 0x0D.
_BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers, another one for each salt."""
    x = x + np.uint64((0xD1B54A32D192ED03 * (2 * salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = {b: _powers(b, BUFFER_BYTES + 2) for b in (_BASE, _INVERSE)}


def _power(base: int, n: int) -> np.ndarray:
    return _POWERS[base][:n] if n <= len(_POWERS[base]) else _powers(base, n)


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, set sizes, hashes text by text, ascending) for runs of texts.

    Words are runs of non-blanks after lower-casing A-Z; a shingle is ``width`` words in a
    row. A text with fewer words has them all as its one shingle, one without words none.
    """
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > BUFFER_BYTES - len(held) - 1:
            yield first, *_sets(held, width)
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, *_sets(held, width)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of lower-cased bytes that end in a blank."""
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    # A word's bytes are digits of a number; sums over prefixes give it for any stretch.
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)))))
    return starts, mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(np.uint64))


def _pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, part) of long data, cut behind blanks; a word longer than a buffer stays whole."""
    at = 0
    while at < len(data):
        upto = at + BUFFER_BYTES
        while upto < len(data):
            blanks = np.flatnonzero(_BLANK[data[max(at, upto - BUFFER_BYTES) : upto]])
            if len(blanks):
                upto = max(at, upto - BUFFER_BYTES) + int(blanks[-1]) + 1
                break
            upto += BUFFER_BYTES
        yield at, data[at:upto]
        at = upto


def _sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    ends_at = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    if len(data) <= BUFFER_BYTES + 1:
        starts, words = _words(data)
    else:
        found = [(at + s, w) for at, part in _pieces(data) for s, w in [_words(part)]]
        starts, words = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(starts):
        return np.zeros(len(texts), np.int64), np.zeros(0, np.uint64)
    owner = np.searchsorted(ends_at, starts, side="right")
    count = np.bincount(owner, minlength=len(texts))
    hashes = np.zeros(len(words), np.uint64)
    for k in range(min(width, len(words))):
        hashes[: len(words) - k] += mix(words[k:], k + 1)
    whole = np.flatnonzero(owner[: len(words) - width + 1] == owner[width - 1 :]) if len(words) >= width else np.zeros(0, np.int64)
    hashes, owners = mix(hashes[whole]), owner[whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(count)))[:-1]
        extra = np.array([_short(words[begin[i] : begin[i] + count[i]]) for i in short], np.uint64)
        hashes, owners = np.concatenate((hashes, extra)), np.concatenate((owners, short))
    order = np.argsort(hashes)
    order = order[np.argsort(owners[order].astype(np.uint32 if len(texts) > 65535 else np.uint16), kind="stable")]
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return np.bincount(owners[new], minlength=len(texts)), hashes[new]


def _short(words: np.ndarray) -> np.uint64:
    """One hash of fewer words than a shingle has."""
    total = np.uint64(len(words))
    for k in range(len(words)):
        total = mix(total + words[k : k + 1], k + 101)[0]
    return total
