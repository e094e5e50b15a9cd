"""Word shingles of whole texts as 64-bit hashes, vectorised over Arrow buffers.

Words are runs of bytes other than ASCII white space; only A-Z change case.
A word's hash is a sum of random byte values times random odd position
multipliers (multilinear hashing) with a finishing mix, so no Python object
per word is made; a shingle combines the hashes of its words likewise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wardline.llm.common import row_blocks

#: Bytes of text worked on at once.
BLOCK_BYTES = 1 << 20
_SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
_IS_WORD = np.ones(256, bool)
_IS_WORD[_SPACES] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _stream(1 << 20, 256)[_LOWER]
_BYTE[_SPACES] = 0
_multipliers = _stream(2 << 20, 1 << 12) | np.uint64(1)


def _position(n: int) -> np.ndarray:
    global _multipliers
    if n > len(_multipliers):
        _multipliers = _stream(2 << 20, 2 * n) | np.uint64(1)
    return _multipliers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' bounds; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and per row the bounds of its words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts_at = inside.copy()
    starts_at[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(starts_at)
    counts = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    # the white space after a word counts as zeros, so its places may be cut
    place[~inside[starts[0]:]] = 0
    terms = _BYTE[data[starts[0]:]] * _position(int(place.max()) + 1)[place]
    return mix64(np.add.reduceat(terms, starts - starts[0])), counts


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """Per row its sorted distinct shingles (uint64): ``size`` words each; with
    fewer words, the whole sequence as one; without words none."""
    data, bounds = text_bytes(column)
    multipliers = _stream(3 << 20, size) | np.uint64(1)
    for first, last in row_blocks(np.diff(bounds), BLOCK_BYTES):
        lo = bounds[first]
        words, counts = word_hashes(data[lo:bounds[last]], bounds[first:last + 1] - lo)
        n = len(words) - size + 1
        windows = np.zeros(max(n, 0), np.uint64)
        for k in range(size if n > 0 else 0):
            windows += words[k:k + n] * multipliers[k]
        windows = mix64(windows)
        for a, b in zip(counts[:-1].tolist(), counts[1:].tolist()):
            if b - a >= size:
                yield np.unique(windows[a:b - size + 1])
            elif b > a:
                short = (words[a:b] * multipliers[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix64(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
