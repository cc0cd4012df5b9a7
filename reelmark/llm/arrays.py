"""Texts of an Arrow batch as byte arrays: words and their hashes for many documents at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
# Odd multipliers of the word and shingle hashes, and the constants of the 64-bit finaliser.
BASE = 0x9E3779B97F4A7C15
SHINGLE = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
MASK = (1 << 64) - 1

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX_1)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(33))


@dataclass
class Block:
    """Whole documents of a batch, about ``BLOCK_BYTES`` together or one longer document."""

    first: int
    offsets: np.ndarray
    data: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The documents of a string or binary column as bytes; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        yield Block(i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
        i = j


@lru_cache(maxsize=1)
def _powers(log_size: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << log_size
    up = np.full(size, BASE, np.uint64)
    down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def prefix_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings from ``start`` to ``end``: prefix sums of bytes times powers, shifted to their start."""
    up, down = _powers(max(10, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return (sums[end] - sums[start]) * down[start]


@dataclass
class Words:
    """Words of a block in order: ``doc`` (within the block), first and end byte, 64-bit hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each document, the place of its first word; one more at the end

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(block: Block, lower: bool = True) -> Words:
    """Runs of bytes other than blanks; A-Z are lower-cased for the hash."""
    data = block.data
    solid = ~_IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[block.offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | cut[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    hashes = mixed(prefix_hashes(_LOWER[data] if lower else data, start, end))
    doc = np.searchsorted(block.offsets, start, "right") - 1
    first = np.searchsorted(start, block.offsets)
    return Words(doc, start, end, hashes, first)


def shingles(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of the distinct word shingles of each document, sorted.

    A document with words, but fewer than ``width``, has one shingle of all its words; without words it has none.
    """
    n = len(w.hash)
    m = max(0, n - width + 1)
    h = np.zeros(m, np.uint64)
    for k in range(width):
        h += w.hash[k : k + m] * np.uint64(SHINGLE[k])
    whole = w.doc[:m] == w.doc[width - 1 :]
    docs, hashes = w.doc[:m][whole], mixed(h[whole])
    counts = w.count()
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        at = w.first[short]
        own = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            own[has] += w.hash[at[has] + k] * np.uint64(SHINGLE[k])
        docs, hashes = np.r_[docs, short], np.r_[hashes, mixed(own + counts[short].astype(np.uint64))]
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]
