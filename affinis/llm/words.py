"""Word and shingle hashes of whole text columns, in numpy.

Tasks work on slices of an Arrow string column of at most ``SLICE_BYTES``
(one longer text is a slice of its own), so memory follows the longest
text, not the partition.  A word is a run of bytes outside
``[\\x20\\x09-\\x0D]``; since UTF-8 never uses ASCII bytes inside a
multi-byte character this equals the same rule on code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
U64 = np.uint64

_seed = np.random.default_rng(20240229)
_BYTE = _seed.integers(0, 2**64, 256, dtype=U64)
_B = int(_seed.integers(2**62, 2**64, dtype=U64)) | 1
_GRAM = U64(int(_seed.integers(2**62, 2**64, dtype=U64)) | 1)
_powers: dict[int, np.ndarray] = {}


class Words(NamedTuple):
    """Words of a slice: document d owns words ``ptr[d]:ptr[d+1]``."""

    data: np.ndarray   # bytes of the slice
    ptr: np.ndarray
    start: np.ndarray  # byte positions in ``data``
    end: np.ndarray
    bounds: np.ndarray  # byte bounds of the documents


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the byte base and of its inverse modulo 2**64."""
    if n > len(_powers.get(0, ())):
        size = max(n, SLICE_BYTES + 1)
        for key, base in ((0, _B), (1, pow(_B, -1, 2**64))):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[key] = np.cumprod(p)
    return _powers[0], _powers[1]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with at most ``limit`` bytes each."""
    sizes = np.asarray(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    at = 0
    total = np.concatenate(([0], np.cumsum(sizes)))
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield at, to
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document bounds; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def find_words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray | None = None) -> Words:
    """Word spans; ``inside`` marks the bytes of words (default: no white space)."""
    if inside is None:
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, np.searchsorted(start, bounds), start, end, bounds)


def word_hashes(w: Words, salt: int = 0) -> np.ndarray:
    """64-bit hash of each word, the same in every slice and task."""
    n = len(w.data)
    pw, inv = _power(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((_BYTE ^ U64(salt))[w.data] * pw[:n], out=total[1:])
    h = (total[w.end] - total[w.start]) * inv[w.start]
    return mix(h + (w.end - w.start).astype(U64) * U64(0x9E3779B97F4A7C15))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position (positions that fit the slice)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    g = h[:m].copy()
    for j in range(1, n):
        g = g * _GRAM + h[j:j + m]
    return mix(g)


def gram_starts(ptr: np.ndarray, n: int) -> np.ndarray:
    """True at word positions from which ``n`` words stay in one document."""
    total = int(ptr[-1])
    ok = np.ones(total, bool)
    left = np.repeat(ptr[1:], np.diff(ptr)) - np.arange(total)
    ok &= left >= n
    return ok


def shingle_sets(w: Words, h: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document.

    A document of 1 to n-1 words has its whole sequence as the one
    shingle; a document without words has none.
    """
    g = grams(h, n)
    out = []
    for d in range(len(w.ptr) - 1):
        a, b = int(w.ptr[d]), int(w.ptr[d + 1])
        if b - a >= n:
            out.append(np.unique(g[a:b - n + 1]))
        elif b > a:
            out.append(grams(h[a:b], b - a))
        else:
            out.append(np.zeros(0, U64))
    return out
