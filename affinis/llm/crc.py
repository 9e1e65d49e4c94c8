"""CRC-32 of many byte spans at once, from contributions by position.

CRC-32 is linear up to a constant of the length: the checksum of a span is
the exclusive or of one contribution per byte, which depends on the byte
and on its distance from the span's end, and of the checksum of as many
zero bytes.  A table of ``BLOCK`` distances by 256 bytes turns a slice of
text into contributions with one lookup, and ``bitwise_xor.reduceat`` adds
them up over all spans.  Spans of more than ``BLOCK`` bytes are cut into
blocks; passing a state over a block of zero bytes is four lookups in the
same table, so memory does not follow the span.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

BLOCK = 256
#: Blocks of a long span that are looked up together.
STRIDE = 4096


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(contribution of byte b at distance d at ``d * 256 + b``, checksum of n zero bytes)."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    rows = [step]
    for _ in range(BLOCK - 1):
        rows.append((rows[-1] >> np.uint32(8)) ^ step[rows[-1] & np.uint32(255)])
    zeros = np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], np.uint32)
    return np.concatenate(rows), zeros


def _zeros(n: int) -> int:
    """Checksum of ``n`` zero bytes, a stride at a time."""
    state, piece = 0, bytes(BLOCK * STRIDE)
    while n > 0:
        state = zlib.crc32(piece[:n], state)
        n -= len(piece)
    return state


def _long(data: np.ndarray) -> int:
    """Checksum of one long span, block by block."""
    table = tables()[0]
    head = len(data) % BLOCK
    distance = np.arange(BLOCK - 1, -1, -1, dtype=np.int64) * 256
    state = int(np.bitwise_xor.reduce(table[distance[BLOCK - head:] + data[:head]])) if head else 0
    # a state passes over a block of zeros like four bytes at the block's start
    lanes = [table[(BLOCK - 1 - k) * 256:(BLOCK - k) * 256].tolist() for k in range(4)]
    for at in range(head, len(data), BLOCK * STRIDE):
        part = data[at:at + BLOCK * STRIDE].reshape(-1, BLOCK)
        for block in np.bitwise_xor.reduce(table[distance + part], axis=1).tolist():
            state = block ^ lanes[0][state & 255] ^ lanes[1][state >> 8 & 255] \
                ^ lanes[2][state >> 16 & 255] ^ lanes[3][state >> 24]
    return state ^ _zeros(len(data))


def span_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes ``data[start:end]`` of spans that follow each other without overlap."""
    table, zeros = tables()
    size = end - start
    out = np.zeros(len(start), np.uint32)
    for k in np.flatnonzero(size > BLOCK):
        out[k] = _long(data[start[k]:end[k]])
    short = np.flatnonzero((size > 0) & (size <= BLOCK))
    if len(short):
        n = size[short]
        first = np.concatenate(([0], np.cumsum(n)[:-1]))
        # byte positions of all short spans, one after the other
        at = np.arange(int(n.sum())) + np.repeat(start[short] - first, n)
        left = np.repeat(end[short] - 1, n) - at
        out[short] = np.bitwise_xor.reduceat(table[left * 256 + data[at]], first) ^ zeros[n]
    return out
