"""Hashed words of whole Arrow text columns, without a loop over words.

Texts stay in their UTF-8 buffer. Words are runs of bytes of one class; a word's hash is a polynomial
in its bytes modulo 2^64, summed by segments over the buffer and scaled back to the word's start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def byte_classes(*classes: bytes, high: int) -> np.ndarray:
    """A class number for every byte value: 0 separates, then one for each of `classes`; `high` for bytes beyond ASCII."""
    table = np.zeros(256, np.uint8)
    table[128:] = high
    for n, members in enumerate(classes, 1):
        table[list(members)] = n
    return table


LETTERS = bytes([*range(65, 91), *range(97, 123)])
SPACES = bytes([*range(9, 14), 32])
SYMBOLS = bytes(b for b in range(128) if b not in LETTERS and b not in SPACES)
WORDS_ONLY = byte_classes(LETTERS, high=1)
WORDS_AND_SYMBOLS = byte_classes(LETTERS, SYMBOLS, high=1)


def text_slices(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of stretches of a text column; a null is an empty text.

    A stretch has at most SLICE_BYTES, or one row.
    """
    col = col.cast(pa.large_string()).fill_null("")
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE_BYTES, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def _power(n: int, kind: str) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # of each document, the place of its first word; one more for the end


def find_words(data: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> Words:
    """Words of the documents in a stretch. Documents never share a word."""
    n = len(data)
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(none, none, np.empty(0, np.uint64), np.zeros(len(offs), np.int64))
    kind = classes[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offs] = True
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change |= fresh
    edges = np.flatnonzero(change)
    held = kind[edges[:-1]] > 0
    starts, ends = edges[:-1][held], edges[1:][held]
    if not len(starts):
        return Words(starts, ends, np.empty(0, np.uint64), np.zeros(len(offs), np.int64))
    terms = (data.astype(np.uint64) + np.uint64(1)) * _power(n, "up")
    terms[kind == 0] = 0
    hashes = mixed(np.add.reduceat(terms, starts) * _power(n, "down")[starts])
    return Words(starts, ends, hashes, np.searchsorted(starts, offs))


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of each document's values; zero where it has none."""
    run = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return run[first[1:]] - run[first[:-1]]
