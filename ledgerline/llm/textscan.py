"""Vectorised scanning of Arrow text columns: words and their hashes.

Texts are handled as UTF-8 bytes in slices of a few MB (a longer text is a slice
of its own), so memory follows the slice and not the batch.  The classes of
words are told by ASCII bytes alone; bytes from 80 on always belong to words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE, POWERS = 1 << 21, 1 << 18
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)  # odd

#: Bytes in words that white space ends.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes in words of letters and digits, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows."""
    data, offsets = raw(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the row of each."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    is_word = inside[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, is_word[:-1]
    after[-1], after[:-1] = False, is_word[1:]
    edges = offsets[1:-1]
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


@cache
def _bytes_table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, np.uint64)


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = -(-n // POWERS) * POWERS
        _powers[:] = [np.full(size, x, np.uint64) for x in (_BASE, U(pow(int(_BASE), -1, 2**64)))]
        for table in _powers:
            table[0] = 1
            np.cumprod(table, out=table)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hashes() takes the hash of any span."""
    power, _ = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_bytes_table()[data] * power[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, alike for equal bytes wherever they stand."""
    _, inverse = _power_tables(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


#: Spans of more bytes are hashed by blake2b: sums of powers modulo 2**64 can be equal for
#: different texts of some hundred bytes that are built for it (Thue-Morse sequences).
SHORT = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of any length."""
    hashes = span_hashes(rolling(data), starts, ends)
    for k in np.flatnonzero(ends - starts > SHORT).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return hashes


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (also those across rows, for the caller to leave out)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= _BASE
        out += hashes[i : i + n]
    return mix(out + U(k))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out
