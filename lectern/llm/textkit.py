"""Vectorised hashing of byte and word sequences for Arrow batches (NumPy only).

All hashes are 64-bit functions of content alone: the same bytes give the same value in
every process, batch and position.  ``Spans`` is a polynomial modulo 2^64, which long sequences
of a certain structure can defeat: it serves for sequences of few symbols and for choosing
anchors, where a collision costs time only.  Words and record contents are told apart by their
bytes or by BLAKE2b.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_SEED = 20240607

_rng = np.random.Generator(np.random.PCG64(_SEED))
#: A random odd 64-bit value for each byte.
BYTE_CODE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | _U(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = pow(int(_MULT), -1, 2**64)
        for_each = np.full(size, _MULT, dtype=np.uint64)
        for_each[0] = 1
        back = np.full(size, _U(inverse), dtype=np.uint64)
        back[0] = 1
        _powers, _inverses = np.cumprod(for_each), np.cumprod(back)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(29)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(32)
    return x


class Spans:
    """Position-independent hashes of arbitrary spans of one symbol sequence."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self._inv = _power_tables(n + 1)[1]
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * _powers[:n], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * self._inv[start]
        return mix(raw + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all length-k windows, by start."""
        n = len(self._sums) - 1
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        raw = (self._sums[k:] - self._sums[: n - k + 1]) * self._inv[: n - k + 1]
        return mix(raw + _U(k * 0xD6E8FEB86659FD93 % 2**64))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    buffers = column.buffers()
    if len(column) == 0 or buffers[1] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting beats hashing for 64-bit values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    return out


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per text, the index of its first word."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_IS_SPACE[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets[:-1][offsets[:-1] <= n]] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    if len(ends) and ends[-1] != n and solid[-1]:
        ends = np.append(ends, n)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A value for each word: one to one for words of up to seven bytes, else 64 bits of BLAKE2b."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(len(buf), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    short = np.minimum(size, 7).astype(np.uint64)
    out = mix((eight[starts] & ((_U(1) << (short * _U(8))) - _U(1))) | (short << _U(56)))
    data, known = buf.tobytes(), {}
    for i in np.flatnonzero(size > 7).tolist():
        word = data[starts[i] : ends[i]]
        value = known.get(word)
        if value is None:
            value = known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        out[i] = value
    return out


def joined_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one blank after each, and where each starts and ends there."""
    size = ends - starts + 1
    stop = np.cumsum(size)
    first = stop - size
    out = np.append(buf, np.uint8(32))[np.repeat(starts - first, size) + np.arange(int(stop[-1]) if len(stop) else 0)]
    out[stop - 1] = 32
    return out.tobytes(), first, stop - 1


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every length-w window, by doubling."""
    n = len(v) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=v.dtype)
    out, reach = v, 1
    while reach * 2 <= w:
        out = np.minimum(out[: len(out) - reach], out[reach:])
        reach *= 2
    if reach < w:
        out = np.minimum(out[: len(out) - (w - reach)], out[w - reach :])
    return out[:n]


def text_chunks(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Consecutive texts grouped so that a group's bytes stay near ``limit``."""
    out, first = [], 0
    n = len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        out.append((first, last))
        first = last
    return out


def int64(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
