"""Word and shingle hashes of whole Arrow batches with numpy.

Words are runs of bytes other than x20 and x09 to x0D; A to Z count as a to z. A word's hash is
a polynomial over random 64-bit byte values, from prefix sums over the batch; equal words have
equal hashes in every process. Texts differ in hash but for chance of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PLACES = mix(np.arange(11, 16, dtype=np.uint64) * U(_BASE)) | U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def forget() -> None:
    """Drops the powers kept for the longest batch so far."""
    _POWERS[:] = [p[:1].copy() for p in _POWERS]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (n + 1 numbers)."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and length of each word, and the word at which each text begins."""
    raw, offsets = bytes_of(texts)
    if not len(raw):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    inside = ~_SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = inside[edges]
    edges = edges[edges > 0] - 1
    last[edges] = inside[edges]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    power, back = _powers(len(raw))
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(_BYTES[raw] * power[: len(raw)], out=sums[1:])
    length = end + 1 - start
    hashes = mix((sums[end + 1] - sums[start]) * back[start] + length.astype(U) * U(0xD6E8FEB86659FD93))
    return hashes, start, length, np.searchsorted(start, offsets)


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and where each text's begin (n + 1).

    A text with fewer words than width has its whole word sequence as its one shingle; a text
    that is null or has no words has none."""
    h, _, _, at = words(texts)
    counts = np.diff(at)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(n)))
    if not begin[-1]:
        return np.zeros(0, U), begin
    doc = np.repeat(np.arange(len(n)), n)
    place = at[doc] + np.arange(begin[-1]) - begin[doc]
    padded = np.concatenate((h, np.zeros(width, U)))
    out = np.zeros(begin[-1], U)
    short = counts[doc] < width
    for j in range(width):
        part = padded[place + j] * _PLACES[j % 5] + U(j // 5)
        if short.any():
            part = np.where(short & (j >= counts[doc]), U(0), part)
        out += part
    out = mix(out + np.where(short, counts[doc], width).astype(U))
    for i in np.flatnonzero(n > 1).tolist():
        out[begin[i] : begin[i + 1]].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(n)))))


def parts_sum(values: np.ndarray, slot: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """An order-free 64-bit hash of the values in each slot, and whether the slot holds any."""
    v = mix(values)
    low = np.bincount(slot, (v & U(0x3FFFFFF)).astype(np.float64) + 1, slots)
    mid = np.bincount(slot, ((v >> U(26)) & U(0x3FFFFFF)).astype(np.float64), slots)
    return mix(low.astype(U) * U(_BASE) + mix(mid.astype(U) + U(7))), low > 0
