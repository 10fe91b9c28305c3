"""Exact top-k by inner product over a bit-sliced index."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._vectors import indexed, search, vectors

U = np.uint64


def quantise(v: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, as whole numbers."""
    q = np.floor(v.astype(np.float64) * scale)
    if q.size and np.abs(q).max() >= 2.0**28:
        raise ValueError("a component is too large: scale times it must stay below 2**28")
    return q.astype(np.int64)


def _build(ids: np.ndarray, table: np.ndarray, scale: float) -> dict:
    """slices[d, j]: the rows, as a bitmap, whose component d less its minimum has bit j."""
    q = quantise(table, scale)
    low = q.min(0) if q.size else np.zeros(q.shape[1], np.int64)
    q = (q - low).astype(U)
    bits = max(1, int(q.max()).bit_length()) if q.size else 1
    words = -(-len(ids) // 64)
    rows = np.zeros((q.shape[1], words * 64), U)
    rows[:, : len(ids)] = q.T
    slices = np.stack([np.packbits(((rows >> U(j)) & U(1)).astype(np.uint8), axis=1, bitorder="little") for j in range(bits)], 1)
    return {"low": low.tobytes(), "bits": bits, "slices": slices.tobytes(), "vectors": table.tobytes()}


def add_slices(columns: list[list[np.ndarray]], words: int) -> list[np.ndarray]:
    """columns[w]: stacks of bitmaps worth 2**w for each row they hold. Returns the slices of the
    sums, by full adders on bitmaps, a third of a column at a time, carries going one up."""
    out, w = [], 0
    while w < len(columns):
        a = np.concatenate(columns[w]) if columns[w] else np.zeros((0, words), U)
        while len(a) > 1:
            if len(columns) == w + 1:
                columns.append([])
            if len(a) == 2:
                columns[w + 1].append(a[:1] & a[1:])
                a = a[:1] ^ a[1:]
                break
            t = len(a) // 3
            x, y, z = a[:t], a[t : 2 * t], a[2 * t : 3 * t]
            half = x ^ y
            columns[w + 1].append((x & y) | (half & z))
            half ^= z
            a = np.concatenate((half, a[3 * t :]))
        out.append(a[0] if len(a) else np.zeros(words, U))
        w += 1
    return out


def top_rows(slices: list[np.ndarray], rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the k largest and of those level at the boundary."""
    sure, level, have = np.zeros_like(rows), rows.copy(), 0
    for s in reversed(slices):
        high = level & s
        n = int(np.bitwise_count(high).sum())
        if have + n >= k:
            level = high
        else:
            sure |= high
            have += n
            level &= ~s
    return sure, level


def _places(bitmap: np.ndarray, n: int | None = None) -> np.ndarray:
    """The rows of a bitmap, the first n at most."""
    at = np.flatnonzero(bitmap)
    if n is not None:
        at = at[: max(n, 0)]
    if not len(at):
        return at
    bits = np.unpackbits(bitmap[at].view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
    i, j = np.nonzero(bits)
    out = at[i] * 64 + j
    return out if n is None else out[:n]


def _within(query_ids: np.ndarray, queries: np.ndarray, segment, k: int, scale: float) -> tuple:
    ids, low, bits, dim = np.frombuffer(segment["ids"], np.int64), np.frombuffer(segment["low"], np.int64), int(segment["bits"]), int(segment["dim"])
    vectors_ = np.frombuffer(segment["vectors"], np.float32).reshape(len(ids), dim)
    words = -(-len(ids) // 64)
    plain = np.frombuffer(segment["slices"], U).reshape(dim, bits, words)
    both = np.stack((plain, ~plain))
    every = np.zeros(words * 8, np.uint8)
    every[: -(-len(ids) // 8)] = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
    every = every.view(U)
    p_out, v_out, s_out, own_out = [], [], [], []
    for place, q in enumerate(quantise(queries, scale)):
        size, minus = np.abs(q), (q < 0).astype(np.int64)
        top = max(int(size.max()).bit_length(), 1) if dim else 1
        columns: list[list[np.ndarray]] = [[] for _ in range(top + bits)]
        for b in range(top):
            on = np.flatnonzero((size >> b) & 1)
            if len(on):
                add = both[minus[on], on]
                for j in range(bits):
                    columns[b + j].append(add[:, j])
        slices = add_slices(columns, words)
        sure, level = top_rows(slices, every, k)
        at = _places(sure)
        # rows are in the order of their ids, so the first of those that tie are the smallest ids
        at = np.concatenate((at, _tied(level, k - len(at), ids, query_ids[place]))).astype(np.int64)
        total = np.zeros(len(at), np.int64)
        for w, s in enumerate(slices):
            total += ((s[at >> 6] >> (at & 63).astype(U)) & U(1)).astype(np.int64) << w
        total += int((q * low).sum()) - int(size[minus == 1].sum()) * ((1 << bits) - 1)
        p_out.append(np.full(len(at), place))
        v_out.append(ids[at])
        s_out.append(total)
        own_out.append((ids[at] == query_ids[place]) & (vectors_[at] == queries[place]).all(1))
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip((p_out, v_out, s_out, own_out), (np.int64, np.int64, np.int64, bool)))


def _tied(level: np.ndarray, n: int, ids: np.ndarray, query_id: int) -> np.ndarray:
    """The first n rows of a bitmap; where these end among rows that have the query's own id, all that
    have it, so that the query itself is surely there."""
    at = _places(level, n)
    if len(at) and n > 0 and ids[at[-1]] == query_id:
        lo, hi = np.searchsorted(ids, (query_id, query_id + 1))
        same = np.arange(lo, hi)
        same = same[((level[same >> 6] >> (same & 63).astype(U)) & U(1)).astype(bool)]
        at = np.union1d(at, same)
    return at


def top_inner(df: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of df with the largest inner product of
    quantised components, ties to the smaller vec_id; the query's own row is left out.

    For a query the slices of each attribute are added, shifted by the bits of the query's component,
    as they are for a positive and inverted for a negative one; rows are then chosen from the most
    significant slice of the sums downward, and their scores read from the slices.
    Vectors that are null or hold null or non-finite components take no part, nor rows with a null id.
    Rows that repeat an id are candidates and queries of their own; of rows equal to the query in id and
    vector one is the query. Only vectors of the same length are compared; empty tables give an empty
    table; other columns, whatever their names, are ignored. Components beyond 2**28 / scale raise an
    error."""
    index = indexed(vectors(df, id_col, vec_col, True), partial(_build, scale=scale), "low binary, bits int, slices binary, vectors binary", "bit-slices")
    return search(index, vectors(queries, id_col, vec_col, True), partial(_within, scale=scale), k, True, "long")
