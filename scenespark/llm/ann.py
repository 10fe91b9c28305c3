"""Approximate nearest neighbours by score-aware (anisotropic) product quantisation with
four-bit codes, and exact reranking.

The nearest vector by Euclidean distance has the largest <q, x> - |x|^2 / 2, so the scan estimates
inner products from codes and takes |x|^2 as stored. Codes lose the less of an inner product the
smaller their error is along x itself; that part counts eta times in training and encoding.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._vectors import indexed, search, vectors

#: The codebooks are fitted on at most so many vectors, those with the smallest hashes of their ids.
SAMPLE = 8_192
#: Components in a subspace.
WIDTH = 2
#: The share of |x| that an inner product must reach to matter; sets eta.
REACH, LEAST = 0.2, 1.5


def _weights(dim: int) -> float:
    """eta: what a squared error along x counts against one across it. Where that share makes it small,
    in few dimensions, LEAST."""
    return max(LEAST, (dim - 1) * REACH**2 / (1 - REACH**2))


def _split(x: np.ndarray) -> np.ndarray:
    """(n, dim) as (n, subspaces, WIDTH), filled up with zeros; an even number of subspaces."""
    m = -(-x.shape[1] // WIDTH)
    m += m % 2
    return np.pad(x, ((0, 0), (0, m * WIDTH - x.shape[1]))).reshape(len(x), m, WIDTH)


def encode(x: np.ndarray, books: np.ndarray, eta: float, rounds: int = 3) -> np.ndarray:
    """Codes (n, m) by coordinate descent on |r|^2 + (eta - 1) <r, x/|x|>^2, r the residual."""
    parts = _split(x)
    norm = np.maximum(np.linalg.norm(x, axis=1), 1e-30)
    unit = parts / norm[:, None, None]
    codes = np.empty(parts.shape[:2], np.uint8)
    for s in range(parts.shape[1]):
        codes[:, s] = ((parts[:, s, None] - books[s][None]) ** 2).sum(-1).argmin(1)
    along = sum(((parts[:, s] - books[s][codes[:, s]]) * unit[:, s]).sum(1) for s in range(parts.shape[1]))
    for _ in range(rounds):
        for s in range(parts.shape[1]):
            r = parts[:, s, None] - books[s][None]
            a = (r * unit[:, s, None]).sum(-1)
            rest = along - np.take_along_axis(a, codes[:, s, None].astype(np.int64), 1)[:, 0]
            best = ((r**2).sum(-1) + (eta - 1) * (rest[:, None] + a) ** 2).argmin(1)
            along = rest + np.take_along_axis(a, best[:, None], 1)[:, 0]
            codes[:, s] = best
    return codes


def train(x: np.ndarray, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Codebooks (m, 16, WIDTH). Centres start from sampled rows and are, in each round, the
    least-squares solution for the codes given, the error along x weighing eta times."""
    x = x.astype(np.float64)
    eta, parts, rng = _weights(x.shape[1]), _split(x), np.random.default_rng(seed)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
    m = parts.shape[1]
    books = np.stack([parts[rng.choice(len(x), 16, replace=len(x) < 16), s] for s in range(m)])
    for step in range(rounds):
        e = eta if step >= rounds // 2 else 1.0
        codes = encode(x, books, e, 1 if e > 1 else 0)
        error = np.stack([parts[:, s] - books[s][codes[:, s]] for s in range(m)], 1)
        along = (error * unit).sum((1, 2))
        for s in range(m):
            others = along - (error[:, s] * unit[:, s]).sum(1)
            for c in range(16):
                at = np.flatnonzero(codes[:, s] == c)
                if not len(at):
                    continue
                u, p = unit[at, s], parts[at, s]
                left = len(at) * np.eye(WIDTH) + (e - 1) * u.T @ u
                right = p.sum(0) + (e - 1) * ((others[at] + (p * u).sum(1))[:, None] * u).sum(0)
                books[s, c] = np.linalg.solve(left, right)
            new = parts[:, s] - books[s][codes[:, s]]
            along = others + (new * unit[:, s]).sum(1)
            error[:, s] = new
    return books


def _build(ids: np.ndarray, table: np.ndarray, books) -> dict:
    x = table.astype(np.float64)
    codes = encode(x, books.value[table.shape[1]], _weights(table.shape[1]))
    packed = codes[:, 0::2] | codes[:, 1::2] << 4  # two codes of four bits in a byte
    own = books.value[table.shape[1]]
    back = np.stack([own[s][codes[:, s]] for s in range(len(own))], 1)
    coded, lost = (back**2).sum((1, 2)), np.sqrt(((_split(x) - back) ** 2).sum((1, 2)))
    return {
        "codes": np.ascontiguousarray(packed.T).tobytes(),
        "norms": (x * x).sum(1).astype(np.float32).tobytes(),
        "coded": coded.astype(np.float32).tobytes(),
        "lost": lost.astype(np.float32).tobytes(),
        "vectors": table.tobytes(),
    }


def _within(query_ids: np.ndarray, queries: np.ndarray, segment, k: int, rerank: int, books) -> tuple:
    ids, norms, dim = np.frombuffer(segment["ids"], np.int64), np.frombuffer(segment["norms"], np.float32), int(segment["dim"])
    table = np.frombuffer(segment["vectors"], np.float32).reshape(len(ids), dim)
    codes = np.frombuffer(segment["codes"], np.uint8).reshape(-1, len(ids))
    coded, lost = (np.frombuffer(segment[c], np.float32).astype(np.float64) for c in ("coded", "lost"))
    # room for the rounding of sums in single precision
    longest = float(np.sqrt(max(norms.max(), coded.max())))
    parts = _split(queries.astype(np.float64))
    tables = np.einsum("qsw,scw->qsc", parts, books.value[dim])
    p_out, v_out, s_out, own_out = [], [], [], []
    for i, qid in enumerate(query_ids.tolist()):
        # the table of a byte: the sums of its two codes' entries
        pair = (-2 * (tables[i, 0::2, None, :] + tables[i, 1::2, :, None])).reshape(len(codes), 256).astype(np.float32)
        near = norms.copy()
        for t, c in zip(pair, codes):
            near += t[c]
        if len(ids) > rerank:
            bound = np.partition(near, rerank - 1)[rerank - 1]
            at = np.flatnonzero(near < bound)
            at = np.concatenate((at, np.flatnonzero(near == bound)[: rerank - len(at)]))
        else:
            at = np.arange(len(ids))
        query = queries[i].astype(np.float64)
        exact = np.sqrt(((table[at].astype(np.float64) - query) ** 2).sum(1))
        if len(ids) > rerank:
            # the distance to the code less what the code lost is the least that a row can have
            square = query @ query
            slack = 1e-5 * (np.sqrt(square) + longest) ** 2
            least = np.sqrt(np.maximum(near - norms.astype(np.float64) + coded + square - slack, 0)) - lost * (1 + 1e-6)
            least[at] = np.inf
            left = np.flatnonzero(least < np.inf)
            size = rerank
            while True:
                kth = np.partition(exact, k - 1)[k - 1] if len(exact) >= k else np.inf
                left = left[least[left] <= kth]
                if not len(left):
                    break
                take = np.argpartition(least[left], size - 1)[:size] if len(left) > size else np.arange(len(left))
                more, left = left[take], np.delete(left, take)
                at = np.concatenate((at, more))
                exact = np.concatenate((exact, np.sqrt(((table[more].astype(np.float64) - query) ** 2).sum(1))))
                size *= 2
        own = (ids[at] == qid) & (table[at] == queries[i]).all(1)
        best = np.lexsort((~own, ids[at], exact))[:k]
        p_out.append(np.full(len(best), i))
        v_out.append(ids[at][best])
        s_out.append(exact[best])
        own_out.append(own[best])
    return tuple(map(np.concatenate, (p_out, v_out, s_out, own_out)))


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, rerank: int = 200, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query k near rows of df by Euclidean distance, nearest
    first, ties to the smaller vec_id; the query's own row is left out. All rows are coded
    and scanned; in each segment the rerank best by the scan get their exact distance, in double
    precision, and then all rows whose code does not rule out that they are as near as the k-th. So
    rows and scores are exact.

    Vectors that are null, all zero or hold null or non-finite components take no part, nor rows with a
    null id. Rows that repeat an id are candidates and queries of their own; of rows equal to the query
    in id and vector one is the query. Only vectors of the same length are compared; empty tables give
    an empty table; other columns, whatever their names, are ignored."""
    rows = vectors(df, id_col, vec_col, False)
    # bounded: at most SAMPLE vectors of a length reach the driver
    books = {}
    for (d,) in rows.select(F.size("v")).distinct().collect():
        own = rows.where(F.size("v") == d).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toPandas()["v"].tolist()
        books[int(d)] = train(np.array(own, np.float64).reshape(len(own), d))
    sent = df.sparkSession.sparkContext.broadcast(books)
    index = indexed(rows, partial(_build, books=sent), "codes binary, norms binary, coded binary, lost binary, vectors binary", "codes")
    return search(index, vectors(queries, id_col, vec_col, False), partial(_within, rerank=rerank, books=sent), k, False, "double")
