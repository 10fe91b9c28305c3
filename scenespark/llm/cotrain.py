"""Quality classifier by co-training: one view reads a document's text, the other its metadata.

Both views of every document are written once. In each round both models score all unlabelled
documents, each task keeps those of which they are surest, and the surest of all are the examples
that each model gives the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, discard, frugal, materialize
from ._text import bytes_of, words

HASHED, SHAPE, META = 128, 10, 96
ROUNDS = 4
#: A model is sure of a document beyond this calibrated logit (a probability of 0.95).
SURE = 3.0

_KIND = np.zeros(256, np.int64)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("a") : ord("z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 5
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-?"]] = 6
_KIND[128:] = 7


def text_view(texts: pa.Array) -> np.ndarray:
    """Hashed words and the make-up of the whole text; a null or empty text has zeros."""
    raw, at = bytes_of(texts)
    n = len(texts)
    out = np.zeros((n, HASHED + SHAPE), np.float32)
    doc = np.repeat(np.arange(n), np.diff(at))
    kinds = np.bincount(doc * 8 + _KIND[raw], minlength=n * 8).reshape(n, 8)
    chars = np.maximum(np.diff(at), 1)[:, None]
    out[:, HASHED : HASHED + 7] = np.sqrt(kinds[:, 1:] / chars)
    h, _, length, first = words(texts)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    hashed = np.bincount(owner * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    total = np.maximum(count, 1)
    out[:, :HASHED] = np.sqrt(hashed / total[:, None])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    out[:, -3] = np.sqrt(np.bincount(owner, again, n) / total)
    out[:, -2] = np.bincount(owner, length, n) / total / 10
    out[:, -1] = np.log1p(count) / 10
    return out


def meta_view(size: list, names: list[list]) -> np.ndarray:
    """Size and hashed names of the metadata columns; null is a value of its own."""
    import zlib

    out = np.zeros((len(size), META), np.float32)
    room = (META - 8) // max(1, len(names))
    for i, s in enumerate(size):
        if s is None:
            out[i, 0] = 1
        else:
            x = np.log1p(max(float(s), 0.0))
            out[i, 1], out[i, 2] = x / 10, (x / 10) ** 2
            out[i, 3 + min(4, int(x) // 3)] = 1
    for k, column in enumerate(names):
        for i, v in enumerate(column):
            out[i, 8 + k * room + zlib.crc32(repr(v).encode()) % room] = 1
    return out


class Logistic:
    """Logistic regression on scaled features, by gradient steps with momentum."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-3):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = self._z(x)
        self.w = np.zeros(z.shape[1])
        speed, weight = 0 * self.w, weight / weight.sum()
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            g = z.T @ (weight * (p - y)) + decay * np.append(self.w[:-1], 0)
            speed = 0.9 * speed - 0.5 * g / max(1.0, np.sqrt(z.shape[1]) / 4)
            self.w = self.w + speed

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack((np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._z(x) @ self.w


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a logistic over logits, with Platt's softened targets; never negative
    weights, so that a better view score never lowers the result."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.clip(x, -15, 15)
    w = np.zeros(x.shape[1] + 1)
    w[:-1] = 1 / x.shape[1]
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        w[:-1] = np.maximum(w[:-1] - 0.05 * (x.T @ (p - t) / len(t)), 0)
        w[-1] -= 0.05 * (p - t).mean()
    return w


class Calibrated:
    """A model whose logits tell how often it is right on documents that it has not seen."""

    def __init__(self, model: Logistic, x: np.ndarray, y: np.ndarray):
        self.model, self.w = model, _calibrate(model.logit(x)[:, None], y)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.model.logit(x), -15, 15) * self.w[0] + self.w[1]


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, surest: Callable[[list, float], list], rounds: int = ROUNDS) -> dict | None:
    """Fits both views. In each round each view labels the unlabelled documents of which it is most
    sure, in the proportion of the labels, for the other view to learn from: surest(calibrated models,
    share of good ones) gives for each view the features (both views side by side) of those that it takes for
    bad and for good. A quarter of the labelled documents is kept out and calibrates each view and the
    combination. None without both labels."""
    own, held = np.arange(len(y)) % 4 != 3, np.arange(len(y)) % 4 == 3
    if min(np.bincount(y[own].astype(int), minlength=2)) < 2 or min(np.bincount(y[held].astype(int), minlength=2)) < 2:
        return None
    share, split = y[own].mean(), xt.shape[1]
    views = (xt[own], xm[own])
    learned = [([v], [y[own]], [np.ones(len(v))]) for v in views]
    for step in range(rounds + 1):
        models = [Logistic(*(np.concatenate(part) for part in view)) for view in learned]
        if step == rounds:
            break
        sure = [Calibrated(m, x[held], y[held]) for m, x in zip(models, (xt, xm))]
        for k, taught in enumerate(surest(sure, share)):
            for label, rows in enumerate(taught):
                if len(rows):
                    mine = rows[:, split:] if k == 0 else rows[:, :split]
                    for part, new in zip(learned[1 - k], (mine, np.full(len(rows), float(label)), np.full(len(rows), 0.3))):
                        part.append(new)
    z = np.stack((models[0].logit(xt[held]), models[1].logit(xm[held])), 1)
    return {"views": models, "each": [_calibrate(z[:, [k]], y[held]) for k in (0, 1)], "both": _calibrate(z, y[held])}


def probabilities(model: dict, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the text view, the metadata view, and both."""
    z = np.clip(np.stack((model["views"][0].logit(xt), model["views"][1].logit(xm)), 1), -15, 15)
    soft = lambda w, x: 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
    return soft(model["each"][0], z[:, [0]]), soft(model["each"][1], z[:, [1]]), soft(model["both"], z)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: id, text, size, names. view: both views in half precision."""
    for whole in batches:
        for b in cut(whole, 1, 1 << 20):
            both = np.hstack((text_view(b.column(1)), meta_view(b.column(2).to_pylist(), [c.to_pylist() for c in b.columns[3:]])))
            raw = np.clip(both, -60_000, 60_000).astype("<f2").tobytes()
            size = 2 * both.shape[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())], ["doc_id", "view"])


def _views(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f2").reshape(len(column), -1).astype(np.float64)


def _surest(batches: Iterator[pa.RecordBatch], state) -> Iterator[pa.RecordBatch]:
    """Columns: key, view. Of a task's rows that were not taken yet those of which each model is surest:
    teacher, label, how sure, key, view."""
    models, most, taken = state.value
    best: dict[tuple[int, int], list] = {(k, label): [] for k in (0, 1) for label in (0, 1)}
    for whole in batches:
        for b in cut(whole, 1, 4 << 20):
            keys, raw = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            x = _views(raw)
            new = ~np.isin(keys, taken)
            for k in (0, 1):
                z = models[k].logit(x[:, : HASHED + SHAPE] if k == 0 else x[:, HASHED + SHAPE :])
                for label in (0, 1):
                    sure = z if label else -z
                    at = np.flatnonzero(new & (sure > SURE))
                    at = at[np.lexsort((keys[at], -sure[at]))[: most[label]]]
                    rows = best[k, label] + [(float(sure[i]), int(keys[i]), raw[i]) for i in at.tolist()]
                    best[k, label] = sorted(rows, key=lambda r: (-r[0], r[1]))[: most[label]]
    rows = [(k, label, *r) for (k, label), held in best.items() for r in held]
    columns = list(zip(*rows)) or [[]] * 5
    yield pa.record_batch({n: pa.array(list(c), t) for n, c, t in zip(("teacher", "label", "sure", "key", "view"), columns, (pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.binary()))})


def _score(batches: Iterator[pa.RecordBatch], model, cut_off: float) -> Iterator[pa.RecordBatch]:
    """Columns: id, view."""
    for whole in batches:
        for b in cut(whole, 1, 4 << 20):
            if model.value is None:
                p = (np.ones(b.num_rows),) * 3
            else:
                x = _views(b.column(1).to_pylist())
                p = probabilities(model.value, x[:, : HASHED + SHAPE], x[:, HASHED + SHAPE :])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.asarray(x, np.float64)) for x in p), pa.array(p[2] >= cut_off)], ["doc_id", "p_text", "p_meta", "score", "keep"])


def _fit(views: DataFrame, known: DataFrame, most_labelled: int, taught: int, rounds: int) -> dict | None:
    """views: doc_id, view; known: doc_id, y."""
    sc = views.sparkSession.sparkContext
    with_id = views.where("doc_id is not null")
    known = known.hint("merge")  # labels grow with the input: never sent to all tasks
    order = (F.xxhash64("doc_id"), "doc_id")
    # bounded: most_labelled rows
    sample = with_id.join(known, "doc_id").orderBy(*order).limit(most_labelled).collect()
    got = sorted({(str(r["doc_id"]), r["y"], bytes(r["view"])) for r in sample})
    if not got:
        return None
    x, y = _views([v for _, _, v in got]), np.array([n for _, n, _ in got], float)
    # all documents without a label; those that look alike in both views count once
    pool = with_id.join(known.select("doc_id").hint("merge"), "doc_id", "left_anti").select(F.xxhash64("view").alias("key"), "view")
    pool = materialize(pool.groupBy("key").agg(F.first("view").alias("view")), "pool")
    taken: list[int] = []

    def surest(models: list, share: float) -> list:
        most = [max(1, round(taught * (1 - share))), max(1, round(taught * share))]
        state = sc.broadcast((models, most, np.array(sorted(taken), np.int64)))
        found = pool.mapInArrow(frugal(partial(_surest, state=state)), "teacher int, label int, sure double, key long, view binary")
        limit = F.when(F.col("label") == 0, most[0]).otherwise(most[1])
        # what tasks found, first in 64 groups of tasks' rows, then all: never many rows in one task
        for by in (["teacher", "label", F.pmod("key", F.lit(64))], ["teacher", "label"]):
            found = found.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sure"), "key"))).where(F.col("__r") <= limit).drop("__r")
        rows = found.collect()  # at most twice `taught`
        taken.extend({r["key"] for r in rows})
        pick = lambda k, label: [bytes(r["view"]) for r in rows if (r["teacher"], r["label"]) == (k, label)]
        return [[_views(v) if (v := pick(k, label)) else [] for label in (0, 1)] for k in (0, 1)]

    model = co_train(x[:, : HASHED + SHAPE], x[:, HASHED + SHAPE :], y, surest, rounds)
    discard(pool)
    return model


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size_col: str = "n_chars",
    meta_cols: tuple[str, ...] = ("source", "lang"),
    label_col: str = "quality",
    cut_off: float = 0.5,
    most_labelled: int = 6_000,
    taught: int = 125,
    rounds: int = ROUNDS,
) -> DataFrame:
    """id, p_text, p_meta, score and keep (score of at least cut_off) of every row of docs.

    The models are fitted on at most most_labelled labelled documents, those whose ids have the
    smallest hashes, and in each round each view teaches the other about as many as `taught` documents,
    the surest of all that have no label. All documents are scored in every round.
    Labels are 0 or 1, others and null ids are ignored, and of several the largest counts. Without two
    labels of each kind there is nothing to learn: all scores are 1 and every row is kept. Null and
    empty texts are scored as texts without characters, null metadata as a value of its own; repeated
    rows score alike; an empty table gives an empty table; other columns are ignored."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), F.col(size_col).cast("double").alias("s"), *(F.col(c).cast("string").alias(f"m{k}") for k, c in enumerate(meta_cols)))
    kind = named.schema["doc_id"].dataType.simpleString()
    views = materialize(named.mapInArrow(frugal(_features), f"doc_id {kind}, view binary"), "views")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast(kind).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    model = docs.sparkSession.sparkContext.broadcast(_fit(views, known, most_labelled, taught, rounds))
    return views.mapInArrow(frugal(partial(_score, model=model, cut_off=cut_off)), f"doc_id {kind}, p_text double, p_meta double, score double, keep boolean").withColumnRenamed("doc_id", id_col)
