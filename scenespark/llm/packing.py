"""Packing by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._encoders import WordEncoder, encoder
from ._shared import cut, frugal, materialize


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths) that hold all lengths. Lengths go longest first into the pack
    with the most room, whole groups of equal packs at a time; a new pack opens if none has room."""
    open_packs: dict[int, list[list]] = {}  # room -> [count, lengths]
    done: list[tuple[int, list[int]]] = []
    rooms: list[int] = []  # a heap, largest first
    from heapq import heappop, heappush

    def put(room: int, count: int, lengths: list[int]) -> None:
        if not room:
            done.append((count, lengths))
            return
        if room not in open_packs:
            open_packs[room] = []
            heappush(rooms, -room)
        open_packs[room].append([count, lengths])

    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            room = -rooms[0] if rooms else 0
            if room < n:
                put(size - n, left, [n])
                break
            group = open_packs[room]
            count, lengths = group.pop()
            if not group:
                del open_packs[room]
                heappop(rooms)
            used = min(count, left)
            if count > used:
                put(room, count - used, lengths)
            put(room - n, used, [*lengths, n])
            left -= used
    for group in open_packs.values():
        done += [(c, x) for c, x in group]
    return done


def _cut_texts(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc, seen, part = encoder(WordEncoder, path), np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
    for whole in batches:
        for b in cut(whole, 1, 2 << 20):
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            flat, at = enc.encode(texts)
            doc, start, length, crc, total, ids = [], [], [], [], [], []
            for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                own = np.append(flat[lo:hi], np.uint32(end_id)).astype("<u4")
                for s in range(0, len(own), size):
                    piece = own[s : s + size]
                    doc.append(i)
                    start.append(s)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(own))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
            n = np.array(length, np.int64)
            order = np.argsort(n, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], np.diff(n[order]) > 0)))
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n))))
            rank += seen[n]
            seen += np.bincount(n, minlength=size + 1)
            out = {"doc_id": b.column(0).take(pa.array(doc, pa.int64())), "start": pa.array(start, pa.int64()), "length": pa.array(n), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64()), "part": pa.array([part] * len(n), pa.int32()), "local": pa.array(rank)}
            yield pa.record_batch(out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))


def _place(batches: Iterator[pd.DataFrame], table) -> Iterator[pd.DataFrame]:
    start, sequence, offset = table.value
    for pdf in batches:
        key = (pdf["length"].to_numpy(np.int64) << 48) + pdf["rank"].to_numpy(np.int64)
        at = np.searchsorted(start, key, side="right") - 1
        yield pdf.drop(columns="rank").assign(sequence_id=sequence[at] + key - start[at], offset=offset[at])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of at most size tokens: id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids, if asked), so that the pieces of a sequence lie one after the other from 0.

    A document is its ids and end_id; it is cut at multiples of size. The driver packs the histogram of
    lengths, which has at most size entries, and sends back the patterns; a piece's rank among those of
    its length (tasks before it, then its place in its task) tells its slot. Null and empty texts are
    end_id alone; every row counts as a document, repeated or not, also with a null id; an empty
    table gives an empty table; other columns are ignored."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, local long" + ", ids array<int>" * with_ids
    pieces = materialize(docs.mapInArrow(frugal(partial(_cut_texts, path=tokenizer_path, size=size, end_id=end_id, with_ids=with_ids), tables=True), schema), "pieces")
    tasks = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {int(r[0]): int(r[1]) for r in tasks.groupBy("length").agg(F.sum("n")).collect()}
    rows, next_rank, next_sequence = [], dict.fromkeys(histogram, 0), 0
    for count, lengths in pack_histogram(histogram, size):
        at = 0
        for n in lengths:
            rows.append(((n << 48) + next_rank[n], next_sequence, at))
            next_rank[n] += count
            at += n
        next_sequence += count
    rows.sort()
    table = docs.sparkSession.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(1, np.int64),) * 3)
    before = tasks.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    # a row a task and length: that grows with the input, so it is never sent to all tasks
    ranked = pieces.join(before.hint("merge"), ["part", "length"]).withColumn("rank", F.col("local") + F.col("before"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    out = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*columns, "rank").mapInPandas(partial(_place, table=table), out).withColumnRenamed("doc_id", id_col)
