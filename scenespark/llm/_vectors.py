"""Vectors in segments, searched with blocks of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, materialize, shared_dir, usable_vector

#: Vectors in a segment at most, in rows and in bytes, and bytes of queries that tasks get at once.
SEGMENT, SEGMENT_BYTES = 32_768, 8 << 20
BLOCK_BYTES = 4 << 20


def vectors(df: DataFrame, id_col: str, vec_col: str, zero_ok: bool) -> DataFrame:
    """vec_id, v: a written table of the rows with a usable vector and an id, also those that repeat an
    id, dealt to enough partitions for the size of the table and of the cluster."""
    rows = df.where(F.col(id_col).isNotNull() & usable_vector(vec_col, zero_ok)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("v"))
    n, total = rows.agg(F.count(F.lit(1)), F.sum(4 * F.size("v"))).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n // SEGMENT), -(-(total or 0) // SEGMENT_BYTES), min(cores, -(-n // 2048)), 1)
    return materialize(rows.repartition(parts), "vectors")


def segments(batches: Iterator[pd.DataFrame], build: Callable[[np.ndarray, np.ndarray], dict]) -> Iterator[pd.DataFrame]:
    """One row a segment: build gets the ids, sorted, and the vectors (float32) of one dimension."""
    held: dict[int, list] = {}

    def row(d: int) -> pd.DataFrame:
        ids = np.array([x[0] for x in held[d]], np.int64)
        table = np.array([x[1] for x in held[d]], np.float32).reshape(len(ids), d)
        order = np.argsort(ids, kind="stable")
        return pd.DataFrame([{"dim": d, "ids": ids[order].tobytes(), **build(ids[order], table[order])}])

    for pdf in batches:
        for i, v in zip(pdf["vec_id"].tolist(), pdf["v"]):
            own = held.setdefault(len(v), [])
            own.append((i, v))
            if len(own) == SEGMENT or 4 * len(own) * len(v) >= SEGMENT_BYTES:
                yield row(len(v))
                held[len(v)] = []
    for d in sorted(held):
        if held[d]:
            yield row(d)


def search(index: DataFrame, queries: DataFrame, within: Callable, k: int, largest: bool, score: str) -> DataFrame:
    """The k best of all segments for each row of queries (a written table), but that row itself.

    A stated query set against all rows, in blocks: each block, of about BLOCK_BYTES, goes to all tasks,
    which scan the index and keep the best of all their segments; what they find is written before
    the next block goes. within(query ids, query matrix, segment, k) gives four arrays: the query's
    place, vec_id, score, and whether it is the query's own row. One more than k is looked for, as the
    own row is among the candidates until it is known which it is."""
    spark = queries.sparkSession
    total = queries.agg(F.sum(4 * F.size("v") + 64)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    path = shared_dir(spark, "found")
    schema = f"block int, place int, query_id long, vec_id long, score {score}, own boolean"
    for block in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == block).orderBy("vec_id", "v").toPandas()
        by_dim = {}
        for d, own in mine.groupby(mine["v"].map(len)):
            by_dim[int(d)] = (own.index.to_numpy(np.int32), own["vec_id"].to_numpy(np.int64), np.array(own["v"].tolist(), np.float32).reshape(len(own), int(d)))
        sent = spark.sparkContext.broadcast(by_dim)
        index.mapInPandas(partial(_search, sent=sent, within=within, k=k + 1, largest=largest, block=block), schema).write.mode("append").parquet(path)
        sent.unpersist()
    found = spark.read.schema(schema).parquet(path)
    order: Column = F.col("score").desc() if largest else F.col("score").asc()
    each = Window.partitionBy("block", "place")
    best = found.withColumn("r", F.row_number().over(each.orderBy(order, "vec_id", F.desc("own")))).where(F.col("r") <= k + 1)
    # of rows equal to the query, id and vector, one is the query itself
    best = best.withColumn("at", F.min(F.when(F.col("own"), F.col("r"))).over(each)).where("at is null or r <> at")
    return best.withColumn("rank", F.col("r") - F.coalesce(F.col("r") > F.col("at"), F.lit(False)).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(place: np.ndarray, ids: np.ndarray, score: np.ndarray, own: np.ndarray, k: int, largest: bool) -> np.ndarray:
    """The rows that are among the k best of their place."""
    order = np.lexsort((~own, ids, -score if largest else score, place))
    p = place[order]
    first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))) if len(p) else np.zeros(0, np.int64)
    rank = np.arange(len(p)) - np.repeat(first, np.diff(np.append(first, len(p))))
    return order[rank < k]


def _search(batches: Iterator[pd.DataFrame], sent, within: Callable, k: int, largest: bool, block: int) -> Iterator[pd.DataFrame]:
    held: list[tuple] = []

    def settle() -> None:
        parts = [np.concatenate(x) for x in zip(*held)]
        keep = _best(parts[0], parts[2], parts[3], parts[4], k, largest)
        held[:] = [tuple(x[keep] for x in parts)]

    for pdf in batches:
        for _, segment in pdf.iterrows():
            if segment["dim"] in sent.value:
                place, qids, q = sent.value[segment["dim"]]
                at, v, s, own = within(qids, q, segment, k)
                held.append((place[at], qids[at], v, s, own))
                if len(held) > 8:
                    settle()
    if held:
        settle()
        place, qids, v, s, own = held[0]
        yield pd.DataFrame({"block": np.int32(block), "place": place, "query_id": qids, "vec_id": v, "score": s, "own": own})


def indexed(rows: DataFrame, build: Callable, schema: str, label: str) -> DataFrame:
    """The written segments of rows, which are deleted."""
    out = materialize(rows.mapInPandas(partial(segments, build=build), f"dim int, ids binary, {schema}"), label)
    discard(rows)
    return out
