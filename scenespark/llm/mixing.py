"""Mixing sources to target weights by subset-sum budget fitting over length histograms."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

#: Sources that the driver plans for; more raise an error.
MOST_SOURCES = 1_000_000
#: Budget in words up to which the dynamic programme runs.
WINDOW = 1 << 15


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def fill_targets(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """budget shared by weight; no source above most times its size, the excess shared again."""
    target = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    left = min(budget, most * sum(sizes))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
        gone = set(over)
        free = [i for i in free if i not in gone]
    return target


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths add up to about budget.

    Each length gives its share, rounded down; lengths in the order of their lost fractions, ties
    by seed, give one more each while that leaves more than WINDOW; for what remains a bounded
    knapsack over the documents left finds the reachable sum nearest to it; one document that is
    longer than the knapsack goes comes on top or instead where that is nearer still."""
    total = int((lengths * counts).sum())
    budget = max(0, min(int(budget), total))
    if not budget:
        return np.zeros(len(lengths), np.int64)
    share = budget / total
    take = np.minimum(np.floor(counts * share).astype(np.int64), counts)
    left = budget - int((lengths * take).sum())
    tie = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{n}".encode(), digest_size=8).digest(), "big") for n in lengths.tolist()], np.uint64)
    order = np.lexsort((tie, take - counts * share))
    for again in range(2):
        for i in order.tolist():
            n = int(lengths[i])
            if left - n < WINDOW // 2:
                continue
            most = int(counts[i] - take[i]) if again else min(1, int(counts[i] - take[i]))
            more = min(most, (left - WINDOW // 2) // n)
            take[i] += more
            left -= more * n
    # bounded knapsack by bit sets: bit s of a layer tells that a sum of s can be reached
    most = min(2 * left, 4 * WINDOW) + 1
    mask, layers, items = (1 << most) - 1, [1], []
    for i in np.argsort(tie).tolist():
        n, rest, chunk = int(lengths[i]), int(counts[i] - take[i]), 1
        rest = min(rest, most // n)
        while rest > 0 and not layers[-1] >> left & 1:
            k = min(chunk, rest)
            layers.append((layers[-1] | layers[-1] << (k * n)) & mask)
            items.append((i, k))
            rest, chunk = rest - k, chunk * 2
        if layers[-1] >> left & 1:
            break
    reach = layers[-1]
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> (left + 1)
    at = below
    if above and below != left:
        up = left + 1 + ((above & -above).bit_length() - 1)
        at = up if up - left < left - below else below
    first, off = take.copy(), left - at
    for layer, (i, k) in zip(reversed(layers[:-1]), reversed(items)):
        if not layer >> at & 1:
            take[i] += k
            at -= k * int(lengths[i])
    # lengths beyond the knapsack: one more, with what it took or instead of that
    best, least = take, abs(off)
    for start, rest in ((take, off), (first, left)):
        gap = np.where(start < counts, np.abs(lengths - rest), np.iinfo(np.int64).max)
        i = int(gap.argmin())
        if gap[i] < least:
            best, least = start.copy(), int(gap[i])
            best[i] += 1
    return best


def _plan(pdf: pd.DataFrame, seed: int, most: int) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    total, target = int((lengths * counts).sum()), float(pdf["target"].iloc[0])
    whole = min(most, int(target / total + 1e-12))
    more = fit(lengths, counts, round(target - whole * total), seed) if whole < most else np.zeros(len(lengths), np.int64)
    return pd.DataFrame({"__s": pdf["__s"], "size": lengths, "__whole": whole, "__more": more, "__of": counts})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: int = 2, seed: int = 42) -> DataFrame:
    """One row a document: id, size (words of the text), source_size, target and taken.

    Sources sorted by code point, null last, take the weights in turn; together they get budget times
    all words, and none more than most times its own, the excess being shared again. A source takes
    all its documents as often as its target allows and, of what remains, a part chosen by subset-sum
    over its lengths; the documents of a length come in the order of a seeded hash of the id. So
    taken is size times a whole number up to most. Documents of equal id and size are alike; null
    ids come in one order too. Empty documents and sources take nothing; an empty table gives an
    empty table. Only the named columns are read."""
    sized = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("size"))
    sized = materialize(sized, "sizes")
    found = sized.groupBy("__source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r["s"]) for r in found]
    targets = fill_targets(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], budget * sum(sizes), most)
    table = docs.sparkSession.createDataFrame([(i, r[0], s, t) for i, (r, s, t) in enumerate(zip(found, sizes, targets))], "__s int, __name string, source_size long, target double")
    table = F.broadcast(table) if len(found) <= 10_000 else table
    sized = sized.join(table, sized["__source"].eqNullSafe(table["__name"])).drop("__source", "__name")
    lengths = sized.where("size > 0").groupBy("__s", "size").agg(F.count(F.lit(1)).alias("n"), F.first("target").alias("target"))
    plan = materialize(lengths.groupBy("__s").applyInPandas(partial(_plan_of, seed=seed, most=most), "__s int, size long, __whole long, __more long, __of long"), "plan")
    # rank within (source, length), counted in buckets of a hash so that no group is one task
    buckets = max(64, sum(r["n"] for r in found) // 500_000)
    sized = sized.withColumn("__h", F.xxhash64(F.lit(seed), F.col("__id").cast("string"))).withColumn("__b", F.pmod("__h", F.lit(buckets)))
    some = plan.where("__more > 0 and __more < __of")
    partly = sized.join(some.select("__s", "size", "__more"), ["__s", "size"])
    counted = partly.groupBy("__s", "size", "__b").agg(F.count(F.lit(1)).alias("__n"))
    from pyspark.sql import Window

    before = counted.withColumn("__before", F.sum("__n").over(Window.partitionBy("__s", "size").orderBy("__b")) - F.col("__n")).drop("__n")
    local = F.row_number().over(Window.partitionBy("__s", "size", "__b").orderBy("__h", F.col("__id").asc_nulls_last()))
    ranked = partly.withColumn("__rank", local).join(before, ["__s", "size", "__b"])
    columns = [F.col("__id").alias(id_col), "size", "source_size", "target"]
    partly = ranked.join(some.select("__s", "size", "__whole"), ["__s", "size"]).select(*columns, (F.col("size") * (F.col("__whole") + (F.col("__rank") + F.col("__before") <= F.col("__more")).cast("long"))).alias("taken"))
    rest = sized.join(plan, ["__s", "size"], "left").where("__of is null or __more = 0 or __more = __of")
    rest = rest.select(*columns, F.coalesce(F.col("size") * (F.col("__whole") + (F.col("__more") > 0).cast("long")), F.lit(0)).cast("long").alias("taken"))
    return partly.unionByName(rest)


def _plan_of(pdf: pd.DataFrame, seed: int, most: int) -> pd.DataFrame:
    return _plan(pdf, seed, most)
