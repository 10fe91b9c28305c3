"""Exact quantiles by counting, without sorting a column in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 2_048
#: So many different values of one bucket are looked at one by one.
FEW = 4_096


def quantiles(df: DataFrame, wanted: list[tuple[str, float]]) -> list[float | None]:
    """The interpolated quantile of each (column, share): null for a column without values.

    Values are counted in buckets, combined before the shuffle; the bucket that holds the rank is
    counted in finer ones, until it holds few different values. Each pass reads df once for all that is
    wanted and brings a bounded number of counts to the driver. Nulls are left out, and NaN and
    infinities too: they have no bucket. df is read a few times, so it should be a table or cheap."""
    columns = sorted({c for c, _ in wanted})
    ok = {c: F.when(F.abs(c) < float("inf"), F.col(c).cast("double")) for c in columns}
    got = df.agg(*[f(ok[c]).alias(f"{k}_{c}") for c in columns for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    ranks = {}  # (column, rank) -> [values below, lower end, upper end, value]
    for c, p in wanted:
        n = got[f"n_{c}"]
        for r in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))} if n else ():
            ranks[c, r] = [0, got[f"lo_{c}"], got[f"hi_{c}"], None]
    while left := [k for k, s in ranks.items() if s[3] is None]:
        for k in left:
            if ranks[k][1] == ranks[k][2]:
                ranks[k][3] = ranks[k][1]
        spans = sorted({(k[0], *ranks[k][:3]) for k in left if ranks[k][3] is None})
        if not spans:
            break
        parts = []
        for i, (c, _, lo, hi) in enumerate(spans):
            x = ok[c]
            place = F.least(F.floor((x - lo) / (hi - lo) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
            parts.append(F.struct(F.lit(i).alias("span"), F.when(x.between(lo, hi), place).alias("bucket"), x.alias("x")))
        rows = df.select(F.explode(F.array(*parts)).alias("s")).select("s.*").where("bucket is not null")
        counts = rows.groupBy("span", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.approx_count_distinct("x").alias("d")).orderBy("span", "bucket").collect()
        few: dict[tuple[int, int], list] = {}
        small = [(r["span"], r["bucket"]) for r in counts if r["d"] <= FEW and r["lo"] < r["hi"]]
        held = {}
        for r in counts:
            held.setdefault(r["span"], []).append(r)
        chosen = {}
        for k in left:
            if ranks[k][3] is not None:
                continue
            i = spans.index((k[0], *ranks[k][:3]))
            below = ranks[k][0]
            for r in held[i]:
                if below + r["n"] > k[1]:
                    ranks[k][:3] = below, r["lo"], r["hi"]
                    chosen[k] = (i, r["bucket"])
                    break
                below += r["n"]
        near = sorted({b for b in chosen.values() if b in set(small)})
        if near:
            for r in rows.where(F.struct("span", "bucket").isin(*[F.struct(F.lit(i).alias("span"), F.lit(b).cast("int").alias("bucket")) for i, b in near])).groupBy("span", "bucket", "x").count().orderBy("x").collect():
                few.setdefault((r["span"], r["bucket"]), []).append((r["x"], r["count"]))
            for k, b in chosen.items():
                below = ranks[k][0]
                for x, n in few.get(b, ()):
                    if below + n > k[1]:
                        ranks[k][3] = x
                        break
                    below += n
    out: list[float | None] = []
    for c, p in wanted:
        n = got[f"n_{c}"]
        if not n:
            out.append(None)
            continue
        at = p * (n - 1)
        lo, hi = ranks[c, math.floor(at)][3], ranks[c, math.ceil(at)][3]
        out.append(lo + (hi - lo) * (at - math.floor(at)))
    return out
