"""Descriptor matching between images and similarity fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written


#: So many descriptors of an image meet as many of another at once; so many distances are held at a time.
BLOCK, HELD = 4_096, 1 << 20


def _two(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x its one or two nearest rows of y, ties to the first: row of x, row of y, distance. A
    matrix product tells which can be among them; their distances are summed component by component."""
    out = []
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    for b in range(0, len(x), step := max(1, HELD // len(y))):
        with np.errstate(invalid="ignore", over="ignore"):
            g = xx[b : b + step, None] + yy[None] - 2 * (x[b : b + step] @ y.T)
        if np.isfinite(g).all():
            most = np.partition(g, 1, axis=1)[:, 1] if len(y) > 1 else g[:, 0]
            slack = 8 * np.finfo(float).eps * (x.shape[1] + 8) * (xx[b : b + step] + yy.max())
            row, col = np.nonzero(g <= (most + slack)[:, None])
        else:
            row, col = (v.ravel() for v in np.indices(g.shape))
        row = row + b
        s = np.zeros(len(row))
        for c in range(0, len(row), 1 << 16):
            part = slice(c, c + (1 << 16))
            u, v = x[row[part]], y[col[part]]
            with np.errstate(invalid="ignore", over="ignore"):
                for t in range(x.shape[1]):
                    s[part] += (u[:, t] - v[:, t]) * (u[:, t] - v[:, t])
        s = np.sqrt(s)
        o = np.lexsort((col, s, row))
        row, col, s = row[o], col[o], s[o]
        first = np.arange(len(row)) - np.searchsorted(row, row) < 2
        out.append((row[first], col[first], s[first]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _match(left: pa.Table, right: pa.Table) -> pa.Table:
    """Both ways: the one or two nearest of each keypoint."""
    keys = ("i", "j", "dim", "a", "b")
    sides = [t.take(pc.sort_indices(t, sort_keys=[("kp", "ascending")])).combine_chunks() if len(t) else t for t in (left, right)]
    parts = []
    if len(left) and len(right):
        one = [left.column(k)[0].as_py() for k in keys]
        flat = [np.asarray(pc.list_flatten(t.column("desc")).to_numpy(), float).reshape(len(t), one[2]) for t in sides]
        for mine, other, way in ((0, 1, True), (1, 0, False)):
            row, col, d = _two(flat[mine], flat[other])
            kp, near = (sides[m].column("kp").take(pa.array(v)) for m, v in ((mine, row), (other, col)))
            fixed = {k: pa.array([one[n]] * len(row), left.schema.field(k).type) for n, k in enumerate(keys[:2])}
            parts.append(pa.table({**fixed, "way": pa.array([way] * len(row), pa.bool_()), "kp": kp, "d": pa.array(d), "other": near}))
    if parts:
        return pa.concat_tables(parts)
    kind = left.schema.field("kp").type
    return pa.table({k: pa.array([], t) for k, t in (("i", left.schema.field("i").type), ("j", left.schema.field("j").type), ("way", pa.bool_()), ("kp", kind), ("d", pa.float64()), ("other", kind))})


def mutual_matches(desc: DataFrame, pairs: DataFrame, ratio: float = 0.8, least: int = 8) -> DataFrame:
    """(i, j, ka, kb, d): for each image pair the keypoints that are each other's nearest and clearly
    nearer than the second; images with fewer than least are left out. All keypoints of a pair meet, in blocks
    of which each gives two candidates a keypoint, so no distance becomes a row unless it may count.
    Descriptors that are null, hold a null or differ in length have no distance."""
    enough = desc.groupBy("img").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).select("img", F.ceil(F.col("c") / BLOCK).cast("int").alias("cuts"))
    kind = desc.schema["desc"].dataType.simpleString()
    d = desc.join(enough, "img").where("desc is not null and not exists(desc, x -> x is null)")
    d = d.select("img", "kp", F.col("desc") if kind == "array<float>" else F.col("desc").cast("array<double>").alias("desc"), F.size("desc").alias("dim"), F.pmod(F.xxhash64("kp"), F.col("cuts")).cast("int").alias("cut"))
    p = pairs.select("i", "j").distinct()
    for k in "ij":
        p = p.join(enough.select(F.col("img").alias(k), F.col("cuts").alias(f"c{k}")), k)

    def dealt(mine: str, other: str, own: str, theirs: str):
        met = p.join(d.withColumnRenamed("img", mine).withColumnRenamed("cut", own), mine)
        met = met.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(f"c{other}") - 1)))
        met = met.select(*[F.col(c).alias(c) for c in ("i", "j", "dim", "a", "b", "kp", "desc")])  # new names: both sides come from one table
        # so many that the few pairs of a small collection still go to different tasks
        n = max(int(desc.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * desc.sparkSession.sparkContext.defaultParallelism)
        return met.repartition(n, "i", "j", "dim", "a", "b").groupBy("i", "j", "dim", "a", "b")

    types = {c: desc.schema[c].dataType.simpleString() for c in ("img", "kp")}
    met = dealt("i", "j", "a", "b").cogroup(dealt("j", "i", "b", "a")).applyInArrow(_match, f"i {p.schema['i'].dataType.simpleString()}, j {p.schema['j'].dataType.simpleString()}, way boolean, kp {types['kp']}, d double, other {types['kp']}")
    best = met.groupBy("i", "j", "way", "kp").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, 2).alias("near"))
    best = written(best.where((F.size("near") > 1) & (F.col("near")[0]["d"] < ratio * F.try_element_at("near", F.lit(2))["d"])).select("i", "j", "way", "kp", F.col("near")[0]["d"].alias("d"), F.col("near")[0]["other"].alias("other")), "best")
    ahead, back = best.where("way").select("i", "j", F.col("kp").alias("ka"), F.col("other").alias("kb"), "d"), best.where("not way").select("i", "j", F.col("other").alias("ka"), F.col("kp").alias("kb"))
    return ahead.join(back, ["i", "j", "ka", "kb"])


def candidate_pairs(cameras: DataFrame, nearest: DataFrame, window: int = 4) -> DataFrame:
    """(i, j), i < j: cameras at most window apart in order, and each with its nearest ones (id, other)."""
    band = cameras.select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + window)).alias("j")).join(cameras.select(F.col("id").alias("j")), "j", "left_semi")
    return band.select("i", "j").union(nearest.select(F.least("id", "other"), F.greatest("id", "other"))).distinct()


def similarity_moments(pairs: DataFrame, *keys: str) -> DataFrame:
    """Means, covariances and the variance that a similarity fit of (px, py, pz) onto (qx, qy, qz)
    needs: one row a key, combined before the shuffle."""
    stats = [F.avg(f"{s}{a}").alias(f"m{s}{a}") for s in "pq" for a in "xyz"] + [F.covar_pop(f"p{a}", f"q{b}").alias(f"c{a}{b}") for a in "xyz" for b in "xyz"]
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.var_pop("px") + F.var_pop("py") + F.var_pop("pz")).alias("var"), *stats)


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in pdf.itertuples(index=False):
        if r.n < 2 or r.var <= 1e-12:
            continue
        mp, mq = np.array([r.mpx, r.mpy, r.mpz]), np.array([r.mqx, r.mqy, r.mqz])
        cov = np.array([[getattr(r, f"c{a}{b}") for a in "xyz"] for b in "xyz"])
        u, s, vt = np.linalg.svd(cov)
        sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
        rotation = u @ np.diag(sign) @ vt if r.n > 2 else np.eye(3)
        scale = float((s * sign).sum() / r.var) if r.n > 2 else float(s.sum() / r.var)
        if scale <= 0:
            continue
        out.append({"scale": scale, "rotation": rotation.ravel().tolist(), "translation": (mq - scale * rotation @ mp).tolist()})
    return pd.DataFrame(out, columns=["scale", "rotation", "translation"])


def fit_similarity(moments: DataFrame) -> DataFrame:
    """scale, rotation (row-major) and translation from moments; no row where there is no fit."""
    return moments.mapInPandas(lambda b: map(_fit, b), "scale double, rotation array<double>, translation array<double>")
