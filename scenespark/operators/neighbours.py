"""Exact nearest neighbours between two sets of points, in blocks of a k-d tree."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import discard, written

#: So many places a block, about, and so many queries that meet a block at once.
LEAF, QUERIES = 1_024, 8_192
#: Distances held at a time.
HELD = 1 << 18


def finite(*cols: str) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


class Tree:
    """Splits of space and, for each node, how many points it holds and their box."""

    def __init__(self, sample: np.ndarray, leaves: int, cell: float):
        axis, split, kids = [-1], [0.0], [(0, 0)]
        todo = [(0, np.arange(len(sample)), leaves)]
        while todo:
            node, held, most = todo.pop()
            if most < 2 or len(held) < 2:
                continue
            x = sample[held]
            wide = x.max(0) - x.min(0)
            a = int(wide.argmax())
            if wide[a] <= cell:
                continue
            v = np.sort(x[:, a])[(len(held) - 1) // 2]
            if v == x[:, a].max():
                v = x[x[:, a] < v, a].max()
            low = x[:, a] <= v
            part = min(max(round(most * low.mean()), 1), most - 1)
            axis[node], split[node], kids[node] = a, float(v), (len(axis), len(axis) + 1)
            axis += [-1, -1]
            split += [0.0, 0.0]
            kids += [(0, 0), (0, 0)]
            todo += [(kids[node][0], held[low], part), (kids[node][1], held[~low], most - part)]
        self.axis, self.split, self.kids = np.array(axis), np.array(split), np.array(kids)

    def fill(self, leaf: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.n = np.zeros(len(self.axis), int)
        self.lo, self.hi = np.full((len(self.axis), lo.shape[1]), np.inf), np.full((len(self.axis), lo.shape[1]), -np.inf)
        self.n[leaf], self.lo[leaf], self.hi[leaf] = n, lo, hi
        self.up = np.zeros(len(self.axis), int)
        for i in range(len(self.axis) - 1, -1, -1):  # parents come before their children
            if self.axis[i] >= 0:
                k = self.kids[i]
                self.n[i], self.lo[i], self.hi[i], self.up[k] = self.n[k].sum(), self.lo[k].min(0), self.hi[k].max(0), i
        self.leaves = np.flatnonzero((self.axis < 0) & (self.n > 0))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf in which a point lies."""
        node = np.zeros(len(x), int)
        while len(i := np.flatnonzero(self.axis[node] >= 0)):
            at = node[i]
            node[i] = self.kids[at, np.where(x[i, self.axis[at]] <= self.split[at], 0, 1)]
        return node

    def close(self, x: np.ndarray) -> np.ndarray:
        """A leaf whose box is near: at each split the side with the nearer box."""
        node = np.zeros(len(x), int)
        while len(i := np.flatnonzero(self.axis[node] >= 0)):
            at = node[i]
            l, r = self.kids[at].T
            gl, gr = _gap(x[i], self.lo[l], self.hi[l]), _gap(x[i], self.lo[r], self.hi[r])
            node[i] = np.where((gl < gr) | ((gl == gr) & (x[i, self.axis[at]] <= self.split[at])), l, r)
        return node

    def bound(self, x: np.ndarray, leaf: int, keep: int) -> np.ndarray:
        """A square that `keep` points are within: those of the leaf or of what holds it."""
        while self.n[leaf] < keep and leaf:
            leaf = self.up[leaf]
        if self.n[leaf] < keep:
            return np.full(len(x), np.inf)
        return (np.maximum(np.abs(x - self.lo[leaf]), np.abs(x - self.hi[leaf])) ** 2).sum(1)


def _gap(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The squared distance of points from boxes."""
    return (np.maximum(np.maximum(lo - x, x - hi), 0) ** 2).sum(-1)


def _wide(square):
    """A bound with room for what rounding may have cost."""
    return square * (1 + 1e-12) + 1e-300


def _coords(t: pa.Table | pa.RecordBatch, dims: int) -> np.ndarray:
    return np.stack([t.column(f"x{j}").to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(f"x{j}").to_numpy() for j in range(dims)], 1)


def _dealt(batches: Iterator[pa.RecordBatch], tree: Tree, dims: int, close: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _coords(b, dims)
        yield b.append_column("leaf", pa.array(tree.close(x) if close else tree.place(x), pa.int32()))


def _best(x: np.ndarray, y: np.ndarray, keep: int, squares: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first `keep` rows of y by distance and then by order: their keys and numbers."""
    few = min(keep, len(y))
    part = min(few + 24, len(y))
    keys, at = np.empty((len(x), few)), np.empty((len(x), few), int)
    for b in range(0, len(x), step := max(1, HELD // len(y))):
        q = x[b : b + step]
        d = (q[:, 0, None] - y[None, :, 0]) ** 2
        for j in range(1, x.shape[1]):
            d += (q[:, j, None] - y[None, :, j]) ** 2
        if part < len(y):
            i = np.sort(np.argpartition(d, part - 1, axis=1)[:, :part], axis=1)
            s = np.take_along_axis(d, i, 1)
        else:
            i, s = np.broadcast_to(np.arange(len(y)), d.shape), d
        s = s if squares else np.sqrt(s)
        o = np.argsort(s, axis=1, kind="stable")
        k = np.take_along_axis(s, o, 1)
        keys[b : b + step], at[b : b + step] = k[:, :few], np.take_along_axis(i, o, 1)[:, :few]
        if part < len(y):  # where more points are as far as the last one than were looked at
            for row in np.flatnonzero(k[:, few - 1] == k[:, -1]):
                s = d[row] if squares else np.sqrt(d[row])
                at[b + row] = np.argsort(s, kind="stable")[:few]
                keys[b + row] = s[at[b + row]]
    return keys, at


def _lists(offsets: np.ndarray, *columns: tuple[str, pa.Array]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([c for _, c in columns], names=[n for n, _ in columns]))


def _meet(q: pa.Table, d: pa.Table, dims: int, keep: int, squares: bool, carry: bool, tree: Tree | None) -> pa.Table:
    """The queries of a block with its points. With the tree, first: which other blocks may hold nearer ones,
    the nearest first."""
    d = d.take(pc.sort_indices(d, sort_keys=[("id", "ascending")])).combine_chunks() if len(d) else d
    x, y = _coords(q, dims), _coords(d, dims)
    keys, at = _best(x, y, keep, squares) if len(x) and len(y) else (np.empty((len(x), 0)), np.empty((len(x), 0), int))
    ok = np.ones(keys.shape, bool) if tree else keys <= q.column("far").to_numpy()[:, None]
    named = [("key", pa.array(keys[ok])), ("other", d.column("id").take(pa.array(at[ok])).combine_chunks())]
    if carry:
        named.append(("at", pa.array(y[at[ok], dims - 1])))
    near = _lists(np.r_[0, ok.sum(1).cumsum()], *named)
    if not tree:
        return pa.table({"q": q.column("q"), "near": near})
    out, gaps, leaves = np.zeros(len(x), int), [], []
    if len(x):
        own = int(q.column("leaf")[0].as_py())
        far = _wide(tree.bound(x, own, keep))
        if keys.shape[1] == keep:
            far = np.minimum(far, _wide(keys[:, -1] if squares else keys[:, -1] ** 2))
        lo, hi = tree.lo[tree.leaves], tree.hi[tree.leaves]
        apart = (np.maximum(np.maximum(lo - x.max(0), x.min(0) - hi), 0) ** 2).sum(1)
        others = tree.leaves[(apart <= far.max()) & (tree.leaves != own)]
        for b in range(0, len(x), step := max(1, HELD // max(len(others), 1))):
            g = _gap(x[b : b + step, None], tree.lo[others][None], tree.hi[others][None])
            row, col = np.nonzero(g <= far[b : b + step, None])
            o = np.lexsort((g[row, col], row))
            row, col = row[o], col[o]
            out[b : b + step] = np.bincount(row, minlength=len(g))
            gaps.append(g[row, col])
            leaves.append(others[col])
    cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
    more = _lists(np.r_[0, out.cumsum()], ("gap", pa.array(cat(gaps, float))), ("leaf", pa.array(cat(leaves, np.int32))))
    return pa.table({"q": q.column("q"), "id": q.column("id"), **{f"x{j}": q.column(f"x{j}") for j in range(dims)}, "near": near, "more": more})


def _met(q: DataFrame, d: DataFrame, blocks: int, f, schema: str) -> DataFrame:
    """Queries and points with the same leaf through f; a leaf with many queries in several groups."""
    cuts = F.broadcast(q.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("cuts")))
    q = q.join(cuts, "leaf").withColumn("cut", F.pmod(F.xxhash64("q"), F.col("cuts")).cast("int")).drop("cuts")
    d = d.join(cuts, "leaf").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
    conf = q.sparkSession
    n = min(blocks, max(int(conf.conf.get("spark.sql.shuffle.partitions")), 4 * conf.sparkContext.defaultParallelism))
    deal = lambda t: t.repartition(n, "leaf", "cut").groupBy("leaf", "cut")
    return deal(q).cogroup(deal(d)).applyInArrow(f, schema)


def neighbour_lists(left: DataFrame, right: DataFrame, k: int, axes: tuple[str, ...], same: bool = False, cell: float | None = None, squares: bool = False, carry: bool = False) -> DataFrame:
    """(id, near): for each of left its k nearest of right, (key, other) each, nearest first, ties to the
    smaller id; with carry also `at`, their value on the last axis. The key is the distance, or with squares its
    square: which of the two orders decides ties. same leaves the point itself out.

    Exact. Points at one place count as often as can matter, so copies do not multiply. right is dealt into
    blocks of a k-d tree whose splits come from a sample, and each block's count and box are known. Each query meets
    the points of a block close to it; then only those blocks that reach into the ball of its last neighbour, the
    nearest few first, and what they show makes the ball smaller. Blocks are not cut below a size of cell."""
    keep, dims = k + 1 if same else k, len(axes)
    at = [(F.col(a).cast("double") + 0.0).alias(f"x{j}") for j, a in enumerate(axes)]
    xs = [f"x{j}" for j in range(dims)]
    taken = lambda t: t.where((finite(*axes) & F.col("id").isNotNull()) if same else finite(*axes)).select("id", *at)
    l, r = taken(left), taken(right)
    n = r.count()
    few = max(1, n // max(32_768, n // 128))
    sample = r.select(*xs).where(F.pmod(F.xxhash64(*xs), F.lit(few)) == 0).distinct().toArrow() if n else None
    ids, kind = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    item = f"array<struct<key:double,other:{kind}{',at:double' if carry else ''}>>"
    if not n:
        return l.select("id", F.lit(None).cast(item).alias("near")).limit(0)
    tree = Tree(_coords(sample, dims), round(len(sample) * few / LEAF), cell or 0.0)
    first = Window.partitionBy(*xs).orderBy("id")
    held = r.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= keep).drop("__r")
    coords = ", ".join(f"x{j} double" for j in range(dims))
    d = written(held.mapInArrow(partial(_dealt, tree=tree, dims=dims, close=False), f"id {kind}, {coords}, leaf int"), "blocks")
    box = d.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{c}{x}") for x in xs for c, f in (("lo", F.min), ("hi", F.max))]).toArrow()
    sides = [np.stack([box.column(f"{c}{x}").to_numpy() for x in xs], 1) for c in ("lo", "hi")]
    tree.fill(box.column("leaf").to_numpy(), box.column("n").to_numpy(), *sides)
    numbered = l.select(F.monotonically_increasing_id().alias("q"), "id", *xs)
    q = written(numbered.mapInArrow(partial(_dealt, tree=tree, dims=dims, close=True), f"q long, id {ids}, {coords}, leaf int"), "queries")
    work = partial(_meet, dims=dims, keep=keep, squares=squares, carry=carry)
    blocks = len(tree.leaves) + q.count() // QUERIES
    met = written(_met(q, d, blocks, lambda a, b: work(a, b, tree=tree), f"q long, id {ids}, {coords}, near {item}, more array<struct<gap:double,leaf:int>>"), "met")
    discard(q)
    last = F.try_element_at("near", F.lit(keep))["key"]
    far = F.when(F.size("near") < keep, F.lit(float("inf"))).otherwise(_wide(last if squares else last * last))
    done, todo, visits = met.where(F.size("more") == 0).select("id", "near"), met.where(F.size("more") > 0), 4
    while not todo.isEmpty():
        radius = F.coalesce(F.try_element_at("near", F.lit(keep))["key"], F.lit(float("inf")))
        asked = todo.select("q", *xs, radius.alias("far"), F.explode(F.slice("more", 1, visits)["leaf"]).alias("leaf"))
        seen = _met(asked, d, blocks, lambda a, b: work(a, b, tree=None), f"q long, near {item}")
        rest = F.slice("more", visits + 1, 1 << 30)
        both = todo.select("q", F.struct("id", *xs, rest.alias("more")).alias("own"), "near").unionByName(seen.select("q", F.lit(None).alias("own"), "near"))
        both = both.groupBy("q").agg(F.max_by("own", F.col("own").isNotNull()).alias("own"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, keep).alias("near"))
        both = both.select("q", "own.*", "near").withColumn("more", F.filter("more", lambda m: m["gap"] <= far))
        met = written(both, "met")
        done = done.unionByName(met.where(F.size("more") == 0).select("id", "near"))
        todo, visits = met.where(F.size("more") > 0), visits * 4
    return done.withColumn("near", F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)) if same else done


def nearest(left: DataFrame, right: DataFrame, k: int, axes: tuple[str, ...] = ("e", "n", "u"), same: bool = False, cell: float | None = None, squares: bool = False) -> DataFrame:
    """(id, rank, other, d): the k nearest points of right for each of left, as neighbour_lists finds them."""
    got = neighbour_lists(left, right, k, axes, same, cell, squares).select("id", F.posexplode("near").alias("rank", "p"))
    return got.select("id", (F.col("rank") + 1).alias("rank"), F.col("p.other").alias("other"), (F.sqrt("p.key") if squares else F.col("p.key")).alias("d"))
