"""Exact Jaccard joins of word shingles by PartEnum signatures.

Two sets with Jaccard similarity of at least t differ in at most k = (1-t)/(1+t) * (|A|+|B|)
elements. Sets are put in bands by size. For a band whose largest size is r the domain is dealt
by hash into parts; a set's signature for a part is the band, the part and a hash of the set's
elements in it. The larger of two similar sets, A, can lose at most k <= 2(1-t)/(1+t)|A| of its
non-empty parts, so if it has more of them than that, at least one signature is equal in both.
Signatures of empty parts are therefore never made; the few sets (if any) without enough
non-empty parts are counted, and while there are any, all sets get the signatures of another
hash of the domain too, so no link can be missed. A set near the top of its band also takes
signatures of the next band.

Sets that share a signature are candidates. A group of few sets gives all its pairs; a larger
group gives only pairs with its first member (its hub). Candidates whose parity sketches
differ in more bits than k cannot be similar and go; the others are verified on whole texts.
Then, for each hub whose candidates fell into several components, the members outside its largest
component (few, as a rule) are compared with all members by sketch, in blocks, each pair of blocks a
task of its own. Of the pairs left so many are verified as would join all that they join; only where
one of these is refuted, all that are still between different components. So no link between
different components is lost, and a group of like sets is not expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ._shared import cut, discard, frugal, materialize
from ._text import U, mix, parts_sum, shingles

#: Groups of at most so many sets give all their pairs.
SMALL_GROUP = 6
#: Signatures a task sorts at once, about.
BUCKET = 2_000_000
#: Members compared with one copy of a hub's text.
CHUNK = 200
#: Members of a hub in a block, about.
BLOCK = 2_048
BAND = 1.5


def _bands(largest: int) -> np.ndarray:
    """The largest size of each band."""
    tops = [8]
    while tops[-1] < largest:
        tops.append(int(tops[-1] * BAND))
    return np.array(tops + [int(tops[-1] * BAND)], np.int64)


_TOPS = _bands(1 << 36)


def _slots(tops: np.ndarray, t: float) -> np.ndarray:
    """How many parts the domain has for a band."""
    return np.maximum(64, np.ceil(tops * min(1.0, 1.17 * 2 * (1 - t) / (1 + t)))).astype(np.int64)


def _most(total: np.ndarray, t: float) -> np.ndarray:
    """The largest difference of two sets with so many elements in all, with room for rounding."""
    return np.floor(total * (1 - t) / (1 + t) + 1e-6).astype(np.int64)


def _sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.concatenate((np.zeros(1, U), np.cumsum(values)))
    return c[at[1:]] - c[at[:-1]]


def _sketches(flat: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set the parity of its elements by the low bits of their hash; 2 to 4 bits an element."""
    n = np.diff(at)
    bits = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(bits)))
    doc = np.repeat(np.arange(len(n)), n)
    low = (mix(flat + U(0x51)) & (bits[doc] - 1).astype(U)).astype(np.int64)
    odd = (np.bincount(begin[doc] + low, minlength=begin[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[b // 8 : e // 8] for b, e in zip(begin[:-1].tolist(), begin[1:].tolist())]


def _signatures(flat: np.ndarray, at: np.ndarray, t: float, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For own and next band: signatures, the set of each, and how many each set has."""
    n = np.diff(at)
    band = np.searchsorted(_TOPS, n)
    doc = np.repeat(np.arange(len(n)), n)
    where = mix(flat + U((seed * 0x9E3779B97F4A7C15 + 0xA5) % (1 << 64)))
    for up in (0, 1):
        into = band + up
        # the next band's sizes begin above this band's top
        use = (n > 0) if not up else (n > 0) & (np.floor(n / t + 1e-6) > _TOPS[band])
        if not use.any():
            continue
        slots = np.where(use, _slots(_TOPS[into], t), 0)
        begin = np.concatenate(([0], np.cumsum(slots)))
        chosen = use[doc] if not use.all() else slice(None)
        d = doc[chosen]
        part = ((where[chosen] >> U(11)).astype(np.float64) * 2.0**-53 * slots[d]).astype(np.int64)
        sums, full = parts_sum(flat[chosen], begin[d] + part, int(begin[-1]))
        full = np.flatnonzero(full)
        owner = np.searchsorted(begin, full, side="right") - 1
        tag = mix((into[owner] * 1024 + seed).astype(U) * U(1 << 32) + (full - begin[owner]).astype(U))
        yield mix(sums[full] ^ tag), owner, np.bincount(owner, minlength=len(n))


def _describe(batches: Iterator[pa.RecordBatch], t: float, seeds: int, width: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in cut(whole, 1):
            flat, at = shingles(b.column(1), width)
            n = np.diff(at)
            enough = n == 0
            for seed in range(seeds):
                for _, _, have in _signatures(flat, at, t, seed):
                    enough |= have > _most(2 * n, t)
                    break
            yield pa.record_batch(
                {
                    "doc_id": b.column(0),
                    "n_shingles": pa.array(n.astype(np.int64)),
                    "key": pa.array(mix(_sum(flat, at) + n.astype(U)).view(np.int64)),
                    "check": pa.array(_sum(mix(flat + U(3)), at).view(np.int64)),
                    "enough": pa.array(enough),
                    "sketch": pa.array(_sketches(flat, at), pa.binary()),
                }
            )


def _deal(batches: Iterator[pa.RecordBatch], t: float, seeds: int, width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed signatures: for each slice of the input and each bucket one row."""
    for whole in batches:
        for b in cut(whole, 0, 8 << 20):
            flat, at = shingles(b.column(0), width)
            n = np.diff(at)
            keys = mix(_sum(flat, at) + n.astype(U))
            _, first = np.unique(keys, return_index=True)
            if len(first) < len(keys):  # copies in this slice have the same signatures
                keep = np.zeros(len(keys), bool)
                keep[first] = True
                flat, keys, n = flat[np.repeat(keep, n)], keys[keep], n[keep]
                at = np.concatenate(([0], np.cumsum(n)))
            found = [(s, o) for seed in range(seeds) for s, o, _ in _signatures(flat, at, t, seed)]
            if not found:
                continue
            sigs, owner = (np.concatenate(x) for x in zip(*found))
            bucket = ((sigs >> U(40)) % U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            low, owner, bucket = (sigs[order] & U(0xFFFFFFFF)).astype(np.uint32), owner[order].astype(np.uint32), bucket[order]
            has, begin = np.unique(bucket, return_index=True)
            end = np.append(begin[1:], len(bucket))
            rows = []
            for i, j in zip(begin.tolist(), end.tolist()):
                own, local = np.unique(owner[i:j], return_inverse=True)
                rows.append(np.array([len(own), j - i], np.int64).tobytes() + keys[own].tobytes() + low[i:j].tobytes() + local.astype(np.uint32).tobytes())
            yield pa.record_batch({"bucket": pa.array(has, pa.int32()), "packed": pa.array(rows, pa.binary())})


def _meet(table: pa.Table) -> pa.Table:
    """Candidates among the sets of one bucket: a < b by key; star marks pairs with a hub only."""
    sigs, keys = [], []
    for p in table.column("packed").to_pylist():
        m, n = np.frombuffer(p, np.int64, 2).tolist()
        own = np.frombuffer(p, U, m, 16)
        sigs.append(np.frombuffer(p, np.uint32, n, 16 + 8 * m))
        keys.append(own[np.frombuffer(p, np.uint32, n, 16 + 8 * m + 4 * n)].view(np.int64))
    sig, key = np.concatenate(sigs), np.concatenate(keys)
    names, node = np.unique(key, return_inverse=True)
    both = np.unique((sig.astype(U) << U(32)) | node.astype(U))  # a signature's sets, sorted, each once
    sig, node = both >> U(32), (both & U(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.append(begin, len(sig)))
    a, b, star = [], [], []
    for m in range(2, SMALL_GROUP + 1):
        g = begin[size == m]
        for i in range(m):
            for j in range(i + 1, m):
                a.append(node[g + i])
                b.append(node[g + j])
                star.append(np.zeros(len(g), bool))
    g, m = begin[size > SMALL_GROUP], size[size > SMALL_GROUP]
    if len(g):
        hub = np.repeat(node[g], m - 1)
        place = np.repeat(g + 1 - np.concatenate(([0], np.cumsum(m - 1)[:-1])), m - 1) + np.arange((m - 1).sum())
        a.append(hub)
        b.append(node[place])
        star.append(np.ones(len(hub), bool))
    a, b, star = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, star))
    pair = np.unique(((a * len(names) + b) << 1) | star.astype(np.int64)) if len(names) < 1 << 30 else None
    if pair is not None:
        star, pair = (pair & 1).astype(bool), pair >> 1
        a, b = pair // max(1, len(names)), pair % max(1, len(names))
    return pa.table({"a": names[a], "b": names[b], "star": star.astype(bool)})


def _folded(sketch: bytes, size: int) -> np.ndarray:
    s = np.frombuffer(sketch, np.uint64)
    while len(s) * 8 > size:
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


def _plausible(batches: Iterator[pd.DataFrame], t: float) -> Iterator[pd.DataFrame]:
    """Pairs that sizes and sketches do not rule out."""
    for pdf in batches:
        ok = []
        for n, m, x, y in zip(pdf["n_a"], pdf["n_b"], pdf["s_a"], pdf["s_b"]):
            size = min(len(x), len(y))
            ok.append(min(n, m) >= t * max(n, m) - 1e-6 and int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= (n + m) * (1 - t) / (1 + t) + 1e-6)
        yield pdf.loc[ok, ["a", "b"]]


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hub and chunk, the hub's own text first (or texts, if its id repeats)."""
    at_hub, own = None, []
    for whole in batches:
        for b in cut(whole, 4):
            flat, at = shingles(b.column(4), width)
            hubs, chunks, members, parts = (b.column(i).to_pylist() for i in range(4))
            left, right = [], []
            for i, (hub, chunk, member, role) in enumerate(zip(hubs, chunks, members, parts)):
                mine = flat[at[i] : at[i + 1]]
                if at_hub != (hub, chunk):
                    at_hub, own = (hub, chunk), []
                if role == 0:
                    own.append(mine)
                    continue
                for hubs_own in own:
                    both = len(hubs_own) + len(mine)
                    same = both - len(np.union1d(hubs_own, mine))
                    if den * same >= num * (both - same):
                        left.append(hub)
                        right.append(member)
                        break
            yield pa.record_batch({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _across(pdf: pd.DataFrame, t: float, whole: bool) -> pd.DataFrame:
    """Plausible pairs of different components between two blocks of one hub's members, side 0 (all
    outside the largest component) and side 1 (out tells whether outside): all of them (whole), or at
    most one less than there are components, so many that they join all that plausible pairs join.
    Pairs whose sketches differ little, which are hardly ever refuted, are taken first for that; then
    grp tells what they join, and the members so joined come too, as rows that are not pairs."""
    pdf = pdf.drop_duplicates(["side", "node", "sketch"])
    pdf = pdf.assign(bytes=pdf["sketch"].map(len)).sort_values(["side", "bytes", "n", "node"], ignore_index=True)
    node, n, size = (pdf[c].to_numpy(np.int64) for c in ("node", "n", "bytes"))
    out = pdf["out"].to_numpy(bool)
    names, comp = np.unique(pdf["comp"].to_numpy(np.int64), return_inverse=True)
    root = np.arange(len(names))  # the component that each has been joined to
    first = int((pdf["side"] == 0).sum())
    classes = [(int(b), first + np.flatnonzero(size[first:] == b)) for b in np.unique(size[first:])]
    tables: dict[tuple[int, int], np.ndarray] = {}
    sketches = pdf["sketch"].to_list()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    again = np.ones(first, bool)
    for sure in (False,) if whole else (True, False):
        look, again = again, np.zeros(first, bool)
        for i in np.flatnonzero(look).tolist():
            for b, rows in classes:
                lo, hi = np.searchsorted(n[rows], (n[i] * t - 1e-6, n[i] / t + 1e-6))
                own_root = root[comp[i]]
                at = np.arange(lo, hi)[root[comp[rows[lo:hi]]] != own_root]
                at = at[~out[rows[at]] | (node[rows[at]] > node[i])]  # two outside: in one order only
                if not len(at):
                    continue
                width = min(b, int(size[i]))
                if (b, width) not in tables:
                    tables[b, width] = np.stack([_folded(sketches[r], width) for r in rows])
                table, own = tables[b, width], _folded(sketches[i], width)
                half = max(1, table.shape[1] // 2)
                most = (n[rows[at]] + n[i]) * (1 - t) / (1 + t) + 1e-6
                # half of the bits rules most pairs out
                few = np.bitwise_count(table[at, :half] ^ own[:half]).sum(1, dtype=np.int32) <= most
                at, most = at[few], most[few]
                apart = np.bitwise_count(table[at] ^ own).sum(1, dtype=np.int32)
                few = apart <= most * (0.8 if sure else 1.0)
                again[i] |= bool(sure and (apart[~few] <= most[~few]).any())
                hit, apart = rows[at[few]], apart[few]
                if not whole and len(hit):
                    hit = hit[np.argsort(apart, kind="stable")]
                    roots, place = np.unique(root[comp[hit]], return_index=True)
                    hit = hit[place]
                    root[np.isin(root, roots)] = own_root
                left.append(np.minimum(node[hit], node[i]))
                right.append(np.maximum(node[hit], node[i]))
    a, b = np.concatenate(left), np.concatenate(right)
    if whole:
        return pd.DataFrame({"a": a, "b": b})
    group = root[comp]
    by_node = pd.Series(group, index=node)
    by_node = by_node[~by_node.index.duplicated()]
    grp = by_node.loc[a].to_numpy()
    at = np.isin(group, grp)
    return pd.DataFrame(
        {
            "grp": np.concatenate((grp, group[at])),
            "a": np.concatenate((a, node[at])),
            "b": np.concatenate((b, node[at])),
            "pair": np.arange(len(a) + at.sum()) < len(a),
            "side": np.concatenate((np.zeros(len(a), np.int32), pdf["side"].to_numpy(np.int32)[at])),
            "out": np.concatenate((np.zeros(len(a), bool), out[at])),
        }
    )


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (80, 100), width: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Joins documents whose shingle sets have a Jaccard similarity of at least threshold.

    Returns three tables:
    members (doc_id, n_shingles, rep): equal sets share rep, the smallest doc_id among them; rep is
    null for a set without elements or when all its rows have a null id;
    links (a, b): verified links between representatives that join all components;
    comps (node, comp): for each linked representative the smallest one reachable.

    Null, empty and blank texts have no elements and link with nothing. Rows with a null id take
    part in nothing; rows that repeat an id are one document, which links where any of its texts does. An empty
    table gives empty tables; other columns, whatever their names, are ignored."""
    num, den = threshold
    t = num / den
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    info_schema = "doc_id long, n_shingles long, key long, check long, enough boolean, sketch binary"
    seeds = 1
    while True:
        info = materialize(docs.mapInArrow(frugal(partial(_describe, t=t, seeds=seeds, width=width)), info_schema), "sets")
        few, total = info.agg(F.count_if(~F.col("enough")), F.sum("n_shingles")).first()
        if not few:
            break
        seeds += 1
    nodes = materialize(info.where("n_shingles > 0").groupBy("key", "check").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")).where("rep is not null"), "nodes")
    members = info.join(nodes.select("key", "check", "rep"), ["key", "check"], "left").select("doc_id", "n_shingles", "rep")
    buckets = max(6, -(-int(total or 0) * seeds // (2 * BUCKET)))
    # a text without an id must not be a hub
    dealt = docs.where("doc_id is not null").select("text").mapInArrow(frugal(partial(_deal, t=t, seeds=seeds, width=width, buckets=buckets)), "bucket int, packed binary")
    met = dealt.groupBy("bucket").applyInArrow(_meet, "a long, b long, star boolean")
    met = materialize(met.groupBy("a", "b").agg(F.max("star").alias("star")), "met")
    ends = [nodes.select(F.col("key").alias(x), F.col("rep").alias(f"r_{x}"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab"]
    ended = met.join(ends[0], "a").join(ends[1], "b")
    # a hub is the first by key, whatever its doc_id
    ended = ended.select(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b"), F.col("r_a").alias("hub"), F.col("r_b").alias("node"), "star", "n_a", "n_b", "s_a", "s_b").where("a < b")
    hubs = materialize(ended.where("star").select("hub", "node").distinct(), "hubs")
    near = ended.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInPandas(partial(_plausible, t=t), "a long, b long").distinct()
    links = materialize(verified(docs, near, num, den, width), "pairs")
    # rows that repeat an id are one document, whatever their texts
    several = members.where("doc_id is not null and rep is not null").select("doc_id", "rep").distinct()
    several = several.join(several.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a < hi").select("doc_id", "a"), "doc_id")
    links = links.union(materialize(several.where("a < rep").select("a", F.col("rep").alias("b")), "pairs"))
    comps = components(links)
    # what hubs did not settle: members of one hub in different components
    named = nodes.select(F.col("rep").alias("node"), "n", "sketch")
    family = hubs.union(hubs.select("hub", "hub").distinct())
    family = family.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = family.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("hub").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("m").alias("m"), (F.sum("m") - F.max("m")).alias("outside"))
    family = materialize(family.join(sizes.where("outside > 0"), "hub").withColumn("out", F.col("comp") != F.col("main")), "families")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    keep = ["hub", "lb", "rb", "node", "comp", "out"]
    sides = family.where("out").withColumns({"lb": own("outside"), "rb": every("m")}).select(*keep, F.lit(0).alias("side"))
    sides = sides.union(family.withColumns({"rb": own("m"), "lb": every("outside")}).select(*keep, F.lit(1).alias("side")))
    more = sides.join(named, "node").groupBy("hub", "lb", "rb").applyInPandas(partial(_across_group, t=t), "hub long, lb int, rb int, grp long, a long, b long, pair boolean, side int, out boolean")
    more = materialize(more, "across")
    group = ["hub", "lb", "rb", "grp"]
    pairs = more.where("pair").select(*group, "a", "b")
    if not pairs.isEmpty():
        found = materialize(verified(docs, pairs.select("a", "b").distinct(), num, den, width), "pairs")
        links, old = links.union(found), comps
        comps = components(links)
        discard(old)
        # a refuted pair may have stood for others that hold
        refuted = pairs.join(found, ["a", "b"], "left_anti").select(*group).distinct()
        rest = more.where("not pair").join(refuted, group, "left_semi").select(*group, F.col("a").alias("node"), "side", "out")
        rest = rest.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(named, "node")
        left = rest.groupBy(*group).applyInPandas(partial(_across_whole, t=t), "a long, b long")
        left = materialize(left.distinct(), "across")
        if not left.isEmpty():
            links, old = links.union(materialize(verified(docs, left, num, den, width), "pairs")), comps
            comps = components(links)
            discard(old)
        discard(left)
    discard(met, hubs, family, more)
    return members, links, comps


def _across_group(pdf: pd.DataFrame, t: float) -> pd.DataFrame:
    columns = ["hub", "lb", "rb"]
    return _across(pdf, t, False).assign(**{c: pdf[c].iloc[0] for c in columns})[[*columns, "grp", "a", "b", "pair", "side", "out"]]


def _across_whole(pdf: pd.DataFrame, t: float) -> pd.DataFrame:
    return _across(pdf, t, True)


def verified(docs: DataFrame, pairs: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """The pairs (a < b, doc ids) whose whole texts reach the threshold. A hub's pairs are cut into
    chunks, each with one copy of the hub's text, so that no task gets all pairs of a hub."""
    pairs = materialize(pairs, "candidates")
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / CHUNK)).alias("chunk"))
    need = dealt.select("a", "chunk", F.col("b").alias("member"), F.lit(1).alias("part"))
    need = need.union(dealt.select("a", "chunk", F.col("a").alias("member"), F.lit(0).alias("part")).distinct())
    # a merge join at every size: what is asked for grows with the input
    rows = need.join(docs.where("doc_id is not null").hint("merge"), need["member"] == docs["doc_id"]).select("a", "chunk", "member", "part", "text")
    rows = rows.repartition(F.col("a"), F.col("chunk")).sortWithinPartitions("a", "chunk", "part", "member")
    return rows.mapInArrow(frugal(partial(_verify, num=num, den=den, width=width)), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (80, 100), width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)
    for every row of docs; nulls and ties as in jaccard_links. A null id has a null component."""
    members, _, comps = jaccard_links(docs, id_col, text_col, threshold, width)
    out = members.join(comps, members["rep"] == comps["node"], "left")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", F.coalesce("comp", "rep", "doc_id").alias("component_id"))
