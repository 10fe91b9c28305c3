"""Connected components and shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import discard, written


def components(edges: DataFrame, seed: int = 1) -> DataFrame:
    """node, comp: the least node that links (a, b) reach.

    Rounds of random contraction: each node takes as its head the node of its closed neighbourhood
    with the least hash of the round, and the links between heads are the next round's. Whatever the
    order of the ids and the length of paths, about half of the nodes go in a round, so rounds grow
    with the logarithm of the number of nodes and all rounds together read a small multiple of the links.
    Each round is a written table; what later ones replace is deleted. Links with a null end are
    ignored, an end of a loop is a node; repeated links count once."""
    found, _ = contracted(edges, seed)
    return found


def contracted(edges: DataFrame, seed: int = 1) -> tuple[DataFrame, int]:
    """The components and how many rounds they took."""
    ends = edges.select("a", "b").where("a is not null and b is not null")
    every = written(ends.union(ends.select("b", "a")).distinct(), "links")
    nodes = every.select(F.col("a").alias("node"))
    links, heads = every.where("a <> b"), []
    while True:
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(seed + len(heads))).alias("h"), F.col(c).alias("v"))
        head = links.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("near"))
        head = written(head.select("node", F.least("near", rank("node"))["v"].alias("head")), "heads")
        heads.append(head)
        left, right = (head.select(F.col("node").alias(x), F.col("head").alias(f"h{x}")) for x in "ab")
        # the smaller of the two sides' links stay distinct: far fewer than before
        joined = links.join(left, "a").select("b", "ha").distinct().join(right, "b").where("ha <> hb")
        again = written(joined.select(F.col("ha").alias("a"), F.col("hb").alias("b")).distinct(), "links")
        discard(links)
        links = again
        if links.isEmpty():
            break
    # from the last round back: where a node's head went in later rounds
    top = heads[-1]
    for head in reversed(heads[:-1]):
        later = top.select(F.col("node").alias("head"), F.col("head").alias("far"))
        new = written(head.join(later, "head", "left").select("node", F.coalesce("far", "head").alias("head")), "heads")
        discard(head, top)
        top = new
    least = top.groupBy("head").agg(F.min("node").alias("comp"))
    labels = top.join(least, "head").select("node", "comp")
    loops = nodes.distinct().join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp"))
    out = written(labels.union(loops), "labels")
    discard(every, links, top)
    return out, len(heads)


def tracks(matches: DataFrame) -> DataFrame:
    """(track, img, kp) of matched keypoints (i, ka) - (j, kb): components over keypoints, without
    those that hold two keypoints of one image. A keypoint is img * 2**32 + kp."""
    node = lambda img, kp: F.col(img).cast("long") * (1 << 32) + F.col(kp)
    comp = components(matches.select(node("i", "ka").alias("a"), node("j", "kb").alias("b")))
    own = comp.select(F.col("comp").alias("track"), F.shiftright("node", 32).cast("int").alias("img"), F.col("node").bitwiseAND((1 << 32) - 1).alias("kp"))
    per_image = own.groupBy("track", "img").count().groupBy("track").agg(F.max("count").alias("m"), F.count(F.lit(1)).alias("images")).where("m = 1 and images >= 2")
    return own.join(per_image.select("track"), "track", "left_semi")
