"""Tracks: clamped as-of interpolation, speeds and reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import lerp_heading
from ..functions.scores import clip

METRES_PER_DEGREE = 111320.0
LINEAR = ("lat", "lon", "alt", "speed", "hdop")


def interpolate(samples: DataFrame, probes: DataFrame, span: float = 86_400.0) -> DataFrame:
    """For each probe (track, probe_id, at) the sample at that time: clamped to the first and last one,
    linear between two, headings along the shorter arc, rtk only if both have it. A track without
    samples gives no rows.

    Tracks are cut into ranges of span seconds, so a long one is many tasks' work; the last sample before
    a range and the first after it are carried into it. In a range one pass in each direction finds
    each probe's neighbours: linear in the length of a track."""
    fields = ["t", *LINEAR, "heading", "rtk"]
    s = samples.select("track", F.col("t").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast("long").alias("probe_id"), "seq", F.struct(*fields).alias("__s"))
    p = probes.select("track", F.col("at").alias("__at"), F.lit(1).alias("__kind"), "probe_id", F.lit(None).cast("long").alias("seq"), F.lit(None).cast(s.schema["__s"].dataType).alias("__s"))
    both = s.unionByName(p).withColumn("__range", F.floor(F.col("__at") / span).cast("long"))
    ends = both.groupBy("track", "__range").agg(F.min_by("__s", F.when(F.col("__kind") == 0, F.struct("__at", "seq"))).alias("f"), F.max_by("__s", F.when(F.col("__kind") == 0, F.struct("__at", "seq"))).alias("l"))
    earlier = Window.partitionBy("track").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("track").orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("track", "__range", F.last("l", ignorenulls=True).over(earlier).alias("__earlier"), F.last("f", ignorenulls=True).over(later).alias("__later"))
    both = both.join(ends, ["track", "__range"])
    w = Window.partitionBy("track", "__range")
    up = w.orderBy("__at", "__kind", "seq", "probe_id").rowsBetween(Window.unboundedPreceding, 0)
    down = w.orderBy(F.desc("__at"), F.desc("__kind"), F.desc("seq"), F.desc("probe_id")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"a": F.last("__s", ignorenulls=True).over(up), "b": F.last("__s", ignorenulls=True).over(down)}).where("__kind = 1")
    both = both.withColumns({"a": F.coalesce("a", "__earlier"), "b": F.coalesce("b", "__later")})
    a, b = F.coalesce("a", "b"), F.coalesce("b", "a")
    both = both.select("track", "probe_id", F.col("__at").alias("at"), a.alias("a"), b.alias("b")).where("a is not null")
    gap = F.col("b.t") - F.col("a.t")
    w_ = F.when(gap == 0, 0.0).otherwise((F.col("at") - F.col("a.t")) / F.nullif(gap, F.lit(0.0)))
    both = both.withColumn("w", w_)
    line = lambda c: (F.col(f"a.{c}") + F.col("w") * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c)
    clamped = F.when(gap == 0, F.col("a.t")).otherwise(F.col("at"))
    return both.select("track", "probe_id", clamped.alias("t"), *map(line, LINEAR), lerp_heading(F.col("a.heading"), F.col("b.heading"), F.col("w")).alias("heading"), (F.col("a.rtk") & F.col("b.rtk")).alias("rtk"))


# fixed values: factors, bounds and weights of speeds and reliability
JUMP_FACTOR, JUMP_LEAST, MISSING_DT = 6, 40, 1e-3


def steps(samples: DataFrame) -> DataFrame:
    """Each sample with dt and ground speed from the one before it in its track."""
    w = Window.partitionBy("track").orderBy("t", "seq")
    lag = lambda c: F.lag(c).over(w)
    dt = F.greatest(F.col("t") - lag("t"), F.lit(MISSING_DT))
    north = (F.col("lat") - lag("lat")) * METRES_PER_DEGREE
    east = (F.col("lon") - lag("lon")) * METRES_PER_DEGREE * F.cos(F.radians(lag("lat")))
    return samples.withColumns({"dt": dt, "ground_speed": F.sqrt(north * north + east * east) / dt, "speed_before": lag("speed")})


def is_jump() -> Column:
    v = F.col("ground_speed")
    return (v > JUMP_FACTOR * F.greatest("speed", "speed_before", F.lit(1.0))) & (v > JUMP_LEAST)


def reliability(samples: DataFrame) -> DataFrame:
    """track, median_hdop, jumps and reliability in [0.1, 1]."""
    g = steps(samples).groupBy("track").agg(F.median("hdop").alias("median_hdop"), F.count_if(is_jump()).alias("jumps"), F.count(F.lit(1)).alias("n"), F.bool_or("rtk").alias("any_rtk"))
    score = clip(1 - (F.col("median_hdop") - 0.8) / 4, 0.15, 1.0) - F.least(F.lit(0.6), F.col("jumps") / F.col("n") * 8) + F.when(F.col("any_rtk"), 0.12).otherwise(0.0)
    return g.select("track", "median_hdop", "jumps", clip(score, 0.1, 1.0).alias("reliability"))
