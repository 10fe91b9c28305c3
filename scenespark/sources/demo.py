"""Generated scenes: a flight, a cloud and a dataset, the same for a seed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.geo import Origin

# fixed values: the demo's place and building
PLACE, ROOF, EAVE_M = Origin(28.5448, 77.1924, 216.0), 12.0, 20.0


def telemetry(spark: SparkSession, n: int = 64, origin: Origin = PLACE) -> DataFrame:
    """A pass from west to east, 0.45 s a sample, with a burst of bad fixes."""
    i = F.col("id").cast("double")
    e, north, u = -55.0 + 110.0 * (i / (n - 1)), -4.0 + 1.2 * F.sin(i / 7.0), 78.0 + 0.8 * F.sin(i / 5.0)
    lat, lon, _ = origin.geodetic(e, north, u)
    hdop = F.when(F.col("id").between(22, 26), 3.4).otherwise(F.round(0.9 + 0.15 * F.abs(F.sin(i / 9.0)), 2))
    return spark.range(n).select(F.round(i * 0.45, 3).alias("t"), lat.alias("lat"), lon.alias("lon"), (origin.alt + u).alias("alt"), (88.0 + 2.0 * F.sin(i / 11.0)).alias("heading"), F.lit(12.4).alias("speed"), hdop.alias("hdop"), F.lit(False).alias("rtk"))


def cloud(spark: SparkSession, seed: int = 7) -> DataFrame:
    """Roof, facades, terrain with a road, trees and a courtyard that was hardly seen. Random numbers are
    Spark's: the shape is the demo's, not each value."""

    def part(k: int, n: int) -> DataFrame:
        d = spark.range(n).withColumn("k", F.lit(k))
        return d.select("*", *[F.rand(seed * 100 + 10 * k + j).alias(f"a{j}") for j in range(3)], *[F.randn(seed * 100 + 10 * k + 5 + j).alias(f"z{j}") for j in range(3)])

    def point(d: DataFrame, e, n, u, rgb: tuple, conf, seen: int) -> DataFrame:
        colour = [c if not isinstance(c, int) else F.lit(c) for c in rgb]
        return d.select("k", "id", e.alias("e"), n.alias("n"), u.alias("u"), *[c.cast("int").alias(x) for c, x in zip(colour, "rgb")], conf.alias("conf"), F.lit(seen).alias("observations"))

    score = lambda *x: scores.point_confidence(*[F.lit(float(v)) for v in x])
    uniform = lambda c, lo, hi: lo + F.col(c) * (hi - lo)
    roof = part(0, 420)
    roof = point(roof, uniform("a0", -10, 10), uniform("a1", 2, 14), ROOF + 0.08 * F.col("z0"), (186, 168, 148), score(8, 0.85, 0.9, 0.82, 0.3), 8)
    wall = part(1, 260).withColumn("side", F.floor(F.col("a2") * 4))
    along = F.when(F.col("side") < 2, uniform("a0", -10, 10)).otherwise(F.when(F.col("side") == 2, -10.0).otherwise(10.0) + 0.05 * F.col("z0"))
    across = F.when(F.col("side") >= 2, uniform("a0", 2, 14)).otherwise(F.when(F.col("side") == 0, 2.0).otherwise(14.0) + 0.05 * F.col("z1"))
    wall = point(wall, along, across, uniform("a1", 0.2, ROOF), (164, 142, 122), score(3, 0.35, 0.7, 0.82, 1.4), 3)
    land = part(2, 900).withColumns({"e": uniform("a0", -60, 60), "n": uniform("a1", -35, 40)}).where("not (e > -11 and e < 11 and n > 1.5 and n < 14.5)")
    road, far = F.abs(F.col("n") + 6) < 3.2, F.hypot("e", "n") > 42
    conf = scores.point_confidence(F.when(road, 5.0).otherwise(4.0), F.lit(0.55), F.lit(0.75), F.lit(0.78), F.when(far, 0.8).otherwise(0.4)) * F.when(far, 0.55).otherwise(1.0)
    ground = tuple(F.when(road, a).otherwise(b) for a, b in zip((62, 64, 68), (78, 112, 74)))
    land = point(land, F.col("e"), F.col("n"), 0.15 * F.sin(F.col("e") / 9.0) + 0.12 * F.col("z0"), ground, conf, 4)
    trees = [point(part(3 + i, 80), x + 3.2 * F.col("z0"), y + 3.2 * F.col("z1"), F.abs(3.5 + 1.1 * F.col("z2")), (46, 92, 48), score(2, 0.4, 0.5, 0.78, 2.0), 2) for i, (x, y) in enumerate(((-28, 18), (32, 22), (18, -18)))]
    court = point(part(6, 90), uniform("a0", -6, 6), uniform("a1", 5, 11), uniform("a2", 0, 1.6), (90, 88, 70), score(1, 0.15, 0.4, 0.78, 3.5), 1)
    out = roof
    for p in (wall, land, *trees, court):
        out = out.unionByName(p)
    return out.select((F.col("k") * 1000 + F.col("id")).alias("seq"), "e", "n", "u", "r", "g", "b", "conf", "observations", F.lit("proxy").alias("source"), F.array(F.lit("proxy_scene")).alias("provenance"), F.lit(None).cast("double").alias("uncertainty_m"), F.lit(True).alias("synthetic"))


def eave(spark: SparkSession, origin: Origin = PLACE) -> DataFrame:
    """The two ends, as latitude, longitude and height, of the demo building's eave, 20 m apart."""
    row = lambda x: [c.alias(k) for c, k in zip(origin.geodetic(F.lit(x), F.lit(2.0), F.lit(ROOF)), ("lat", "lon", "height"))]
    one = spark.range(1)
    return one.select(F.lit("a").alias("end"), *row(-EAVE_M / 2)).union(one.select(F.lit("b"), *row(EAVE_M / 2)))


def dataset(spark: SparkSession, scenes: int = 12, views: int = 6, size: int = 128) -> tuple[DataFrame, DataFrame]:
    """Samples and splits of a made-up dataset, without its images: rings of cameras around each scene."""
    angle = lambda v: 2.0 * math.pi * v / max(views, 1)
    pose = [F.array(*[F.lit(float(x)) for x in (1, 0, 0, math.cos(angle(v)) * 12, 0, 1, 0, math.sin(angle(v)) * 12, 0, 0, 1, 18, 0, 0, 0, 1)]) for v in range(views)]
    k = F.array(*[F.lit(float(x)) for x in (0.8 * size, 0, size / 2, 0, 0.8 * size, size / 2, 0, 0, 1)])
    name = F.format_string("scene_%04d", "id")
    file = lambda form: F.concat(name, F.lit(form))
    s = spark.range(scenes).select(
        name.alias("sample_id"), name.alias("scene_id"), F.array(*[file(f"/images/view_{v:03d}.jpg") for v in range(views)]).alias("frame_paths"), F.array(*[F.lit(float(v)) for v in range(views)]).alias("timestamps_s"),
        F.array(*pose).alias("camera_poses_w2c"), F.array(*[k] * views).alias("intrinsics"), F.create_map(*[F.lit(x) for p in (("lat", 0.0), ("lon", 0.0), ("alt", 0.0)) for x in p]).alias("origin"),
        file("/visible_geometry.json").alias("visible_geometry_path"), file("/visibility.json").alias("visibility_path"), F.lit("synthetic generated").alias("license"), F.col("id").alias("scene"),
    )
    from ..operators.contracts import scene_split

    return s.drop("scene"), s.select(scene_split(F.col("scene")).alias("split"), "sample_id")
