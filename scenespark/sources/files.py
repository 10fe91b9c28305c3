"""Telemetry tables and ASCII PLY files."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import contracts
from ..plans.tables import exists

# fixed values: accepted headers, in order of precedence, and defaults
ALIASES = {
    "t": ("t", "time", "timestamp", "time_s"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "lng", "longitude"),
    "alt": ("alt", "altitude", "height", "rel_alt"),
    "heading": ("heading", "yaw", "course"),
    "speed": ("speed", "vel", "velocity"),
    "hdop": ("hdop", "gps_hdop", "accuracy", "eph"),
    "rtk": ("rtk", "rtk_fix"),
}
DEFAULTS = {"alt": 80.0, "heading": 0.0, "speed": 0.0, "hdop": 1.5}
TRUE = ("1", "true", "yes", "rtk", "fix")


def parse_telemetry(rows: DataFrame) -> DataFrame:
    """Samples from string columns. t, lat and lon are needed; a row with a number that does not parse
    goes whole; an empty optional number takes its default; rtk is true for a few words. Rows come
    without an order: `sorted_telemetry` gives it."""
    names = {c.strip().lower(): c for c in reversed(rows.columns)}
    found = {k: next((names[a] for a in v if a in names), None) for k, v in ALIASES.items()}
    lost = [k for k in ("t", "lat", "lon") if found[k] is None]
    if lost:
        raise ValueError(f"no column for {', '.join(lost)}")
    ok, out = F.lit(True), []
    for k in ("t", "lat", "lon", "alt", "heading", "speed", "hdop"):
        if found[k] is None:
            out.append(F.lit(DEFAULTS[k]).alias(k))
            continue
        text = F.trim(F.col(f"`{found[k]}`"))
        empty, number = F.coalesce(text == "", F.lit(True)), F.nullif(text, F.lit("")).try_cast("double")
        ok = ok & (number.isNotNull() | (empty if k in DEFAULTS else F.lit(False)))
        out.append(F.coalesce(number, F.lit(DEFAULTS.get(k))).alias(k))
    rtk: Column = F.lit(False) if found["rtk"] is None else F.coalesce(F.lower(F.trim(F.col(f"`{found['rtk']}`"))).isin(*TRUE), F.lit(False))
    return rows.select(ok.alias("__ok"), *out, rtk.alias("rtk")).where("__ok").drop("__ok")


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """The samples of a CSV file in the order of time; an error if fewer than two rows are usable."""
    rows = parse_telemetry(spark.read.option("header", True).csv(path))
    if rows.limit(2).count() < 2:
        raise ValueError("fewer than two usable rows")
    return sorted_telemetry(rows)


def sorted_telemetry(rows: DataFrame) -> DataFrame:
    return rows.orderBy("t")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """i and line: the lines of one text file, numbered from 0, read in splits. Lines are counted by
    split first, in the order of the file's blocks, so no task holds the whole file."""
    raw = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__m"))
    count = raw.groupBy("__at").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__first"))
    before = count.select("__at", "__first", (F.sum("__n").over(Window.orderBy("__at")) - F.col("__n")).alias("__before"))
    return raw.join(F.broadcast(before), "__at").select((F.col("__m") - F.col("__first") + F.col("__before")).alias("i"), "line")


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z, r, g, b; colours 210 where there are none) and faces (fid, a, b, c) of an
    ASCII PLY file. Its elements come in the order in which the header names them."""
    lines = numbered_lines(spark, path)
    # a header is a few dozen lines; in a file that has none the search ends there
    head = [(r.i, r.line.split()) for r in lines.where("i < 1000 and line rlike '^(element |end_header)'").orderBy("i").collect()]
    end = next((i for i, w in head if w[0] == "end_header"), None)
    if end is None:
        raise ValueError("no PLY header")
    places, at = {}, end + 1
    for i, w in head:
        if w[0] == "element" and i < end:
            places[w[1]] = at, int(w[2])
            at += int(w[2])
    x = F.split(F.trim("line"), r"\s+")
    item = lambda k, kind: F.try_element_at(x, F.lit(k + 1)).cast(kind)

    def part(name: str, number: str, columns: list[Column]) -> DataFrame:
        start, n = places.get(name, (0, 0))
        return lines.where((F.col("i") >= start) & (F.col("i") < start + n)).select((F.col("i") - start).alias(number), *columns)

    colours = [F.coalesce(item(3 + k, "int"), F.lit(210)).alias(c) for k, c in enumerate("rgb")]
    return part("vertex", "vid", [*[item(k, "double").alias(c) for k, c in enumerate("xyz")], *colours]), part("face", "fid", [item(1 + k, "int").alias(c) for k, c in enumerate("abc")])


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a file; files that are no JSON object give null columns, and a missing path no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j")).select("j.*")


SCENE = """schema string, coordinate_frame string, origin struct<lat: double, lon: double, alt: double>,
    reconstruction struct<revision: string, measurement_authoritative: boolean, points: long, cameras: long>,
    mesh struct<revision: string, status: string, method: string, measurement_authoritative: boolean>,
    spatial struct<revision: string, available: boolean, generated_geometry_allowed: boolean>,
    generated_layers array<string>, measurement struct<source: string, generated_geometry_included: boolean>"""


def read_scene(spark: SparkSession, path: str) -> DataFrame:
    """The scene manifest, no row where there is none or it is no object."""
    return read_json(spark, path, SCENE).where("schema is not null or reconstruction is not null")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The samples of a dataset manifest and their splits (split, sample_id)."""
    whole = spark.read.text(path, wholetext=True)
    texts = whole.select(F.explode(F.from_json(F.get_json_object("value", "$.samples"), "array<string>")).alias("value"))
    splits = whole.select(F.explode(F.from_json(F.get_json_object("value", "$.splits"), "map<string, array<string>>")).alias("split", "ids"))
    return contracts.coerced_samples(texts), splits.select("split", F.explode("ids").alias("sample_id"))


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The samples below a folder, a JSON file each, in the order of their ids."""
    text = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return contracts.coerced_samples(text).orderBy("sample_id")


def read_colmap_images(spark: SparkSession, path: str) -> DataFrame:
    """name, quaternion, r, t and centre (ce, cn, cu) of each image of a COLMAP text model. After an image's
    line comes one line of its 2-D points, whatever it looks like; blank lines and comments may come
    before an image's line."""
    lines = numbered_lines(spark, path)
    # a line is an image's if it is usable and an even number of taken lines came before it since the last
    # break: runs of lines that are not skippable alternate image, points
    skip = (F.trim("line") == "") | F.col("line").startswith("#")
    chunk = F.floor(F.col("i") / 65_536)
    d = lines.select("i", "line", skip.alias("skip"), chunk.alias("c"))
    # the state (next line is a points line) at the end of a chunk, for either state at its start
    fold = lambda start: F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("i", "skip"))), lambda x: x["skip"]), F.lit(start), lambda open_, s: ~open_ & ~s)
    ends = d.groupBy("c").agg(fold(False).alias("from_image"), fold(True).alias("from_points")).orderBy("c").collect()
    state, starts = False, []
    for r in ends:
        starts.append((r["c"], state))
        state = r["from_points"] if state else r["from_image"]
    begin = spark.createDataFrame(starts, "c long, begin boolean")
    run = d.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "line", "skip"))).alias("rows")).join(F.broadcast(begin), "c")
    # in one pass over a chunk: the place of each row and whether a points line is due
    due = F.aggregate("rows", F.struct(F.col("begin").alias("due"), F.array().cast("array<boolean>").alias("seen")), lambda a, r: F.struct((~a["due"] & ~r["skip"]).alias("due"), F.concat(a["seen"], F.array(a["due"])).alias("seen")))["seen"]
    rows = run.select(F.explode(F.arrays_zip("rows", due.alias("due"))).alias("z")).select("z.rows.line", "z.rows.skip", "z.due").where("not due and not skip")
    x = F.split(F.trim("line"), r"\s+")
    n = lambda k: F.try_element_at(x, F.lit(k + 1)).try_cast("double")
    images = rows.where(F.size(x) >= 10).select(F.element_at(x, 10).alias("name"), F.array(*[n(k) for k in range(1, 5)]).alias("quaternion"), F.array(*[n(k) for k in range(5, 8)]).alias("t"))
    q = [F.col("quaternion")[k] for k in range(4)]
    images = images.withColumn("r", F.array(*geo.quaternion_matrix(*q)))
    return images.select("name", "quaternion", "r", "t", *[c.alias(a) for c, a in zip(geo.camera_center(F.col("r"), F.col("t")), ("ce", "cn", "cu"))])


def read_colmap_points(spark: SparkSession, path: str) -> DataFrame:
    """e, n, u, r, g, b and residual_m of the 3-D points of a COLMAP text model; short lines go."""
    x = F.split(F.trim("value"), r"\s+")
    at = lambda k, kind: F.element_at(x, k + 1).cast(kind)
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(x) >= 8))
    return lines.select(*[at(1 + k, "double").alias(a) for k, a in enumerate("enu")], *[at(4 + k, "int").alias(c) for k, c in enumerate("rgb")], at(7, "double").alias("residual_m"))


BUILDINGS = "buildings array<struct<id: string, height: double, ring: array<array<double>>>>"
METRES = 111_320.0


def near_place(lat: float, lon: float, at_lat: float, at_lon: float, within_m: float = 2500.0) -> bool:
    return math.hypot((lat - at_lat) * METRES, (lon - at_lon) * METRES * math.cos(math.radians(lat))) <= within_m


def buildings_near(buildings: DataFrame, lat: float, lon: float, radius_m: float = 1100.0, most: int = 700) -> DataFrame:
    """At most `most` buildings (id, height, ring of [lon, lat]) with a ring of at least four points of which
    one lies in the box of radius_m around a place, in the order of their ids."""
    dlat, dlon = radius_m / METRES, radius_m / (METRES * max(0.2, math.cos(math.radians(lat))))
    near = F.exists("ring", lambda p: p[1].between(lat - dlat, lat + dlat) & p[0].between(lon - dlon, lon + dlon))
    return buildings.where((F.size("ring") >= 4) & near).orderBy("id").limit(most)


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, BUILDINGS).select(F.explode("buildings").alias("b")).select("b.*")


CAMERAS = "width int, height int, fx double, fy double, cx double, cy double, distortion array<double>, frames array<struct<file: string, index: int, R: array<double>, t: array<double>, center: array<double>>>"


def read_training_views(spark: SparkSession, path: str, most_edge: int = 640) -> DataFrame:
    """The views of a training export, with intrinsics scaled so that the longer edge has at most most_edge
    pixels; an error for fewer than two. Pixels are not read here."""
    c = read_json(spark, path, CAMERAS)
    k = F.least(F.lit(1.0), most_edge / F.greatest("width", "height"))
    views = c.select(k.alias("scale"), *[(F.col(x) * k).alias(x) for x in ("fx", "fy", "cx", "cy")], *[F.round(F.col(x) * k).cast("int").alias(x) for x in ("width", "height")], "distortion", F.explode("frames").alias("f")).select("*", "f.*").drop("f")
    if views.limit(2).count() < 2:
        raise ValueError("at least two views are needed")
    return views


def recovered_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The jobs whose folder (twelve hexadecimal digits) holds a cloud: done, with the kind that their result
    tells, else upload."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "job string, kind string, status string")
    name = F.element_at(F.split("p", "/"), -2)
    found = lambda file: spark.read.format("binaryFile").option("pathGlobFilter", file).option("recursiveFileLookup", True).load(folder)
    jobs = found("cloud.json").select(F.col("path").alias("p")).select(name.alias("job")).where(F.col("job").rlike("^[0-9a-f]{12}$"))
    kinds = found("result.json").select(F.col("path").alias("p"), F.get_json_object(F.decode("content", "UTF-8"), "$.kind").alias("kind")).select(name.alias("job"), "kind")
    return jobs.join(kinds, "job", "left").select("job", F.coalesce("kind", F.lit("upload")).alias("kind"), F.lit("done").alias("status"))


def first_model(folders: DataFrame) -> DataFrame:
    """Of the folders (model, has_points) of a sparse reconstruction the one with the least number that holds
    points; the unnumbered one (model null) only if no other does."""
    return folders.where("has_points").orderBy(F.col("model").try_cast("int").asc_nulls_last()).limit(1)
