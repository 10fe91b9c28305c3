"""Files that a scene leaves. Large tables are written as Spark writes them, many parts below a folder;
what must be one file is bounded by a cap of its own, or is written by one task in order."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cloud import sampled
from ..operators.mesh import face_attributes, vertex_attributes

# fixed values: the constant of the first spherical harmonic, and the header's fields
HARMONIC = 0.28209479177387814
GAUSSIAN_FIELDS = ("x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3")
CLOUD_MOST, FACES_MOST = 50_000, 250_000


def _ply_header(form: str, elements: list[tuple[str, int, list[str]]]) -> list[str]:
    out = ["ply", f"format {form} 1.0"]
    for name, n, fields in elements:
        out += [f"element {name} {n}", *[f"property {f}" for f in fields]]
    return [*out, "end_header"]


_PLACE = ["float x", "float y", "float z"]
_COLOUR = ["uchar red", "uchar green", "uchar blue"]


def _one_file(lines: DataFrame, path: str) -> None:
    """Lines (part, i, line) in their order as one text file below path: a file has one order, so the last
    step is one task, which streams from its sorted input."""
    lines.repartition(1).sortWithinPartitions("part", "i").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def _heads(df: DataFrame, lines: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "part int, i long, line string")


def ply_lines(points: DataFrame) -> DataFrame:
    """The body lines of an ASCII PLY file of points, in the order of seq."""
    return points.select("seq", F.format_string("%.4f %.4f %.4f %d %d %d %.3f", "e", "n", "u", "r", "g", "b", "conf").alias("line"))


def write_ply(points: DataFrame, path: str) -> None:
    """An ASCII PLY file of points with colour and confidence, in the order of seq."""
    head = _ply_header("ascii", [("vertex", points.count(), [*_PLACE, *_COLOUR, "float confidence"])])
    _one_file(_heads(points, head).unionByName(ply_lines(points).select(F.lit(1).alias("part"), F.col("seq").alias("i"), "line")), path)


def write_mesh_ply(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """An ASCII PLY file of a mesh: vertices in the order of vid, faces in that of fid; corners are numbered by
    the vertices' places, which are their vids if these count from 0."""
    head = _ply_header("ascii", [("vertex", vertices.count(), [*_PLACE, *_COLOUR]), ("face", faces.count(), ["list uchar int vertex_indices"])])
    v = vertices.select(F.lit(1).alias("part"), F.col("vid").cast("long").alias("i"), F.format_string("%.4f %.4f %.4f %d %d %d", "x", "y", "z", "r", "g", "b").alias("line"))
    f = faces.select(F.lit(2).alias("part"), F.col("fid").cast("long").alias("i"), F.format_string("3 %d %d %d", "a", "b", "c").alias("line"))
    _one_file(_heads(vertices, head).unionByName(v).unionByName(f), path)


def cloud_json(points: DataFrame, key: str = "id", most: int = CLOUD_MOST) -> DataFrame:
    """One row, value: a JSON object with at most `most` points, a seeded sample in the order of the key."""
    rows = sampled(points, key, most)
    inner = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("__k"), F.struct(*points.columns).alias("p")))), lambda x: x["p"])
    return rows.agg(inner.alias("points")).select(F.to_json(F.struct("points")).alias("value"))


def trajectory_geojson(telemetry: DataFrame) -> DataFrame:
    """One row, value: the flight as a GeoJSON line of [lon, lat, alt] in the order of time."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("t", F.array("lon", "lat", "alt").alias("p")))), lambda x: x["p"])
    shape = F.struct(F.lit("LineString").alias("type"), F.col("line").alias("coordinates"))
    return telemetry.agg(line.alias("line")).select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(F.lit("uav").alias("name")).alias("properties"))).alias("value"))


def write_spatial(parts: dict[str, DataFrame], path: str) -> None:
    """The tables of a spatial map, each a folder below path."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


SCHEMA_NAME = "scene/1"


def scene_manifest(scenes: DataFrame) -> DataFrame:
    """The manifest of each scene (scene_id, origin, points, cameras, mesh_status, mesh_method, has_spatial):
    what may be measured, and what never may, is fixed."""
    yes, no = F.lit(True), F.lit(False)
    return scenes.select(
        "scene_id",
        F.lit(SCHEMA_NAME).alias("schema"),
        F.lit("enu_m").alias("coordinate_frame"),
        "origin",
        F.struct(F.lit("metric-1").alias("revision"), yes.alias("measurement_authoritative"), F.col("points").cast("long").alias("points"), F.col("cameras").cast("long").alias("cameras")).alias("reconstruction"),
        F.struct(F.lit("mesh-1").alias("revision"), F.coalesce("mesh_status", F.lit("skipped")).alias("status"), F.col("mesh_method").alias("method"), no.alias("measurement_authoritative")).alias("mesh"),
        F.struct(F.when(F.col("has_spatial"), "spatial-1").alias("revision"), F.coalesce("has_spatial", no).alias("available"), no.alias("generated_geometry_allowed")).alias("spatial"),
        F.array().cast("array<string>").alias("generated_layers"),
        F.struct(F.lit("metric_cloud").alias("source"), no.alias("generated_geometry_included")).alias("measurement"),
    )


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON objects, null fields kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def encoded_gaussians(gaussians: DataFrame) -> DataFrame:
    """id and the seventeen numbers of each Gaussian (id, mean, scale, quat_wxyz, opacity, rgb): colours as the
    first harmonic, opacity as its logit, scales as logarithms, within bounds; quaternions as they are. An
    error for arrays of other lengths."""
    sizes = (F.size("mean") == 3) & (F.size("scale") == 3) & (F.size("quat_wxyz") == 4) & (F.size("rgb") == 3) & F.col("opacity").isNotNull()
    clip = lambda x, lo, hi: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    o = clip(F.col("opacity").cast("double"), 1e-4, 1.0 - 1e-4)
    zero = F.array(*[F.lit(0.0)] * 3)
    row = F.concat(
        F.transform("mean", lambda x: x.cast("double")), zero, F.transform("rgb", lambda x: (clip(x.cast("double"), 0.0, 1.0) - 0.5) / HARMONIC), F.array(F.log(o / (1 - o))),
        F.transform("scale", lambda x: F.log(clip(x.cast("double"), 1e-6, 1e3))), F.transform("quat_wxyz", lambda x: x.cast("double")),
    )
    good = F.when(F.coalesce(sizes, F.lit(False)), row).otherwise(F.raise_error(F.lit("gaussian attributes must share the same vertex count")).cast("array<double>"))
    return gaussians.select("id", F.transform(good, lambda x: x.cast("float")).alias("values"))


def gaussian_header(n: int) -> bytes:
    return ("\n".join(_ply_header("binary_little_endian", [("vertex", n, [f"float {f}" for f in GAUSSIAN_FIELDS])])) + "\n").encode("ascii")


def packed_gaussians(gaussians: DataFrame) -> DataFrame:
    """(first, rows, bytes): the binary body of a PLY file in pieces, in the order of id within each. A file is
    gaussian_header(total) and the pieces in the order of first."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame([{"first": int(pdf["id"].iloc[0]), "rows": len(pdf), "bytes": b"".join(struct.pack("<17f", *v) for v in pdf["values"])}])

    rows = encoded_gaussians(gaussians).repartitionByRange("id").sortWithinPartitions("id")
    return rows.mapInPandas(pack, "first long, rows long, bytes binary")


def training_views(cameras: DataFrame) -> DataFrame:
    """One row, value: the cameras.json of a training export; an error for fewer than two cameras, and no
    distortion where it is all zero. cameras: index, file, R, t, center and, alike for all, width, height,
    fx, fy, cx, cy, distortion."""
    if cameras.limit(2).count() < 2:
        raise ValueError("at least two cameras are needed")
    frames = F.array_sort(F.collect_list(F.struct("index", "file", "R", "t", "center")))
    bent = F.when(F.exists("distortion", lambda x: x != 0), F.col("distortion"))
    return cameras.agg(*[F.first(c).alias(c) for c in ("width", "height", "fx", "fy", "cx", "cy")], F.first(bent).alias("distortion"), frames.alias("frames")).select(F.to_json(F.struct("*")).alias("value"))


def mesh_json(vertices: DataFrame, faces: DataFrame, cloud: DataFrame | None = None, most: int = FACES_MOST) -> DataFrame:
    """One row, value: the mesh that a viewer reads, flat arrays in the order of vertices and faces, with
    confidence, source and state from the nearest point of the cloud. At most `most` faces, a seeded
    sample; nothing is safe to measure. No row for an empty mesh."""
    faces = sampled(faces, "fid", most)
    if cloud is None:
        looks = vertices.select("vid", F.lit(1.0).alias("conf"), F.lit("photogrammetry").alias("source"), F.lit("observed").alias("state"))
    else:
        looks = vertex_attributes(vertices, cloud)
    v = vertices.join(looks, "vid")
    f = faces.join(face_attributes(v, faces), "fid")

    def ordered(key: str, value: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"])

    vs = v.agg(F.flatten(ordered("vid", F.array(*[F.round(a, 3) for a in "xyz"]))).alias("positions"), F.flatten(ordered("vid", F.array("r", "g", "b"))).alias("colors"), *[ordered("vid", c).alias(n) for c, n in ((F.round("conf", 4), "vertex_confidence"), (F.col("source"), "vertex_source"), (F.col("state"), "vertex_state"))])
    fs = f.agg(F.flatten(ordered("fid", F.array("a", "b", "c"))).alias("indices"), *[ordered("fid", F.col(c)).alias(c) for c in ("face_confidence", "face_source", "face_state", "measurement_safe")])
    return vs.crossJoin(fs).where((F.size("positions") > 0) & (F.size("indices") > 0)).select(F.to_json(F.struct("*")).alias("value"))


def write_manifest(samples: DataFrame, splits: DataFrame, path: str, dataset_id: str = "dataset") -> None:
    """A dataset manifest as one JSON object, after its rules have been checked: an error names the first
    few that are broken."""
    from ..operators.contracts import manifest_violations

    bad = manifest_violations(samples.withColumnRenamed("license_name", "license") if "license_name" in samples.columns else samples, splits).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['subject']}" for r in bad))
    s = samples.agg(F.array_sort(F.collect_list(F.to_json(F.struct(*samples.columns)))).alias("samples"))
    p = splits.groupBy("split").agg(F.array_sort(F.collect_list("sample_id")).alias("ids")).agg(F.map_from_entries(F.collect_list(F.struct("split", "ids"))).alias("splits"))
    text = F.concat(F.lit(f'{{"dataset_id": "{dataset_id}", "samples": ['), F.array_join("samples", ", "), F.lit('], "splits": '), F.to_json("splits"), F.lit("}"))
    s.crossJoin(p).select(text.alias("value")).write.mode("overwrite").text(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples as JSON objects, after their rules have been checked."""
    from ..operators.contracts import sample_violations

    bad = sample_violations(samples).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['subject']}" for r in bad))
    write_json(samples, path)


def write_demo(telemetry: DataFrame, measured_m: float, true_m: float, path: str) -> None:
    """The demo's telemetry as CSV and its reference length with a check of itself."""
    root = path.rstrip("/")
    telemetry.orderBy("t").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{root}/telemetry")
    allowed = max(0.05 * true_m, 1.0)
    row = (true_m, round(measured_m, 3), allowed, math.isclose(measured_m, true_m, abs_tol=allowed))
    write_json(telemetry.sparkSession.createDataFrame([row], "true_length_m double, measured_m double, tolerance_m double, pass boolean"), f"{root}/reference")
