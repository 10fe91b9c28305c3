"""Operators on small tables, against numbers worked out by hand or in numpy."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenespark import capabilities
from scenespark.functions import camera, geo
from scenespark.operators import cloud, contracts, frames, mesh, quantiles, route, sfm, surface
from scenespark.sources import demo, files, sinks
from scenespark.streaming import jobs


def grid(spark, nx, ny, height):
    """A grid mesh, two triangles a cell."""
    v = [(j * nx + i, float(i), float(j), float(height(i, j)), 210, 210, 210) for j in range(ny) for i in range(nx)]
    f = []
    for j in range(ny - 1):
        for i in range(nx - 1):
            a = j * nx + i
            f += [(len(f), a, a + 1, a + nx + 1), (len(f) + 1, a, a + nx + 1, a + nx)]
    return spark.createDataFrame(v, "vid long, x double, y double, z double, r int, g int, b int"), spark.createDataFrame(f, "fid long, a long, b long, c long")


def test_quantiles(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.normal(size=20) * 1e9])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),), (float("inf"),)], "x double")
    shares = [0.0, 0.005, 0.3, 0.5, 0.77, 0.995, 1.0]
    assert quantiles.quantiles(df, [("x", p) for p in shares]) == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12)
    assert quantiles.quantiles(df.limit(0), [("x", 0.5)]) == [None]


def test_long_track_in_ranges(spark):
    from scenespark.operators import telemetry

    cols = "track long, seq long, t double, lat double, lon double, alt double, heading double, speed double, hdop double, rtk boolean"
    s = spark.range(100_000).select(F.lit(1).cast("long").alias("track"), F.col("id").alias("seq"), (F.col("id") * 2.0).alias("t"), *[(F.col("id") * 1.0).alias(c) for c in ("lat", "lon", "alt")], F.lit(0.0).alias("heading"), F.lit(1.0).alias("speed"), F.lit(1.0).alias("hdop"), F.lit(True).alias("rtk"))
    assert s.columns == [c.split()[0] for c in cols.split(", ")]
    p = spark.range(-5, 100_000).select(F.lit(1).cast("long").alias("track"), F.col("id").alias("probe_id"), (F.col("id") * 2.0 + 1).alias("at"))
    got = telemetry.interpolate(s, p, span=997.0)
    want = F.least(F.greatest(F.col("probe_id") + 0.5, F.lit(0.0)), F.lit(99_999.0))
    assert got.count() == 100_005 and got.where(F.abs(F.col("lat") - want) > 1e-9).count() == 0


def test_offset_and_crowded_clouds(spark):
    """Far from the origin, flat, with a clump and with many copies of one point."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(0, 100, (300, 3)) * [1, 1, 0.001], rng.normal(size=(200, 3)) * 1e-4 + 50, np.tile([[20.0, 20, 0]], (150, 1))]) + [1e5, -2e5, 30]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, e double, n double, u double")
    got = {}
    for r in cloud.nearest(df, df, 4, same=True).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other, r.d))
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        want = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:4]
        mine = [(o, dist) for _, o, dist in sorted(got[i])]
        assert [o for o, _ in mine] == want or np.allclose([v for _, v in mine], d[want], rtol=1e-9, atol=1e-12)


def test_cleaning_and_its_safety_valve(spark):
    rng = np.random.default_rng(2)
    e, n = rng.uniform(-60, 60, (2, 900))
    u = 0.08 * e + 4 * np.sin(n / 15) + rng.normal(size=900) * 0.15
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(e, n, u))] + [(2000 + i, float(i), float(i), 40.0) for i in range(8)] + [(3000 + i, 900.0 + i, 0.0, 0.0) for i in range(8)]
    df = spark.createDataFrame([*rows, (4000, float("nan"), 0.0, 0.0)], "id long, e double, n double, u double")
    eyes = spark.createDataFrame([(20.0 * i - 80, 0.0, 80.0) for i in range(9)], "e double, n double, u double")
    left = {r.id for r in cloud.clean_cloud(df, eyes).collect()}
    assert not left & set(range(2000, 4001)) and len(left) > 0.9 * 900
    assert cloud.clean_cloud(df.limit(150)).count() == 150  # too few to judge


def test_voxels_and_rasters_leave_holes_out(spark):
    cols = "seq long, e double, n double, u double, r int, g int, b int, conf double, observations int, source string, provenance array<string>, uncertainty_m double, synthetic boolean"
    row = lambda i, e: (i, e, 0.1, 0.1, 1, 2, 3, 0.5, 1, "a", ["x"], None, False)
    df = spark.createDataFrame([row(0, 0.1), row(1, float("nan")), row(2, float("inf")), row(3, None)], cols)
    assert cloud.voxel_fuse(df, 1.0).count() == 1 and mesh.raster(df, 1.0).count() == 1
    assert cloud.capped(df, 10).count() == 4 and cloud.capped(spark.createDataFrame([row(i, i * 1.0) for i in range(50)], cols), 10).count() <= 10


def test_incremental_fusion_depends_on_chunks(spark):
    cols = "seq long, e double, n double, u double, r int, g int, b int, conf double, observations int, source string, provenance array<string>, uncertainty_m double, synthetic boolean"
    chunk = lambda i: spark.createDataFrame([(i, 0.2, 0.2, 0.2, 9, 9, 9, 0.5, 1, "ab"[i % 2], ["x"], None, False)], cols)
    fusion = jobs.Fusion(1.0)
    for i in range(3):
        fusion.step(chunk(i), i)
    one = fusion.fused.first()
    # 0.5 and 2 % for one point; then twice 4 % for two points each
    assert one.conf == pytest.approx(0.5 + 0.02 + 0.04 + 0.04) and one.observations == 3 and one.source == "a"
    assert [s["points"] for s in fusion.stats] == [1, 1, 1]
    whole = cloud.voxel_fuse(chunk(0).unionByName(chunk(1)).unionByName(chunk(2)), 1.0).first()
    assert whole.conf == pytest.approx(0.56)


def test_unions_samples_and_caps(spark):
    flat = spark.range(200).select(F.col("id"), F.col("id").cast("double").alias("e"), F.lit(0.0).alias("n"), F.lit(0.0).alias("u"))
    far = flat.select((F.col("id") + 1000).alias("id"), "e", (F.lit(0.0) + F.when(F.col("id") < 50, 0.5).otherwise(90.0)).alias("n"), "u")
    assert cloud.with_external(far, flat, 100).count() == 250 and cloud.with_external(far, flat, 201).count() == 400
    s = [r.id for r in cloud.sampled(flat, "id", 20, 1).collect()]
    assert len(set(s)) == 20 and s == [r.id for r in cloud.sampled(flat.repartition(7), "id", 20, 1).collect()] and s != [r.id for r in cloud.sampled(flat, "id", 20, 2).collect()]
    box = {r.axis: (r.lo, r.hi) for r in cloud.framing(flat).collect()}
    assert box["e"] == (4.0, 196.0)


def look_at(eye, target):
    z = np.subtract(target, eye) / np.linalg.norm(np.subtract(target, eye))
    x = np.cross(z, [0.0, 0, 1]) if abs(z[2]) < 0.999 else np.array([1.0, 0, 0])
    x /= np.linalg.norm(x)
    return np.stack([x, np.cross(z, x), z], 1)


def test_only_the_slope_toward_the_camera_is_seen(spark):
    v, f = grid(spark, 24, 16, lambda i, j: max(0.0, 8 - 0.9 * abs(i - 10)))
    eye = (-25.0, 8.0, 6.0)
    cams = spark.createDataFrame([(0, *eye, look_at(eye, (10.0, 8.0, 3.0)).ravel().tolist(), 700.0, 640, 480), (1, 0.0, 0.0, 9.0, [1.0], 1.0, 1, 1)], "cam int, e double, n double, u double, rotation array<double>, fx double, width int, height int")
    parts = mesh.spatial_map(v, f, cams)
    seen = parts["faces"].join(route.centroids(v, f).select("fid", "e", "u"), "fid")
    share = lambda rows: rows.agg(F.avg((F.col("seen") > 0).cast("double"))).first()[0]
    assert share(seen.where("e between 2 and 9 and u > 0.5")) > 0.6 and share(seen.where("e between 11 and 18 and u > 0.5")) < 0.05
    s = parts["summary"].first()
    assert s.faces == 690 and s.largest_unseen_patch > 10 and s.faultlines > 0
    p = parts["patches"].orderBy("patch").first()
    assert p.faces == s.largest_unseen_patch and p.area_hint_m2 > 0 and not p.measurement_safe
    none = mesh.spatial_map(v.limit(0), f.limit(0), cams)["summary"].first()
    assert (none.faces, none.seen_fraction, none.faultlines) == (0, 0.0, 0)


def test_blocks_of_cameras_give_the_same(spark, monkeypatch):
    v, f = grid(spark, 12, 12, lambda i, j: 0.0)
    eyes = [(float(3 * i), 5.0, 12.0) for i in range(5)]
    cams = spark.createDataFrame([(i, *e, look_at(e, (e[0], 5.0, 0.0)).ravel().tolist(), 300.0, 320, 240) for i, e in enumerate(eyes)], "cam int, e double, n double, u double, rotation array<double>, fx double, width int, height int")
    faces = route.centroids(v, f)
    one = sorted(map(tuple, mesh.seen_counts(faces, cams).collect()))
    monkeypatch.setattr(mesh, "BLOCK", 2)
    monkeypatch.setattr(mesh.blocks_of, "__defaults__", (2,))
    assert sorted(map(tuple, mesh.seen_counts(faces, cams).collect())) == one and any(n > 1 for _, n in one)


def test_routes(spark):
    v, f = grid(spark, 40, 20, lambda i, j: 0.0)
    f = f.withColumn("seen", F.lit(1))
    free = route.plan_route(v, f, (2.0, 10.0), (37.0, 10.0))
    assert 34 <= free["length_m"] <= 36 and free["flags"] == [] and free["path"][0][2] == 0.15
    wall = spark.createDataFrame([("facade", [18.0, 5.0, -1.0], [22.0, 28.0, 6.0])], "tag string, min array<double>, max array<double>")
    around = route.plan_route(v, f, (2.0, 10.0), (37.0, 10.0), wall)
    assert around["length_m"] > free["length_m"] + 2 and not any(18 <= e <= 22 and 5 <= n <= 28 for e, n, _ in around["path"])
    closed = spark.createDataFrame([("facade", [18.0, -5.0, -1.0], [22.0, 28.0, 6.0])], wall.schema)
    assert route.plan_route(v, f, (2.0, 10.0), (37.0, 10.0), closed)["reason"].startswith("no route")
    assert route.plan_route(v, f, (2.0, 10.0), (370.0, 10.0))["reason"] == "start or goal is off the mesh"
    assert route.plan_route(v.limit(0), f.limit(0), (0.0, 0.0), (1.0, 1.0))["reason"] == "mesh has no walkable cells"
    dark = f.join(route.centroids(v, f).select("fid", "e"), "fid").withColumn("seen", F.when(F.col("e").between(15, 18), 0).otherwise(1)).drop("e")
    flagged = route.plan_route(v, dark, (2.0, 3.0), (37.0, 3.0), None, [(10.0, 2.0, 0.0, 10.0, 4.0, 0.0), (90.0, 9.0, 0.0, 90.0, 9.0, 0.0)])
    assert [x["kind"] for x in flagged["flags"]] == ["occlusion", "faultline"] and flagged["flags"][1]["e"] == 10.0


def test_surface_of_a_hill(spark):
    rng = np.random.default_rng(1)
    e, n = rng.uniform(-30, 30, (2, 2500))
    u = 0.08 * e + 4 * np.sin(n / 15) + rng.normal(size=2500) * 0.15
    df = spark.createDataFrame([(i, float(a), float(b), float(c), 10, 20, 30) for i, (a, b, c) in enumerate(zip(e, n, u))], "id long, e double, n double, u double, r int, g int, b int")
    made = surface.mesh_from_points(df)
    assert made["method"] == "dsm25d" and made["faces"].count() > 1000
    off = made["vertices"].select(F.avg(F.abs(F.col("z") - (0.08 * F.col("x") + 4 * F.sin(F.col("y") / 15))))).first()[0]
    assert off < 0.3
    assert surface.mesh_from_points(df.limit(20)) == {"status": "skipped", "reason": "too few points"}
    assert surface.mesh_from_points(df.limit(45).withColumn("e", F.col("id") % 7 * 1.5).withColumn("n", F.floor(F.col("id") / 7) * 1.5))["method"] == "grid25d"


def test_raster_morphology():
    valid = np.zeros((9, 12), bool)
    valid[2, 3] = valid[7, 9] = True
    y, x = surface.nearest_valid(valid)
    for r in range(9):
        for c in range(12):
            assert (r - y[r, c]) ** 2 + (c - x[r, c]) ** 2 == min((r - 2) ** 2 + (c - 3) ** 2, (r - 7) ** 2 + (c - 9) ** 2)
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    assert surface.fill_holes(ring)[3, 3] and not surface.fill_holes(ring)[0, 0]
    assert surface.close_gaps(ring)[3, 3] and surface.gaussian(np.ones((5, 8))) == pytest.approx(np.ones((5, 8)))


K = {"fx": 500.0, "fy": 500.0, "cx": 320.0, "cy": 240.0}
CAM = "cam int, r array<double>, t array<double>"


def cameras(spark):
    rows = []
    for i in range(4):
        center = np.array([i * 2.0, 3.0 * (i % 2), -10.0])
        r = sfm.rodrigues(np.array([0.0, 0.05 * (1.5 - i), 0.02 * i]))
        rows.append((i, r.ravel().tolist(), (-r @ center).tolist()))
    return rows, spark.createDataFrame(rows, CAM)


def test_triangulation_and_pruning(spark):
    rows, cams = cameras(spark)
    rng = np.random.default_rng(0)
    pts = rng.uniform(-2, 6, (40, 3)) * [1, 0.5, 0.3]
    pix = {}
    for i, r, t in rows:
        c = pts @ np.array(r).reshape(3, 3).T + t
        pix[i] = c[:, :2] / c[:, 2:] * 500 + [320, 240]
    m = spark.createDataFrame([(0, 2, p, *map(float, pix[0][p]), *map(float, pix[2][p])) for p in range(40)] + [(0, 1, 99, 10.0, 10.0, 600.0, 470.0)], "i int, j int, point long, xa double, ya double, xb double, yb double")
    got = {r.point: r for r in sfm.triangulate(m, cams, K).collect()}
    assert all(np.allclose([got[p].e, got[p].n, got[p].u], pts[p], atol=1e-6) and got[p].good for p in range(40)) and not got[99].good
    points = spark.createDataFrame([(p, *map(float, pts[p])) for p in range(40)], "point long, e double, n double, u double")
    obs = spark.createDataFrame([(p, i, float(pix[i][p][0] + (30 if p == 7 and i != 1 else 0)), float(pix[i][p][1])) for p in range(40) for i in range(4)], "point long, img int, x double, y double")
    kept = sfm.prune(obs, points, cams, K)
    assert kept.count() == 39 * 4 and kept.where("point = 7").count() == 0
    back = sfm.back_project(spark.createDataFrame([(0, 320.0, 240.0, 10.0)], "cam int, px double, py double, z double"), cams, K).first()
    r0, t0 = np.array(rows[0][1]).reshape(3, 3), np.array(rows[0][2])
    assert np.allclose(r0 @ [back.e, back.n, back.u] + t0, [0, 0, 10])


def test_alignment_recovers_a_similarity_and_levels_a_line(spark):
    rows, cams = cameras(spark)
    centers = {i: -np.array(r).reshape(3, 3).T @ t for i, r, t in rows}
    turn = sfm.rodrigues(np.array([0.2, -0.4, 1.1]))
    gps = spark.createDataFrame([(i, *map(float, 3.4 * turn @ c + [10, -4, 2])) for i, c in centers.items()], "cam int, ge double, gn double, gu double")
    points = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "point long, e double, n double, u double")
    new, moved, info = sfm.align_to_gps(cams, points, gps)
    assert info.first().rmse_m < 1e-6 and info.first().scale == pytest.approx(3.4)
    line = np.array([[i * 5.0, 0, 0] for i in range(6)])
    view = np.tile([[0.0, 1, 0]], (6, 1))
    level = sfm.level_roll(np.eye(3), line, line, view)
    assert np.allclose(level @ [0, 1, 0], [0, 0, -1], atol=1e-9) and np.allclose(level @ [1, 0, 0], [1, 0, 0])
    wide = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0]])
    assert (sfm.level_roll(np.eye(3), wide, wide, view[:4]) == np.eye(3)).all()
    assert sfm.align_to_gps(cams, points, gps.limit(1))[0] is cams
    assert moved.count() == 1 and new.columns == cams.columns


def test_ransac_keeps_one_geometry(spark):
    rows, _ = cameras(spark)
    rng = np.random.default_rng(5)
    pts = rng.uniform(-3, 6, (60, 3))
    p = []
    for _, r, t in (rows[0], rows[2]):
        c = pts @ np.array(r).reshape(3, 3).T + t
        p.append(c[:, :2] / c[:, 2:] * 500 + [320, 240])
    data = [(0, 2, k, k, *map(float, p[0][k]), *map(float, p[1][k])) for k in range(60)] + [(0, 2, 100 + k, 100 + k, *map(float, rng.uniform(0, 600, 4))) for k in range(25)] + [(0, 3, 0, 0, 1.0, 1.0, 1.0, 1.0)]
    m = spark.createDataFrame(data, "i int, j int, ka int, kb int, xa double, ya double, xb double, yb double")
    got = {r.ka for r in sfm.ransac_inliers(m).collect()}
    assert set(range(60)) <= got and len(got) < 68


def test_camera_expressions(spark):
    one = spark.range(1)
    r = one.select(camera.nadir_rotation(F.lit(90.0)).alias("r")).first().r
    assert np.allclose(np.array(r).reshape(3, 3), [[0, -1, 0], [-1, 0, 0], [0, 0, -1]], atol=1e-12)
    got = one.select(*[c.alias(k) for k, c in camera.ground_point(tuple(map(F.lit, (1.0, 2.0, 50.0))), camera.nadir_rotation(F.lit(0.0)), F.lit(50.0), *map(F.lit, (420.0, 240.0, 500.0, 500.0, 320.0, 240.0))).items()]).first()
    assert (round(got.e, 9), round(got.n, 9), got.ok) == (11.0, 2.0, True)
    assert one.select(camera.angle_degrees(*[tuple(map(F.lit, v)) for v in ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 0.0))])).first()[0] == pytest.approx(90)
    guess = one.select(*[c.alias(k) for k, c in camera.brightness_height(F.lit(172.0), F.lit(0.25)).items()]).first()
    assert guess.u == pytest.approx(3.6) and guess.conf == pytest.approx(0.08)


def test_pixel_scores_and_rescue(spark):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (6, 8))
    df = spark.createDataFrame([(1, 8, img.ravel().tolist()), (2, 8, [118] * 48)], "idx long, width int, pixels array<int>")
    got = {r.idx: r for r in frames.pixel_scores(df).collect()}
    p = np.pad(img.astype(float), 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * img
    share = np.bincount(img.ravel() // 8, minlength=32) / 48
    assert got[1].sharpness == pytest.approx(lap.var()) and got[1].texture == pytest.approx(-(share[share > 0] * np.log2(share[share > 0])).sum())
    assert (got[2].sharpness, got[2].texture, got[2].exposure) == (0.0, 0.0, 1.0)
    gated = frames.gate(spark.createDataFrame([(i, float(i % 3), 1.0, 0.5, 1.0) for i in range(5)], "idx long, score double, sharpness double, exposure double, redundancy double"))
    assert [(r.idx, r.reasons) for r in frames.rescue(gated).where("keep").collect()] == [(2, ["motion_blur"])]


def test_files_round_trip(spark, tmp_path):
    v, f = grid(spark, 4, 4, lambda i, j: i * 0.5)
    sinks.write_mesh_ply(v, f, f"file://{tmp_path}/mesh")
    back = files.read_ply(spark, f"file://{tmp_path}/mesh")
    assert sorted(map(tuple, back[0].collect())) == sorted(map(tuple, v.collect())) and sorted(map(tuple, back[1].collect())) == sorted(map(tuple, f.collect()))
    cloud_ = demo.cloud(spark)
    assert 1500 < cloud_.count() < 2000 and cloud_.where("conf not between 0 and 0.98").count() == 0
    sinks.write_ply(cloud_.limit(30), f"file://{tmp_path}/cloud")
    assert files.read_ply(spark, f"file://{tmp_path}/cloud")[0].count() == 30
    looks = json.loads(sinks.mesh_json(v, f, cloud_.select(F.col("seq").alias("id"), "e", "n", "u", "conf", "source", "synthetic")).first().value)
    assert len(looks["positions"]) == 48 and len(looks["indices"]) == 54 and not any(looks["measurement_safe"]) and set(looks["face_state"]) == {"generated"}
    t = demo.telemetry(spark)
    line = json.loads(sinks.trajectory_geojson(t).first().value)
    assert line["geometry"]["type"] == "LineString" and len(line["geometry"]["coordinates"]) == 64
    sinks.write_demo(t, 20.0, 20.0, f"file://{tmp_path}/demo")
    again = files.read_telemetry(spark, f"file://{tmp_path}/demo/telemetry")
    assert again.count() == 64 and [r.t for r in again.collect()] == sorted(r.t for r in t.collect())
    with pytest.raises(ValueError):
        (tmp_path / "one.csv").write_text("t,lat,lon\n1,2,3\n")
        files.read_telemetry(spark, f"file://{tmp_path}/one.csv")
    ends = [demo.PLACE.enu(*map(F.lit, (r.lat, r.lon, r.height))) for r in demo.eave(spark).collect()]
    length = spark.range(1).select(F.sqrt(sum((F.pow(a - b, 2) for a, b in zip(*ends)), F.lit(0.0)))).first()[0]
    assert length == pytest.approx(20.0, abs=1e-4)


def test_gaussians(spark):
    g = spark.createDataFrame([(0, [1.0, 2.0, 3.0], [1.0, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0], 0.5, [1.0, 0.5, 2.0])], "id long, mean array<double>, scale array<double>, quat_wxyz array<double>, opacity double, rgb array<double>")
    p = sinks.packed_gaussians(g).first()
    got = struct.unpack("<17f", p.bytes)
    want = [1, 2, 3, 0, 0, 0, 0.5 / sinks.HARMONIC, 0, 0.5 / sinks.HARMONIC, 0, 0, 0, np.log(1e-6), 1, 0, 0, 0]
    assert p.rows == 1 and np.allclose(got, want, atol=1e-5) and b"element vertex 1\n" in sinks.gaussian_header(1)
    with pytest.raises(Exception, match="vertex count"):
        sinks.encoded_gaussians(g.withColumn("scale", F.array(F.lit(1.0)))).collect()


def test_colmap_text(spark, tmp_path):
    (tmp_path / "images.txt").write_text("# Image list\n\n1 2 0 0 0 1 2 3 1 a/im1.jpg\n" + "1 2 3 " * 9 + "\n2 1 0 0 0 0 0 0 1 im2.jpg\n\n# a comment\n3 1 0 0 0 5 0 0 1 im3.jpg\n")
    got = {r.name: (r.ce, r.cn, r.cu) for r in files.read_colmap_images(spark, f"file://{tmp_path}/images.txt").collect()}
    assert got == {"a/im1.jpg": (-1.0, -2.0, -3.0), "im2.jpg": (0.0, 0.0, 0.0), "im3.jpg": (-5.0, 0.0, 0.0)}
    (tmp_path / "points3D.txt").write_text("# points\n1 1.5 2 3 10 20 30 0.25 1 1\n2 1 2\n")
    assert [tuple(r) for r in files.read_colmap_points(spark, f"file://{tmp_path}/points3D.txt").collect()] == [(1.5, 2.0, 3.0, 10, 20, 30, 0.25)]
    m = spark.createDataFrame([("2", True), ("10", True), ("0", False), (None, True)], "model string, has_points boolean")
    assert files.first_model(m).first().model == "2"


def test_manifests_and_jobs_on_disk(spark, tmp_path):
    samples, splits = demo.dataset(spark)
    by = {r.split: sorted(r.ids) for r in splits.groupBy("split").agg(F.collect_list("sample_id").alias("ids")).collect()}
    assert by["test"] == ["scene_0000", "scene_0010"] and by["val"] == ["scene_0001", "scene_0011"] and len(by["train"]) == 8
    sinks.write_manifest(samples, splits, f"file://{tmp_path}/manifest")
    back, parts = files.read_manifest(spark, f"file://{tmp_path}/manifest/*.txt")
    assert back.count() == 12 and parts.count() == 12 and contracts.sample_violations(back).count() == 0
    assert len(contracts.camera_features(back).first().features) == 25
    with pytest.raises(ValueError, match="unknown_license"):
        sinks.write_manifest(samples.withColumn("license", F.lit("unknown")), splits, f"file://{tmp_path}/bad")
    (tmp_path / "0123456789ab").mkdir()
    (tmp_path / "0123456789ab" / "cloud.json").write_text("{}")
    (tmp_path / "0123456789ab" / "result.json").write_text('{"kind": "demo"}')
    (tmp_path / "nothing").mkdir()
    (tmp_path / "nothing" / "cloud.json").write_text("{}")
    assert [tuple(r) for r in files.recovered_jobs(spark, f"file://{tmp_path}").collect()] == [("0123456789ab", "demo", "done")]
    assert files.read_scene(spark, f"file://{tmp_path}/lost.json").count() == 0
    (tmp_path / "broken.json").write_text("[1")
    assert files.read_scene(spark, f"file://{tmp_path}/broken.json").count() == 0
    coerced = contracts.coerced_samples(spark.createDataFrame([('{"sample_id": "a", "target_geometry_path": ""}',), ("no",)], "value string")).collect()
    assert coerced[0].license_name == "unknown" and coerced[0].frame_paths == [] and coerced[0].target_geometry_path is None and coerced[1].sample_id == ""
    bad = contracts.proposal_violations(spark.createDataFrame([("p", "r", 0, "proposed", True, 0.5)], "proposal_id string, scene_revision string, patch_id int, state string, measurement_safe boolean, uncertainty double"))
    assert [r.rule for r in bad.collect()] == ["measurement_safe"]


def test_streams_equal_batches(spark, tmp_path):
    log = spark.createDataFrame([(j, s, t, float(s), s * 10 % 70) for j in (1, 2) for s, t in enumerate(("status", "stage", "meta", "stage", "done"))], "job long, seq long, type string, value double, progress int")
    for part in (log.where("seq < 2"), log.where("seq >= 2")):
        jobs.emit(part, f"file://{tmp_path}/log")
        jobs.fold_into(jobs.event_stream(spark, f"file://{tmp_path}/log", log.schema), f"file://{tmp_path}/folded", f"file://{tmp_path}/at").awaitTermination()
    got = jobs.latest(spark.read.parquet(f"file://{tmp_path}/folded"))
    assert sorted(map(str, got.select(*contracts.fold_jobs(log).columns).collect())) == sorted(map(str, contracts.fold_jobs(log).collect()))
    assert [r.seq for r in jobs.events_after(log, 1, 3).collect()] == [3, 4]
    sent = jobs.with_end(log.where("job = 1")).orderBy("seq", "part").collect()
    assert len(sent) == 6 and sent[-1].data == 'data: {"type":"end"}\n\n'
    jobs.save_results(jobs.event_stream(spark, f"file://{tmp_path}/log", log.schema), f"file://{tmp_path}/results", f"file://{tmp_path}/at2").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/results").count() == 2


def test_snapshot_of_a_failed_job(spark):
    cols = "job long, seq long, type string, message string, progress int, stage string, label string, status string, payload string"
    rows = [(1, 0, "status", "begun", 5, None, None, None, None), (1, 1, "stage", None, 20, "mesh", "Mesh", "running", None), (1, 2, "pose", None, None, None, None, None, "p1"), (1, 3, "status", "", 0, None, None, None, None)]
    running = contracts.snapshot(spark.createDataFrame(rows, cols)).first()
    assert (running.message, running.progress, running.status, running.stages, running.poses) == ("Mesh - running", 20, "running", {"mesh": "running"}, ["p1"])
    failed = contracts.snapshot(spark.createDataFrame([*rows, (1, 4, "error", "bad", None, None, None, None, None)], cols)).first()
    assert failed.stages == {"mesh": "failed"} and failed.message == "Reconstruction failed" and failed.progress == 20
    done = contracts.snapshot(spark.createDataFrame([*rows, (1, 4, "done", "all done", None, None, None, None, None)], cols)).first()
    assert done.progress == 100 and done.message == "all done"


def test_capabilities(spark):
    table = {r.stage: r for r in capabilities.capability_table(spark).collect()}
    assert len(table) == 8 and all(r.available == (r.reason is None) for r in table.values())
    if not table["video_decoding"].available:
        with pytest.raises(RuntimeError, match="cv2"):
            capabilities.require("video_decoding")
    skipped = contracts.skipped_stage(spark.createDataFrame([(1, True, False, "no model")], "scene_id int, has_scene boolean, has_spatial boolean, reason string")).first()
    assert skipped.reason == "spatial map missing" and not skipped.measurement_safe
    assert geo.SEMI_MAJOR == 6378137.0
