import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenespark.functions import geo, scores
from scenespark.operators import cloud, contracts, frames, graph, matching, mesh, telemetry
from scenespark.sources import files
from scenespark.streaming import jobs

CLOUD = "seq long, e double, n double, u double, r int, g int, b int, conf double, observations int, source string, provenance array<string>, uncertainty_m double, synthetic boolean"


def test_geodesy_round_trip_and_eave(spark):
    o = geo.Origin(28.5448, 77.1924, 216.0)
    row = spark.range(1).select(F.lit(3.0).alias("e"), F.lit(-7.0).alias("n"), F.lit(11.0).alias("u"))
    back = row.select(*[c.alias(k) for k, c in zip(("lat", "lon", "alt"), o.geodetic(F.col("e"), F.col("n"), F.col("u")))])
    got = back.select(*o.enu(F.col("lat"), F.col("lon"), F.col("alt"))).first()
    assert got == pytest.approx((3.0, -7.0, 11.0), abs=1e-5)
    m = scores.evaluate_length(F.lit(20.4), F.lit(20.0), F.lit(None).cast("double"), F.lit(5.0))
    assert spark.range(1).select(*[c.alias(k) for k, c in m.items()]).first().asDict() == {"measured_m": 20.4, "abs_error_m": 0.4, "pct_error": 2.0, "tolerance_m": 1.0, "pass": True}
    q = spark.range(1).select(F.array(*geo.quaternion_matrix(*map(F.lit, (2.0, 0.0, 0.0, 2.0)))).alias("r")).first().r
    assert q == pytest.approx([0, -1, 0, 1, 0, 0, 0, 0, 1])


def test_two_points_fuse(spark):
    rows = [(0, 0.1, 0.1, 0.1, 10, 20, 30, 0.8, 2, "photogrammetry", ["mvs"], 0.5, False), (1, 0.3, 0.3, 0.3, 13, 20, 30, 0.7, 3, "vggt", ["vggt"], None, True), (2, -0.2, 0.1, 0.0, 1, 1, 1, 0.1, 1, "x", [], 2.0, True)]
    df = spark.createDataFrame(rows, CLOUD)
    one = cloud.voxel_fuse(df.where("seq < 2"), 1.0).first()
    assert (one.source, one.provenance, one.uncertainty_m, one.observations, one.synthetic, one.r) == ("photogrammetry", ["mvs", "vggt"], 0.5, 5, False, 11)
    assert one.conf == pytest.approx(0.84)
    assert cloud.voxel_fuse(df, 1.0).count() == 1 and cloud.voxel_fuse(df, 1.0, floor=True).count() == 2  # the cell at 0 is twice as wide


def test_telemetry_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text(" Time ,LAT,lng,hdop,rtk_fix\n2,1,2,,fix\n1,1,2,0.9,no\n3,x,2,1,1\n4,1,2,bad,1\n5,1,2\n")
    got = files.read_telemetry(spark, f"file://{tmp_path}/t.csv").orderBy("t").collect()
    assert [(r.t, r.hdop, r.alt, r.rtk) for r in got] == [(1.0, 0.9, 80.0, False), (2.0, 1.5, 80.0, True), (5.0, 1.5, 80.0, False)]
    with pytest.raises(ValueError):
        files.parse_telemetry(spark.createDataFrame([("1",)], "t string"))


def test_interpolation_clamps_and_turns(spark):
    cols = "track long, seq long, t double, lat double, lon double, alt double, heading double, speed double, hdop double, rtk boolean"
    s = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 10.0, 359.0, 1.0, 1.0, True), (1, 1, 2.0, 2.0, 4.0, 20.0, 1.0, 3.0, 2.0, False)], cols)
    p = spark.createDataFrame([(1, 1, -5.0), (1, 2, 1.0), (1, 3, 9.0), (1, 4, 2.0), (2, 5, 0.0)], "track long, probe_id long, at double")
    got = {r.probe_id: r for r in telemetry.interpolate(s, p).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1].t, got[1].rtk, got[3].t, got[3].alt, got[4].lat) == (0.0, True, 2.0, 20.0, 2.0)
    assert (got[2].lat, got[2].lon, got[2].heading, got[2].rtk) == (1.0, 2.0, 0.0, False)


@pytest.mark.parametrize("cell", [None, 0.01, 50.0])
def test_nearest_is_exact(spark, cell):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(120, 3)), rng.normal(size=(5, 3)) * 40, np.zeros((4, 3))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, e double, n double, u double")
    got = cloud.nearest(df, df, 3, same=True, cell=cell).orderBy("id", "rank").collect()
    for i in range(len(x)):
        d = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(len(x)) if j != i)[:3]
        assert [r.other for r in got if r.id == i] == [j for _, j in d]
    assert cloud.nearest(df.limit(0), df, 3).count() == 0 and cloud.nearest(df, df.limit(0), 3).count() == 0


def test_hill_loses_its_spikes(spark):
    rng = np.random.default_rng(2)
    e, n = rng.uniform(-60, 60, (2, 1500))
    u = 0.08 * e + 4 * np.sin(n / 15) + rng.normal(size=1500) * 0.15
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(e, n, u))] + [(2000 + i, float(rng.uniform(-60, 60)), float(rng.uniform(-60, 60)), 40.0) for i in range(15)]
    df = spark.createDataFrame(rows, "id long, e double, n double, u double")
    keep = {r.id: r.keep for r in cloud.height_residual(df).collect()}
    assert not any(keep[2000 + i] for i in range(15)) and np.mean([keep[i] for i in range(1500)]) > 0.9


def test_components_and_tracks(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in graph.components(e).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[101] == 100
    none = spark.createDataFrame([(None, 1), (3, 3)], "a long, b long")
    assert [tuple(r) for r in graph.components(none).collect()] == [(3, 3)] and graph.components(none.limit(0)).count() == 0
    m = spark.createDataFrame([(0, 1, 5, 6), (1, 2, 6, 7), (0, 1, 9, 9), (0, 1, 8, 9)], "i int, j int, ka int, kb int")
    assert sorted((r.img, r.kp) for r in graph.tracks(m).collect()) == [(0, 5), (1, 6), (2, 7)]


def test_rounds_do_not_depend_on_order(spark):
    ids = np.random.default_rng(5).permutation(10_000).tolist()
    path = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    comp, rounds = graph.contracted(path)
    assert rounds <= 18 and comp.groupBy("comp").count().collect() == [(0, 10_000)]


def test_faces_and_patches(spark):
    cells = spark.createDataFrame([(x, y, 0.0) for x in range(3) for y in range(3)], "ix long, iy long, h double")
    assert mesh.grid_faces(cells, 1.0).count() == 8
    faces = spark.createDataFrame([(0, 0, 1, 2, 0), (1, 1, 2, 3, 0), (2, 2, 3, 4, 1), (3, 7, 8, 9, 0)], "fid long, a long, b long, c long, seen int")
    assert [(r.patch, r.faces, r.first_face) for r in mesh.unseen_patches(faces).orderBy("patch").collect()] == [(0, 2, 0), (1, 1, 3)]
    kinds = {(r.i, r.j): r.kind for r in mesh.faultlines(faces).collect()}
    assert kinds[2, 3] == "occlusion" and (1, 2) not in kinds and kinds[0, 1] == "boundary"


def test_frames(spark):
    f = spark.createDataFrame([(i, 1.0, 30.0 if i % 2 else 1.0, 0.5, 0.1) for i in range(10000)], "idx long, score double, sharpness double, exposure double, redundancy double")
    kept = [r.idx for r in frames.gate(f).where("keep").orderBy("idx").collect()]
    assert kept == list(range(1, 181, 2))
    assert [r.rn for r in frames.thin(f, "idx", 4).orderBy("idx").collect()] == [0, 3333, 6666, 9999]
    assert frames.overlapping(f.limit(10).where("idx < 7"), "idx", 4).groupBy("window").count().orderBy("window").collect() == [(0, 4), (1, 4)]


def test_similarity(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(12, 3)) * 5
    c, s = math.cos(math.pi / 2), math.sin(math.pi / 2)
    r = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    q = 3.4 * p @ r.T + np.array([10, -4, 2])
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(p, q)], "px double, py double, pz double, qx double, qy double, qz double")
    got = matching.fit_similarity(matching.similarity_moments(df)).first()
    assert got.scale == pytest.approx(3.4, abs=1e-6) and np.allclose(got.rotation, r.ravel(), atol=1e-6) and np.allclose(got.translation, [10, -4, 2], atol=1e-6)
    assert matching.fit_similarity(matching.similarity_moments(df.limit(1))).count() == 0


def test_stream_fold_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([(j, s, t, float(s), s * 10 % 70) for j in (1, 2) for s, t in enumerate(("status", "stage", "meta", "stage", "done"))], "job long, seq long, type string, value double, progress int")
    log.repartition(3).write.parquet(f"file://{tmp_path}/log")
    q = jobs.fold_stream(jobs.event_stream(spark, f"file://{tmp_path}/log", log.schema), "folded")
    q.awaitTermination()
    assert sorted(spark.sql("select * from folded").collect()) == sorted(contracts.fold_jobs(log).collect())


def test_ply(spark, tmp_path):
    (tmp_path / "m.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nelement face 1\nend_header\n0 0 0\n1 0 0 1 2 3\n0 1 0.5\n3 0 1 2\n")
    v, f = files.read_ply(spark, f"file://{tmp_path}/m.ply")
    assert [tuple(r)[1:] for r in v.orderBy("vid").collect()] == [(0.0, 0.0, 0.0, 210, 210, 210), (1.0, 0.0, 0.0, 1, 2, 3), (0.0, 1.0, 0.5, 210, 210, 210)]
    assert [tuple(r) for r in f.collect()] == [(0, 0, 1, 2)]


def test_components_of_the_whole_table(spark, sf):
    import __spark_entry__ as entry

    edges = {(r.l_partkey, r.l_suppkey + 1000000) for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in entry.queries()["connected_components"](spark, sf).collect()}
    assert got == {x: top(x) for x in up}


def test_building_heights_of_the_whole_table(spark, sf):
    import __spark_entry__ as entry

    got = {r.p_partkey: r.h for r in entry.queries()["building_height"](spark, sf).collect()}
    parts = {r.p_partkey: r for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    assert set(got) == set(parts)
    rest = {i: got[i] for i, r in parts.items() if r.p_size % 3 == 2}
    assert rest == {i: 16.0 if parts[i].p_type.split(" ")[0] in ("LARGE", "PROMO") else 9.0 for i in rest} and set(rest.values()) == {9.0, 16.0}
