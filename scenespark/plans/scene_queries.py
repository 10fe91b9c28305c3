"""More queries of the library's operators, with the same in SQL: geometry, visibility, routes, gates,
structure from motion, contracts and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import camera, geo, scores
from ..operators import cloud, contracts, frames, graph, matching, mesh, route, sfm
from ..sources import demo, files, sinks
from ..streaming import jobs
from .queries import _EDGE, _KNN, _RN, _SCORE, LOG, Views, query, rounded

ORIGIN = geo.Origin(28.5448, 77.1924, 200.0)


# geodesy and cameras


@query("SELECT track, seq, round(lat, 7) AS lat, round(lon, 7) AS lon, round(alt, 3) AS alt FROM track")
def geodetic_round_trip(v: Views) -> DataFrame:
    lat, lon, alt = geo.geodetic(*geo.ecef(F.col("lat"), F.col("lon"), F.col("alt")))
    return v.track.select("track", "seq", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"), F.round(alt, 3).alias("alt"))


@query("SELECT track, seq, round(lat, 7) AS lat, round(lon, 7) AS lon, round(alt, 3) AS alt FROM track")
def enu_round_trip(v: Views) -> DataFrame:
    local = v.track.select("track", "seq", *[c.alias(a) for a, c in zip("enu", ORIGIN.enu(F.col("lat"), F.col("lon"), F.col("alt")))])
    lat, lon, alt = ORIGIN.geodetic(F.col("e"), F.col("n"), F.col("u"))
    return local.select("track", "seq", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"), F.round(alt, 3).alias("alt"))


@query("SELECT track, seq, round(sin(radians(heading)), 6) AS e, round(cos(radians(heading)), 6) AS n, 0.0::DOUBLE AS u FROM track")
def heading_vectors(v: Views) -> DataFrame:
    return rounded(v.track.select("track", "seq", *[c.alias(a) for a, c in zip("enu", geo.heading_vector(F.col("heading")))]))


@query(
    """+ k AS (SELECT n_nationkey AS cam, 640.0 + n_nationkey * 10 AS w, 480.0 + n_nationkey AS h FROM nation), f AS (SELECT *, (w / 2) / tan(radians(68.0) / 2) AS f68, (w / 2) / tan(radians(73.0) / 2) AS f73 FROM k)
    SELECT cam, round(f68, 6) AS f68, round(f73, 6) AS f73, round(w / 2, 6)::DOUBLE AS cx, round(f73 * 0.5, 6) AS half_fx, round(h / 2 * 0.25, 6)::DOUBLE AS quarter_cy FROM f"""
)
def camera_intrinsics(v: Views) -> DataFrame:
    d = v.table("nation").select(F.col("n_nationkey").alias("cam"), (640.0 + F.col("n_nationkey") * 10).alias("w"), (480.0 + F.col("n_nationkey")).alias("h"))
    a, b = (camera.intrinsics(F.col("w"), F.col("h"), f) for f in (camera.STEREO_FOV, camera.MOTION_FOV))
    s = camera.scaled_intrinsics(b["fx"], b["fy"], b["cx"], b["cy"], F.lit(0.5), F.lit(0.25))
    return rounded(d.select("cam", a["fx"].alias("f68"), b["fx"].alias("f73"), b["cx"].alias("cx"), s["fx"].alias("half_fx"), s["cy"].alias("quarter_cy")))


@query(
    """+ g AS (SELECT track, seq, sin(radians(heading)) AS s, cos(radians(heading)) AS c, alt - 150 AS h, (seq % 640 - 320) / 474.4 AS px, (seq % 360 - 180) / 474.4 AS py FROM track), r AS (SELECT *, c * px - s * py AS re, -s * px - c * py AS rn, sqrt(px * px + py * py + 1) AS m FROM g)
    SELECT track, seq, round(h * re, 4) + 0.0 AS e, round(h * rn, 4) + 0.0 AS n, round(h * m, 4) AS ray_m FROM r WHERE h * m > 1 AND h * m <= 4 * (h + 150)"""
)
def ground_points(v: Views) -> DataFrame:
    """Where pixels of straight-down cameras meet the ground."""
    h = F.col("alt") - 150
    got = camera.ground_point((F.lit(0.0), F.lit(0.0), h), camera.nadir_rotation(F.col("heading")), F.col("alt"), (F.col("seq") % 640).cast("double"), (F.col("seq") % 360).cast("double"), F.lit(474.4), F.lit(474.4), F.lit(320.0), F.lit(180.0))
    out = v.track.select("track", "seq", *[c.alias(k) for k, c in got.items()]).where("ok").drop("ok")
    return rounded(out, 4).withColumns({a: F.col(a) + 0.0 for a in "en"})  # no minus zero


@query(
    """SELECT id, round(10 - 3.4 * n, 4) AS e, round(-4 + 3.4 * e, 4) AS n, round(2 + 3.4 * u, 4) AS u FROM parts"""
)
def similarity_applied(v: Views) -> DataFrame:
    turn, shift = F.array(*[F.lit(float(x)) for x in (0, -1, 0, 1, 0, 0, 0, 0, 1)]), F.array(*[F.lit(float(x)) for x in (10, -4, 2)])
    return rounded(v.parts.select("id", *[c.alias(a) for a, c in zip("enu", camera.similarity(F.lit(3.4), turn, shift, (F.col("e"), F.col("n"), F.col("u"))))]), 4)


@query(
    """+ t AS (SELECT track, seq, cos(radians(heading) / 2) AS w, sin(radians(heading) / 2) AS z, e, n FROM (SELECT track, seq, heading, lat AS e, lon AS n FROM track))
    SELECT track, seq, round(w * w - z * z, 6) AS r0, round(2 * w * z, 6) AS r3, round(-((w * w - z * z) * e + 2 * w * z * n), 6) AS ce, round(-(-2 * w * z * e + (w * w - z * z) * n), 6) AS cn FROM t"""
)
def camera_centers(v: Views) -> DataFrame:
    half = F.radians("heading") / 2
    d = v.track.select("track", "seq", F.array(*geo.quaternion_matrix(2 * F.cos(half), F.lit(0.0), F.lit(0.0), 2 * F.sin(half))).alias("r"), F.array("lat", "lon", F.lit(0.0)).alias("t"))
    c = geo.camera_center(F.col("r"), F.col("t"))
    return rounded(d.select("track", "seq", F.col("r")[0].alias("r0"), F.col("r")[3].alias("r3"), c[0].alias("ce"), c[1].alias("cn")))


_CAM = "+ f AS (SELECT p.id, c.cam, c.s, c.c, p.e - c.e AS x, p.n - c.n AS y, p.u - c.u AS z FROM parts p, cams c), d AS (SELECT id, cam, x AS qx, -c * y - s * z AS qy, s * y - c * z AS qz FROM f)"


@query(_CAM + " SELECT id, cam, round(60 * qx / qz + 32, 4) AS px, round(60 * qy / qz + 24, 4) AS py, round(qz, 4) AS depth FROM d WHERE qz > 0.5")
def projections(v: Views) -> DataFrame:
    """Every part in every slanted camera (a few): pixel and depth."""
    r = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), -F.col("c"), -F.col("s"), F.lit(0.0), F.col("s"), -F.col("c"))
    c = v.cams.select("cam", r.alias("r"), *[F.col(a).alias(f"c{a}") for a in "enu"])
    t = F.array(*[-x for x in camera.rotate(F.col("r"), (F.col("ce"), F.col("cn"), F.col("cu")))])
    d = v.parts.join(F.broadcast(c.withColumn("t", t)), F.lit(True))
    px, py, z = camera.project(F.col("r"), F.col("t"), (F.col("e"), F.col("n"), F.col("u")), F.lit(60.0), F.lit(60.0), F.lit(32.0), F.lit(24.0))
    return rounded(d.select("id", "cam", px.alias("px"), py.alias("py"), z.alias("depth")).where("depth > 0.5"), 4)


@query("SELECT id, round(e, 6) AS x, round(u, 6) AS y, round(-n, 6) AS z, round(0.3 + 0.65 * u / 9, 6) AS red, round(0.95 - 0.7 * u / 9, 6) AS blue FROM parts")
def viewer_points(v: Views) -> DataFrame:
    """Points as a viewer places and colours them."""
    x, y, z = camera.viewer_axes(F.col("e"), F.col("n"), F.col("u"))
    red, _, blue = camera.height_colour(F.col("u"), F.lit(0.0), F.lit(9.0))
    return rounded(v.parts.select("id", x.alias("x"), y.alias("y"), z.alias("z"), red.alias("red"), blue.alias("blue")))


@query(
    """+ k AS (SELECT cam, e, n, u, c, s, unnest([0, 1, 2, 3]) AS corner FROM cams), d AS (SELECT *, CASE WHEN corner IN (0, 3) THEN -1 ELSE 1 END * 32 / 60.0 * 6 AS dx, CASE WHEN corner < 2 THEN -1 ELSE 1 END * 24 / 60.0 * 6 AS dy FROM k)
    SELECT cam, corner, round(e + dx, 4) AS e, round(n - c * dy + s * 6, 4) AS n, round(u - s * dy - c * 6, 4) AS u FROM d"""
)
def frustum_corners(v: Views) -> DataFrame:
    f = camera.frustum((F.col("e"), F.col("n"), F.col("u")), _rotation(), F.lit(64.0), F.lit(48.0), F.lit(60.0), F.lit(6.0))
    return rounded(v.cams.select("cam", F.posexplode(f).alias("corner", "p")).select("cam", "corner", "p.*"), 4)


def _rotation() -> Column:
    """Camera to world of the slanted cameras."""
    return F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), -F.col("c"), F.col("s"), F.lit(0.0), -F.col("s"), -F.col("c"))


@query(
    """SELECT seq, round(least(greatest(1 / greatest(conf, 0.05), 0.05), 20), 6) AS stereo, round(greatest(0.1, least(20.0, 2 / greatest(conf, 0.05))), 6) AS nadir, round(2 * (1 - conf) + 0.25, 6) AS learned, round(abs(u) + 0.25, 6) AS external FROM cloud"""
)
def uncertainties(v: Views) -> DataFrame:
    of = lambda s: camera.uncertainty_by_source(s, F.col("conf"), F.abs("u")).alias(s)
    return rounded(v.cloud.select("seq", *map(of, ("stereo", "nadir", "learned", "external"))))


@query(
    """+ g AS (SELECT s_suppkey AS id, s_acctbal / 500 AS m, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 10 END AS l, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 2 END AS p FROM supplier), k AS (SELECT id, m, CASE WHEN l > 0 THEN l::DOUBLE END AS l, CASE WHEN p = 0 THEN 5.0 ELSE p END AS p FROM g)
    SELECT id, round(m, 3) AS measured_m, round(abs(m - l), 3) AS abs_error_m, round(abs(m - l) / l * 100, 2) AS pct_error, CASE WHEN l IS NOT NULL THEN round(greatest(l * p / 100, 1.0), 3)::DOUBLE END AS tolerance_m, abs(m - l) <= greatest(l * p / 100, 1.0) AS pass FROM k"""
)
def measured_lengths(v: Views) -> DataFrame:
    """Requests with and without a true length, and with a percentage of 0."""
    i = F.col("s_suppkey")
    true = F.when(i % 4 == 1, 0.0).when(i % 4 > 1, 10.0)
    got = scores.measure(F.col("s_acctbal") / 500, true, F.lit(None).cast("double"), F.when(i % 3 == 0, 0.0).otherwise(2.0))
    return v.table("supplier").select(i.alias("id"), *[c.alias(k) for k, c in got.items()])


@query("SELECT l_orderkey, l_linenumber, l_quantity, round_even(l_quantity / 2, 0) AS half_even, round(l_quantity / 2, 0) AS half_up FROM lineitem")
def roundings(v: Views) -> DataFrame:
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.bround(F.col("l_quantity") / 2, 0).alias("half_even"), F.round(F.col("l_quantity") / 2, 0).alias("half_up"))


# frames

_STRICT = f"+ g AS (SELECT idx, {_SCORE} AS score, exposure < 0.18 AS y FROM frames), b AS (SELECT idx AS best FROM g ORDER BY score DESC, idx LIMIT 1)"


@query(_STRICT + " SELECT idx, round(score, 6) AS score, concat_ws(',', 'motion_blur', CASE WHEN y THEN 'illumination' END, CASE WHEN idx <> best THEN 'redundant' END) AS reasons, idx = best AS keep FROM g, b")
def frame_rescue(v: Views) -> DataFrame:
    """Gates that no frame passes: the best one is kept."""
    f = v.frames.withColumn("score", scores.frame_score(*map(F.col, ("sharpness", "features", "texture", "exposure", "redundancy"))))
    return rounded(frames.rescue(frames.gate(f, least_sharp=1000, most_redundant=-1)).withColumn("reasons", F.array_join("reasons", ",")))


@query("SELECT count(*)::BIGINT AS scanned, least(90, count(*) FILTER (WHERE sharpness >= 18 AND exposure >= 0.18 AND redundancy <= 0.992))::BIGINT AS kept, (count(*) FILTER (WHERE sharpness < 18))::BIGINT AS blur_dropped, (count(*) FILTER (WHERE exposure < 0.18))::BIGINT AS illumination FROM frames")
def frame_counters(v: Views) -> DataFrame:
    return frames.counters(frames.gate(v.frames.withColumn("score", F.lit(1.0))))


@query(
    """+ t AS (SELECT vec_id AS idx, lag(embedding) OVER (ORDER BY vec_id) AS p, embedding AS q FROM embeddings), u AS (SELECT idx, p IS NULL AS head, unnest(q)::DOUBLE AS y, CASE WHEN p IS NULL THEN 0.0 ELSE 1.0 END AS k, unnest(coalesce(p, q))::DOUBLE AS x FROM t)
    SELECT idx, round(CASE WHEN bool_or(head) THEN 0.0 ELSE coalesce(corr(x, y), 1.0) END, 6) AS redundancy FROM u GROUP BY idx"""
)
def frame_redundancy(v: Views) -> DataFrame:
    return rounded(frames.redundancy(v.table("embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("thumb")), 100))


@query(_RN + " SELECT idx FROM p WHERE rn % 7 = 0")
def every_seventh(v: Views) -> DataFrame:
    return frames.every_nth(v.frames, "idx", 7).select("idx")


@query("SELECT idx FROM frames WHERE idx % 10 = 0")
def sampled_frames(v: Views) -> DataFrame:
    return frames.sampled(v.frames, 30.0).select("idx")


@query(_RN + ", k AS (SELECT unnest(range(9)) AS index) SELECT index::INT AS index, idx FROM k JOIN p ON rn = least(trunc((index + 1) / 9 * (total - 1))::BIGINT, total - 1)")
def pose_samples(v: Views) -> DataFrame:
    chunks = v.spark.range(9).select(F.col("id").cast("int").alias("index"), F.lit(9).alias("total"))
    return frames.pose_of_chunk(chunks, v.frames, "idx").select("index", "idx")


@query("+ p AS (SELECT id, row_number() OVER (ORDER BY e, id) - 1 AS rn, count(*) OVER () AS total FROM parts) SELECT id, floor(rn / ceil(total / 9))::BIGINT AS chunk FROM p")
def chunks_west_to_east(v: Views) -> DataFrame:
    return frames.chunks_by_value(v.parts, "e", "id", 9).select("id", "chunk")


# clouds: gates, caps and unions

_HOLES = "+ h AS (SELECT seq, CASE l.k WHEN 3 THEN CAST('NaN' AS DOUBLE) WHEN 4 THEN CAST('Infinity' AS DOUBLE) WHEN 5 THEN NULL ELSE e END AS e, n, u FROM (SELECT *, observations AS k FROM cloud) l)"


@query(_HOLES + " SELECT seq FROM h WHERE e IS NOT NULL AND isfinite(e)")
def finite_points(v: Views) -> DataFrame:
    k = F.col("observations")
    bad = F.when(k == 3, float("nan")).when(k == 4, float("inf")).when(k != 5, F.col("e"))
    return v.cloud.withColumn("e", bad).where(cloud.finite("e", "n", "u")).select("seq")


_FLAT = "+ d AS (SELECT p.id, min(sqrt(pow(p.e - c.e, 2) + pow(p.n - c.n, 2))) AS m FROM parts p, cameras c GROUP BY p.id), s AS (SELECT greatest(max(e) - min(e), max(n) - min(n)) AS span, median(u) AS cu FROM cameras), k AS (SELECT median(u) AS pu, count(*) AS total FROM parts)"


@query(_FLAT + ", l AS (SELECT d.id FROM d, s WHERE m <= greatest(1.5 * span, 150)) SELECT p.id FROM parts p WHERE (SELECT count(*) FROM l) < 50 OR p.id IN (SELECT id FROM l)")
def far_trim(v: Views) -> DataFrame:
    return cloud.far_trim(v.parts, v.cameras).select("id")


@query(_FLAT + ", l AS (SELECT d.id FROM d, s, k WHERE m <= greatest(1.5 * span, 3 * abs(cu - pu), 50)), z AS (SELECT count(*) AS c FROM l) SELECT p.id FROM parts p, z, k WHERE c < 50 OR c > 0.98 * total OR p.id IN (SELECT id FROM l)")
def flight_trim(v: Views) -> DataFrame:
    c = v.cameras.select("cam", *[F.col(a).alias(f"c{a}") for a in "enu"])
    return sfm.trim_to_flight(v.parts, c, "id").select("id")


@query("+ t AS (SELECT avg(e) AS e, avg(n) AS n, avg(u) AS u, greatest(max(e) - min(e), max(n) - min(n)) AS span FROM suppliers) SELECT c.id FROM customers c, t WHERE sqrt(pow(c.e - t.e, 2) + pow(c.n - t.n, 2) + pow(c.u - t.u, 2)) < greatest(1.8 * (span + 40), 80)")
def track_gate(v: Views) -> DataFrame:
    return cloud.track_gate(v.customers, v.suppliers).select("id")


@query("SELECT id FROM parts WHERE abs(u) <= 80 AND abs(e) <= 250 AND abs(n) <= 250 AND u <= greatest(-3.5, 2) + 8")
def scene_box(v: Views) -> DataFrame:
    return v.parts.where(cloud.scene_box(F.lit(-3.5))).select("id")


@query(
    _KNN + """, m AS (SELECT id, avg(d) AS m FROM k WHERE rank <= 12 GROUP BY id), s AS (SELECT avg(m) + 2 * stddev_pop(m) AS bound FROM m), h AS (SELECT id, median(u) AS h FROM k WHERE rank <= 24 GROUP BY id), r AS (SELECT p.id, abs(p.u - h.h) AS r FROM parts p JOIN h USING (id)),
    g AS (SELECT p.id, min(sqrt(pow(p.e - c.e, 2) + pow(p.n - c.n, 2) + pow(p.u - c.u, 2))) AS g FROM parts p, cameras c GROUP BY p.id), q AS (SELECT 1.6 * median(g) AS far FROM g), w AS (SELECT greatest(3, 6 * median(r)) AS tall FROM r),
    o AS (SELECT m.id FROM m JOIN r USING (id) JOIN g USING (id), s, q, w WHERE m <= bound AND r <= tall AND g <= far) SELECT p.id FROM parts p WHERE (SELECT count(*) FROM parts) < 200 OR (SELECT count(*) FROM o) < 0.5 * (SELECT count(*) FROM parts) OR p.id IN (SELECT id FROM o)"""
)
def clean_cloud(v: Views) -> DataFrame:
    return cloud.clean_cloud(v.parts, v.cameras).select("id")


@query("+ b AS (SELECT a.id, min(sqrt(pow(a.e - b.e, 2) + pow(a.n - b.n, 2) + pow(a.u - b.u, 2))) AS d FROM suppliers a JOIN suppliers b ON a.id <> b.id GROUP BY a.id), r AS (SELECT greatest(1.5, 3 * median(d)) AS tol FROM b) SELECT c.id FROM customers c, r WHERE EXISTS (SELECT 1 FROM suppliers s WHERE sqrt(pow(c.e - s.e, 2) + pow(c.n - s.n, 2) + pow(c.u - s.u, 2)) < r.tol)")
def agreeing_points(v: Views) -> DataFrame:
    return cloud.agreeing(v.suppliers, v.customers).select("id")


@query("+ t AS (SELECT id, u FROM parts ORDER BY u DESC, id LIMIT 100) SELECT id, round(u, 6) AS conf FROM t")
def most_confident(v: Views) -> DataFrame:
    return rounded(cloud.most_confident(v.parts.withColumn("conf", F.col("u")), 100).select("id", "conf"))


@query("SELECT id FROM parts ORDER BY id LIMIT 250")
def first_points(v: Views) -> DataFrame:
    return cloud.first_rows(v.parts, "id", 250).select("id")


@query()  # which rows a sample holds depends on the hash: tests hold it against its definition
def sampled_points(v: Views) -> DataFrame:
    return cloud.sampled(v.parts, "id", 500, seed=3).select("id")


@query("SELECT 'a' AS part, id FROM suppliers UNION ALL SELECT 'b', id FROM customers")
def merged_clouds(v: Views) -> DataFrame:
    return cloud.merged(v.suppliers.select(F.lit("a").alias("part"), "id"), v.customers.select(F.lit("b").alias("part"), "id"))


@query("SELECT id + 10000000 AS id FROM suppliers UNION ALL SELECT c.id FROM customers c WHERE (SELECT count(*) FROM suppliers) < 50 OR EXISTS (SELECT 1 FROM suppliers s WHERE sqrt(pow(c.e - s.e, 2) + pow(c.n - s.n, 2) + pow(c.u - s.u, 2)) < (SELECT greatest(1.5, 3 * median(d)) FROM (SELECT min(sqrt(pow(a.e - b.e, 2) + pow(a.n - b.n, 2) + pow(a.u - b.u, 2))) AS d FROM suppliers a JOIN suppliers b ON a.id <> b.id GROUP BY a.id)))")
def external_union(v: Views) -> DataFrame:
    own = ("id", "e", "n", "u")
    return cloud.with_external(v.customers.select(*own), v.suppliers.select((F.col("id") + 10_000_000).alias("id"), *own[1:]), 50).select("id")


_AT = "(SELECT {a} FROM parts ORDER BY {a} LIMIT 1 OFFSET (SELECT least(count(*) - 1, floor(count(*) * {p}))::BIGINT FROM parts))"


@query("+ x AS (" + " UNION ALL ".join(f"SELECT '{a}' AS axis, {_AT.format(a=a, p=0.02)} AS lo, {_AT.format(a=a, p=0.98)} AS hi, {_AT.format(a='u', p=0.08)} AS ground FROM (SELECT 1 FROM parts LIMIT 1)" for a in "enu") + ") SELECT axis, round(lo, 6) AS lo, round(hi, 6) AS hi, round(ground, 6) AS ground FROM x")
def framing(v: Views) -> DataFrame:
    return rounded(cloud.framing(v.parts))


@query("SELECT round(max(e) - min(e), 6) AS e, round(max(n) - min(n), 6) AS n, round(max(u) - min(u), 6) AS u FROM parts")
def extents(v: Views) -> DataFrame:
    return rounded(cloud.extents(v.parts))


@query("SELECT " + ", ".join(f"round(avg({a}), 6) AS mean_{a}, round(stddev_samp({a}), 6) AS std_{a}" for a in "enu") + " FROM parts")
def gaussian_stats(v: Views) -> DataFrame:
    return rounded(cloud.gaussian_stats(v.parts))


@query("+ o AS (SELECT id, u / 9 AS opacity FROM parts) SELECT id FROM o WHERE opacity > 0.02 OR (SELECT count(*) FROM o WHERE opacity > 0.02) < 16")
def opaque_gaussians(v: Views) -> DataFrame:
    return cloud.opaque(v.parts.withColumn("opacity", F.col("u") / 9)).select("id")


@query("+ d AS (SELECT a.id, sqrt((a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n) + (a.u - b.u) * (a.u - b.u)) AS d FROM suppliers a, suppliers b), t AS (SELECT id, list_sort(list(d)) AS d FROM d GROUP BY id) SELECT id, round(least(greatest(CASE WHEN d[1] < 0.0001 THEN d[2] ELSE d[1] END, 0.02), 1.5) * 0.6, 6) AS scale FROM t")
def primitive_scales(v: Views) -> DataFrame:
    return rounded(cloud.primitive_scales(v.suppliers, None))


@query("SELECT seq, CASE WHEN c.conf >= 0.72 THEN 'high' WHEN c.conf >= 0.42 THEN 'medium' ELSE 'low' END AS band, true AS near FROM cloud c")
def point_payloads(v: Views) -> DataFrame:
    """Points with their place on the globe: within a millimetre of where they came from."""
    p = cloud.payload(v.cloud.select("seq", "e", "n", "u", "conf"), ORIGIN)
    back = ORIGIN.enu(F.col("lat"), F.col("lon"), F.col("height"))
    off = sum((F.pow(c - F.col(a), 2) for c, a in zip(back[1:], "nu")), F.pow(back[0] - F.col("e"), 2))
    return p.select("seq", "band", (F.sqrt(off) < 1e-3).alias("near"))


# rasters, meshes and visibility


@query("SELECT floor(e / 1.4)::BIGINT AS ix, floor(n / 1.4)::BIGINT AS iy, round(avg(e), 6) AS e, round(avg(n), 6) AS n, round(avg(u), 6) AS u, trunc(avg(r))::INT AS r, trunc(avg(g))::INT AS g, trunc(avg(b))::INT AS b FROM cloud GROUP BY 1, 2")
def grid_means(v: Views) -> DataFrame:
    return rounded(mesh.cell_means(v.cloud))


@query("+ c AS (SELECT DISTINCT floor(e / 1.4)::BIGINT AS ix, floor(n / 1.4)::BIGINT AS iy FROM parts) SELECT a.ix, a.iy, h.half FROM c a JOIN c b ON b.ix = a.ix + 1 AND b.iy = a.iy JOIN c d ON d.ix = a.ix AND d.iy = a.iy + 1 LEFT JOIN c e ON e.ix = a.ix + 1 AND e.iy = a.iy + 1 JOIN (SELECT 0 AS half UNION ALL SELECT 1) h ON h.half = 0 OR e.ix IS NOT NULL")
def grid_triangles(v: Views) -> DataFrame:
    return mesh.grid_triangles(mesh.cell_means(v.parts.select("*", *[F.lit(0).alias(c) for c in "rgb"])))


_CENTRE = """+ f AS (SELECT s.fid, s.seen, (a.x + b.x + c.x) / 3 AS e, (a.y + b.y + c.y) / 3 AS n, (a.z + b.z + c.z) / 3 AS u, b.x - a.x AS px, b.y - a.y AS py, b.z - a.z AS pz, c.x - a.x AS qx, c.y - a.y AS qy, c.z - a.z AS qz,
    least(a.x, b.x, c.x) AS min_x, greatest(a.x, b.x, c.x) AS max_x, least(a.y, b.y, c.y) AS min_y, greatest(a.y, b.y, c.y) AS max_y, least(a.z, b.z, c.z) AS min_z, greatest(a.z, b.z, c.z) AS max_z
    FROM solid s JOIN verts a ON a.vid = s.a JOIN verts b ON b.vid = s.b JOIN verts c ON c.vid = s.c),
    g AS (SELECT *, py * qz - pz * qy AS nx, pz * qx - px * qz AS ny, px * qy - py * qx AS nz FROM f)"""
_SEEN = _CENTRE + """, w AS (SELECT g.fid, k.cam, g.e - k.e AS dx, g.n - k.n AS dy, g.u - k.u AS dz, nx, ny, nz, c, s FROM g, cams k),
    p AS (SELECT *, dy * s - dz * c AS depth, sqrt(nx * nx + ny * ny + nz * nz) AS size, sqrt(dx * dx + dy * dy + dz * dz) AS away FROM w),
    q AS (SELECT *, 60 * dx / depth + 32 AS px, 60 * (-dy * c - dz * s) / depth + 24 AS py FROM p WHERE depth > 0.5 AND size > 0.00000001 AND -(nx * dx + ny * dy + nz * dz) / (size * away + 0.000000001) > 0.25),
    b AS (SELECT fid, cam, depth, least(floor(px * 8 / 64), 7) AS bx, least(floor(py * 8 / 48), 7) AS byy FROM q WHERE px >= 0 AND px < 64 AND py >= 0 AND py < 48), z AS (SELECT cam, bx, byy, min(depth) AS near FROM b GROUP BY ALL),
    seen AS (SELECT fid, count(DISTINCT cam) AS seen FROM b JOIN z USING (cam, bx, byy) WHERE depth <= near * 1.03 + 0.4 GROUP BY fid)"""


def _cams(v: Views) -> DataFrame:
    return v.cams.select("cam", "e", "n", "u", _rotation().alias("rotation"), F.lit(60.0).alias("fx"), F.lit(64).alias("width"), F.lit(48).alias("height"))


@query(_SEEN + " SELECT fid, coalesce(seen.seen, 0)::BIGINT AS seen FROM g LEFT JOIN seen USING (fid)")
def seen_faces(v: Views) -> DataFrame:
    """Faces seen by cameras that look down at a slant, turned toward them."""
    return mesh.seen_counts(route.centroids(v.verts, v.solid), _cams(v))


@query(
    _EDGE.replace(" mesh", " solid") + """, k AS (SELECT i, j, CASE WHEN n = 2 AND s = 1 THEN 'occlusion' WHEN n = 1 THEN 'boundary' END AS kind FROM g), t AS (SELECT * FROM k WHERE kind IS NOT NULL ORDER BY kind DESC, i, j LIMIT 500)
    SELECT i, j, kind, round(p.x, 2) AS ax, round(p.y, 2) AS ay, round(p.z, 2) AS az, round(q.x, 2) AS bx, round(q.y, 2) AS "by", round(q.z, 2) AS bz FROM t JOIN verts p ON p.vid = i JOIN verts q ON q.vid = j"""
)
def faultline_segments(v: Views) -> DataFrame:
    """The first 500 faultlines, with their ends."""
    return mesh.faultline_segments(v.verts, v.solid, 500)


_PATCH = (
    _CENTRE + ", " + _EDGE.replace(" mesh", " solid").lstrip("+ ").replace("g AS (", "eg AS (") + """, ed AS (SELECT fa AS a, fb AS b FROM eg WHERE n = 2 AND s = 0 UNION SELECT fb, fa FROM eg WHERE n = 2 AND s = 0), cc(node, comp) AS (SELECT fid, fid FROM solid WHERE seen = 0 UNION SELECT ed.b, cc.comp FROM cc JOIN ed ON ed.a = cc.node),
    mm AS (SELECT node AS fid, min(comp) AS first_face FROM cc GROUP BY node)"""
)


@query(
    _PATCH + """, zz AS (SELECT first_face, count(*)::BIGINT AS faces, round(min(min_x), 3) AS min_x, round(max(max_x), 3) AS max_x, round(min(min_y), 3) AS min_y, round(max(max_y), 3) AS max_y, round(min(min_z), 3) AS min_z, round(max(max_z), 3) AS max_z, round(sum(sqrt(nx * nx + ny * ny + nz * nz) * 0.5), 3) AS area_hint_m2 FROM g JOIN mm USING (fid) GROUP BY first_face)
    SELECT (row_number() OVER (ORDER BY faces DESC, first_face) - 1)::BIGINT AS patch, *, 'unseen' AS state, false AS measurement_safe FROM zz"""
)
def patch_summary(v: Views) -> DataFrame:
    return mesh.patch_summary(v.verts, v.solid)


@query(_PATCH + ", zz AS (SELECT first_face, count(*) AS c FROM mm GROUP BY first_face), fl AS (SELECT least(2000, count(*)) AS c FROM eg WHERE n = 1 OR (n = 2 AND s = 1)) SELECT count(*)::BIGINT AS faces, (count(*) FILTER (WHERE seen > 0))::BIGINT AS seen_faces, round(avg(CASE WHEN seen > 0 THEN 1.0 ELSE 0.0 END), 4) AS seen_fraction, (SELECT coalesce(max(c), 0) FROM zz)::BIGINT AS largest_unseen_patch, (SELECT c FROM fl)::BIGINT AS faultlines FROM solid")
def spatial_summary(v: Views) -> DataFrame:
    f = v.solid
    return mesh.spatial_summary(f, mesh.patch_summary(v.verts, f), mesh.faultline_segments(v.verts, f))


@query(_PATCH + ", zz AS (SELECT first_face, count(*) AS c FROM mm GROUP BY first_face) SELECT coalesce(max(c), 0)::BIGINT AS faces FROM zz")
def largest_unseen_patch(v: Views) -> DataFrame:
    return mesh.largest_unseen_patch(v.solid)


_LOOK = "+ k AS (SELECT vid, g / 50.0 AS conf, CASE WHEN r % 3 = 0 THEN 'a' ELSE 'b' END AS source, CASE WHEN vid % 11 = 0 THEN 'generated' ELSE 'observed' END AS state FROM verts)"


@query(_LOOK + " SELECT s.fid, round((a.conf + b.conf + c.conf) / 3, 4)::DOUBLE AS face_confidence, a.source AS face_source, CASE WHEN 'generated' IN (a.state, b.state, c.state) THEN 'generated' ELSE 'observed' END AS face_state, false AS measurement_safe FROM solid s JOIN k a ON a.vid = s.a JOIN k b ON b.vid = s.b JOIN k c ON c.vid = s.c")
def face_attributes(v: Views) -> DataFrame:
    k = v.verts.select("vid", (F.col("g") / 50.0).alias("conf"), F.when(F.col("r") % 3 == 0, "a").otherwise("b").alias("source"), F.when(F.col("vid") % 11 == 0, "generated").otherwise("observed").alias("state"))
    return mesh.face_attributes(k, v.solid)


@query("+ k AS (SELECT unnest([a, b, c]) AS vid, CASE WHEN seen > 0 THEN 1.0 ELSE 0.0 END AS s FROM solid) SELECT v.vid, round(coalesce(avg(s), 0.0), 6)::DOUBLE AS coverage FROM verts v LEFT JOIN k USING (vid) GROUP BY v.vid")
def vertex_coverage(v: Views) -> DataFrame:
    return rounded(mesh.vertex_coverage(v.verts, v.solid))


@query(
    "+ d AS (SELECT v.vid, c.id, c.source, c.u, row_number() OVER (PARTITION BY v.vid ORDER BY (v.x - c.e) * (v.x - c.e) + (v.y - c.n) * (v.y - c.n) + (v.z - c.u) * (v.z - c.u), c.id) AS k FROM verts v, customers c) SELECT vid, round(u / 19, 6) AS conf, source, CASE WHEN id % 5 = 0 THEN 'generated' ELSE 'observed' END AS state FROM d WHERE k = 1"
)
def vertex_attributes(v: Views) -> DataFrame:
    c = v.customers.select("id", "e", "n", "u", (F.col("u") / 19).alias("conf"), "source", (F.col("id") % 5 == 0).alias("synthetic"))
    return rounded(mesh.vertex_attributes(v.verts, c))


# routes

_STEPS = "+ xs AS (SELECT DISTINCT round(x, 2) AS v FROM verts), ys AS (SELECT DISTINCT round(y, 2) AS v FROM verts), st AS (SELECT v - lag(v) OVER (ORDER BY v) AS d FROM xs UNION ALL SELECT v - lag(v) OVER (ORDER BY v) FROM ys), sp AS (SELECT greatest(coalesce((SELECT median(d) FROM st WHERE d > 0.001), 1.0), 0.05) AS c0, max(x) - min(x) AS wx, max(y) - min(y) AS wy, min(x) AS e0, min(y) AS n0 FROM verts), ce AS (SELECT e0, n0, CASE WHEN greatest(wx, wy, c0) / c0 > 700 THEN greatest(wx, wy, c0) / 700 ELSE c0 END AS cell FROM sp)"
_HEIGHT = _STEPS + """, hg AS (SELECT least(greatest(floor((x - e0) / cell), 0), 699)::INT AS ix, least(greatest(floor((y - n0) / cell), 0), 699)::INT AS iy, median(z) AS h FROM verts, ce GROUP BY 1, 2),
    fm AS (SELECT (a.x + b.x + c.x) / 3 AS e, (a.y + b.y + c.y) / 3 AS n, s.seen FROM solid s JOIN verts a ON a.vid = s.a JOIN verts b ON b.vid = s.b JOIN verts c ON c.vid = s.c),
    sg AS (SELECT least(greatest(floor((e - e0) / cell), 0), 699)::INT AS ix, least(greatest(floor((n - n0) / cell), 0), 699)::INT AS iy, avg(CASE WHEN seen > 0 THEN 1.0 ELSE 0.0 END) AS seen FROM fm, ce GROUP BY 1, 2),
    gr AS (SELECT ix, iy, h, coalesce(seen, 1.0) AS seen FROM hg LEFT JOIN sg USING (ix, iy))"""
_WALK = _HEIGHT + """, bl AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'road' WHEN 1 THEN 'facade' WHEN 2 THEN 'ground' ELSE 'fill' END AS tag, n_nationkey * 4.0 AS e1, n_nationkey * 4.0 + 3.0 AS e2, n_regionkey * 3.0 AS n1, n_regionkey * 3.0 + 4.0 AS n2 FROM nation),
    wk AS (SELECT ix, iy, h, seen, e0 + (ix + 0.5) * cell AS e, n0 + (iy + 0.5) * cell AS n FROM gr, ce), tg AS (SELECT ix, iy, list_sort(list(DISTINCT tag)) AS tags FROM wk JOIN bl ON e BETWEEN e1 AND e2 AND n BETWEEN n1 AND n2 AND h BETWEEN -1.5 AND 6.5 GROUP BY ix, iy),
    ww AS (SELECT wk.*, coalesce(tags, []) AS tags FROM wk LEFT JOIN tg USING (ix, iy))"""


def _blocks(v: Views) -> DataFrame:
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    tag = F.when(n % 4 == 0, "road").when(n % 4 == 1, "facade").when(n % 4 == 2, "ground").otherwise("fill")
    return v.table("nation").select(n.alias("idx"), F.lit("").alias("id"), tag.alias("tag"), F.array(n * 4.0, r * 3.0, F.lit(-1.0)).alias("min"), F.array(n * 4.0 + 3.0, r * 3.0 + 4.0, F.lit(6.0)).alias("max"))


@query(_HEIGHT + " SELECT ix, iy, round(h, 6) AS h, round(seen, 6)::DOUBLE AS seen, round(cell, 6) AS cell FROM gr, ce")
def height_grid(v: Views) -> DataFrame:
    g = route.height_grid(v.verts, v.solid)
    return rounded(g.cells.withColumn("cell", F.lit(g.cell)))


@query(_WALK + " SELECT ix, iy, array_to_string(tags, ',') AS tags FROM ww")
def walkable_cells(v: Views) -> DataFrame:
    return route.walkable(route.height_grid(v.verts, v.solid), _blocks(v)).select("ix", "iy", F.array_join(F.array_sort("tags"), ",").alias("tags"))


_COSTS = _WALK + """, ee AS (SELECT a.ix, a.iy, b.ix AS jx, b.iy AS jy, cell * CASE WHEN a.ix <> b.ix AND a.iy <> b.iy THEN 1.41421356237 ELSE 1.0 END AS step, abs(b.h - a.h) AS rise, b.tags, b.seen
    FROM ww a JOIN ww b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND (a.ix <> b.ix OR a.iy <> b.iy), ce),
    st2 AS (SELECT ix, iy, jx, jy, step * CASE WHEN list_contains(tags, 'road') THEN 0.5 ELSE 1.0 END * CASE WHEN seen < 0.5 AND NOT list_contains(tags, 'fill') THEN 4.0 ELSE 1.0 END AS cost FROM ee WHERE rise / step <= 0.8 AND NOT list_contains(tags, 'facade'))"""


@query(_COSTS + " SELECT ix, iy, jx, jy, round(cost, 6)::DOUBLE AS cost FROM st2")
def route_steps(v: Views) -> DataFrame:
    g = route.height_grid(v.verts, v.solid)
    return rounded(route.grid_edges(route.walkable(g, _blocks(v)), g.cell))


@query(
    _COSTS + """, sc(ix, iy, cost) USING KEY (ix, iy) AS (SELECT ix, iy, 0.0::DOUBLE FROM (SELECT ix, iy FROM ww ORDER BY ix, iy LIMIT 1) UNION
        (SELECT s.jx, s.jy, min(sc.cost + s.cost)::DOUBLE FROM sc JOIN st2 s ON s.ix = sc.ix AND s.iy = sc.iy LEFT JOIN recurring.sc o ON o.ix = s.jx AND o.iy = s.jy WHERE o.cost IS NULL OR sc.cost + s.cost < o.cost GROUP BY s.jx, s.jy))
    SELECT ix, iy, round(cost, 5) AS cost FROM sc"""
)
def route_costs(v: Views) -> DataFrame:
    """The cheapest way from the first cell to each that can be reached."""
    g = route.height_grid(v.verts, v.solid)
    w = route.walkable(g, _blocks(v))
    start = w.orderBy("ix", "iy").limit(1).select(F.lit(0).cast("long").alias("request"), "ix", "iy")
    return rounded(route.shortest_paths(route.grid_edges(w, g.cell), start).select("ix", "iy", "cost"), 5)


@query(_HEIGHT + " SELECT ix, iy FROM gr, ce WHERE greatest(abs(ix - floor((3.3 - e0) / cell)), abs(iy - floor((-2.1 - n0) / cell))) <= 5 ORDER BY greatest(abs(ix - floor((3.3 - e0) / cell)), abs(iy - floor((-2.1 - n0) / cell))), sqrt(pow(e0 + (ix + 0.5) * cell - 3.3, 2) + pow(n0 + (iy + 0.5) * cell + 2.1, 2)), ix, iy LIMIT 1")
def snapped(v: Views) -> DataFrame:
    g = route.height_grid(v.verts, v.solid)
    return route.snap(g.cells, g, (3.3, -2.1))


@query("+ d AS (SELECT track AS route, sqrt(pow(alt - lag(alt) OVER w, 2) + pow(speed - lag(speed) OVER w, 2) + pow(hdop - lag(hdop) OVER w, 2)) AS d FROM track WINDOW w AS (PARTITION BY track ORDER BY seq)) SELECT route, round(coalesce(sum(d), 0), 3) AS length_m FROM d GROUP BY route")
def route_lengths(v: Views) -> DataFrame:
    return route.route_length(v.track.select(F.col("track").alias("route"), F.col("seq").alias("step"), F.col("alt").alias("e"), F.col("speed").alias("n"), F.col("hdop").alias("u")))


@query(
    """+ r AS (SELECT track AS route, seq AS step, alt, speed, hdop, hdop > 3.0 AS bad, row_number() OVER (PARTITION BY track ORDER BY seq) AS i FROM track), g AS (SELECT *, i - row_number() OVER (PARTITION BY route ORDER BY step) AS g FROM r WHERE bad),
    k AS (SELECT *, row_number() OVER (PARTITION BY route, g ORDER BY step) - 1 AS k, count(*) OVER (PARTITION BY route, g) AS c FROM g) SELECT route, round(alt, 3) AS e, round(speed, 3) AS n, round(hdop, 3) AS u, 'occlusion' AS kind FROM k WHERE k = floor(c / 2)"""
)
def unseen_flags(v: Views) -> DataFrame:
    p = v.track.select(F.col("track").alias("route"), F.col("seq").alias("step"), F.col("alt").alias("e"), F.col("speed").alias("n"), F.col("hdop").alias("h"), F.when(F.col("hdop") > 3.0, 0.0).otherwise(1.0).alias("seen"))
    return route.unseen_flags(p)


_RAW = """+ b AS (SELECT n_nationkey AS idx, CASE WHEN n_nationkey % 5 = 0 THEN 'Tree' WHEN n_nationkey % 2 = 0 THEN 'ROAD' ELSE 'fill' END AS tag, CASE WHEN n_nationkey % 6 = 1 THEN NULL ELSE n_nationkey * 4.0 END AS lo, CASE WHEN n_nationkey % 7 = 2 THEN n_nationkey * 4.0 ELSE n_nationkey * 4.0 - 3.0 END AS hi FROM nation),
    c AS (SELECT *, CASE WHEN tag = 'Tree' THEN 'tag must be one of road, facade, ground, fill' WHEN lo IS NULL THEN 'needs min and max ENU' WHEN abs(lo - hi) < 0.001 THEN 'has no volume' END AS reason FROM b)"""


@query(_RAW + " SELECT idx, CASE WHEN reason IS NULL THEN lower(tag) END AS tag, CASE WHEN reason IS NULL THEN least(lo, hi)::DOUBLE END AS lo, CASE WHEN reason IS NULL THEN greatest(lo, hi)::DOUBLE END AS hi, 'block ' || idx || ' ' || reason AS reason FROM c")
def normalized_blocks(v: Views) -> DataFrame:
    n = F.col("n_nationkey")
    corner = lambda x: F.array(x, x, x)
    raw = v.table("nation").select(n.alias("idx"), F.lit(None).cast("string").alias("id"), F.when(n % 5 == 0, "Tree").when(n % 2 == 0, "ROAD").otherwise("fill").alias("tag"), F.when(n % 6 != 1, corner(n * 4.0)).alias("min"), corner(F.when(n % 7 == 2, n * 4.0).otherwise(n * 4.0 - 3.0)).alias("max"))
    good, bad = route.normalize_blocks(raw)
    return good.select("idx", "tag", F.col("min")[0].alias("lo"), F.col("max")[0].alias("hi"), F.lit(None).cast("string").alias("reason")).unionByName(bad, allowMissingColumns=True)


# structure from motion

_ANGLE = "degrees(acos(least(greatest(((a.e - p.e) * (b.e - p.e) + (a.n - p.n) * (b.n - p.n) + (a.u - p.u) * (b.u - p.u)) / (sqrt(pow(a.e - p.e, 2) + pow(a.n - p.n, 2) + pow(a.u - p.u, 2)) * sqrt(pow(b.e - p.e, 2) + pow(b.n - p.n, 2) + pow(b.u - p.u, 2)) + 0.000000000001), -1), 1)))"


def _centers(v: Views) -> DataFrame:
    return v.suppliers.select(F.col("id").alias("cam"), *[F.col(a).alias(f"c{a}") for a in "enu"])


@query(
    f"""+ o AS (SELECT DISTINCT point, img FROM sights), s AS (SELECT x.img AS i, y.img AS j, count(*) AS shared, median({_ANGLE}) AS angle FROM o x JOIN o y ON x.point = y.point AND x.img < y.img JOIN parts p ON p.id = x.point JOIN suppliers a ON a.id = x.img JOIN suppliers b ON b.id = y.img GROUP BY ALL HAVING count(*) >= 15),
    k AS (SELECT i AS cam, j AS other, shared, angle FROM s WHERE angle BETWEEN 3 AND 30 UNION ALL SELECT j, i, shared, angle FROM s WHERE angle BETWEEN 3 AND 30), r AS (SELECT *, row_number() OVER (PARTITION BY cam ORDER BY abs(angle - 10) - 0.002 * shared, other)::INT AS rank FROM k)
    SELECT cam, other, shared::BIGINT AS shared, round(angle, 5) AS angle_deg, rank FROM r WHERE rank <= 2"""
)
def covisibility_neighbours(v: Views) -> DataFrame:
    """Suppliers as cameras that see the parts they deliver."""
    return rounded(sfm.covisible(v.sights, v.parts.withColumnRenamed("id", "point"), _centers(v)), 5)


_LOOKS = "+ q AS (SELECT o.point, o.img, o.x, o.y, p.e - c.e AS qx, -(p.n - c.n) AS qy, 60 - p.u - c.u AS qz FROM sights o JOIN parts p ON p.id = o.point JOIN suppliers c ON c.id = o.img), z AS (SELECT *, sqrt(pow(20 * qx / qz + 320 - x, 2) + pow(20 * qy / qz + 240 - y, 2)) AS px FROM q)"


def _down(v: Views) -> DataFrame:
    """Suppliers as cameras that look straight down from 60 m."""
    r = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, -1, 0, 0, 0, -1)])
    return v.suppliers.select(F.col("id").alias("cam"), r.alias("r"), F.array(-F.col("e"), F.col("n"), 60 - F.col("u")).alias("t"))


_K = {"fx": 20.0, "fy": 20.0, "cx": 320.0, "cy": 240.0}


def _points(v: Views) -> DataFrame:
    return v.parts.withColumnRenamed("id", "point")


@query(_LOOKS + ", g AS (SELECT * FROM z WHERE px <= 150 AND qz > 0) SELECT point, img FROM g WHERE point IN (SELECT point FROM g GROUP BY point HAVING count(*) >= 2)")
def pruned_observations(v: Views) -> DataFrame:
    return sfm.prune(v.sights, _points(v), _down(v), _K, 150.0).select("point", "img")


@query(
    _LOOKS + f""", e AS (SELECT point, count(*)::BIGINT AS views, avg(px) AS error_px FROM z GROUP BY point HAVING count(*) >= 2), w AS (SELECT x.point, max({_ANGLE}) AS angle FROM sights x JOIN sights y ON x.point = y.point AND x.img < y.img JOIN parts p ON p.id = x.point JOIN (SELECT id, e, n, 60 - u AS u FROM suppliers) a ON a.id = x.img JOIN (SELECT id, e, n, 60 - u AS u FROM suppliers) b ON b.id = y.img GROUP BY x.point)
    SELECT e.point, views, round(error_px, 5) AS error_px, round(coalesce(angle, 0), 5) AS angle_deg FROM e LEFT JOIN w USING (point)"""
)
def point_summary(v: Views) -> DataFrame:
    return rounded(sfm.point_summary(v.sights, _points(v), _down(v), _K), 5)


@query(
    _LOOKS + """, d AS (SELECT img AS cam, count(*) AS c, quantile_cont(qz, 0.05) AS p5, median(qz) AS mid, quantile_cont(qz, 0.95) AS p95 FROM z WHERE qz > 0 GROUP BY img HAVING count(*) >= 5), b AS (SELECT cam, greatest(p5, mid * 0.25) AS lo, least(p95, mid * 6) AS hi FROM d)
    SELECT cam, round(lo * 0.9, 6) AS near, round(hi * 1.1, 6) AS far FROM b WHERE hi > lo"""
)
def depth_bands(v: Views) -> DataFrame:
    return rounded(sfm.depth_band(v.sights, _points(v), _down(v)))


@query(
    """+ h AS (SELECT id FROM suppliers WHERE id % 3 = 0), n AS (SELECT id AS cam, id + k AS other, k AS rank FROM suppliers, (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) x),
    e AS (SELECT cam, other, 0 AS tier, rank AS pl FROM n WHERE other IN (SELECT id FROM h) AND cam IN (SELECT id FROM h) UNION ALL SELECT a.id, b.id, 1, b.id FROM h a, h b), m AS (SELECT cam, other, min(tier) AS tier, min(pl) FILTER (WHERE tier = 0) AS a0, min(pl) FILTER (WHERE tier = 1) AS a1 FROM e WHERE cam <> other GROUP BY cam, other),
    r AS (SELECT cam, other, row_number() OVER (PARTITION BY cam ORDER BY tier, CASE WHEN tier = 0 THEN a0 ELSE a1 END)::INT AS place FROM m) SELECT cam, other, place FROM r WHERE place <= 3"""
)
def views_to_check(v: Views) -> DataFrame:
    s = v.suppliers.select(F.col("id").alias("cam"))
    near = s.select("cam", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("rank")).select("cam", (F.col("cam") + F.col("rank")).alias("other"), "rank")
    return sfm.views_to_check(near, s.where("cam % 3 = 0"))


_DEPTHS = "SELECT (s_suppkey % 5)::INT AS cam, (s_suppkey // 5 % 40)::INT AS px, (s_suppkey // 200)::INT AS py, 10 + s_suppkey % 4 * 0.2 AS z FROM supplier"


@query(
    f"""+ d AS ({_DEPTHS}), w AS (SELECT *, (px - 20) / 20.0 * z + cam AS e, (py - 2) / 20.0 * z AS n FROM d), m AS (SELECT w.cam, w.px, w.py, w.z, o.k AS other, round_even(20 * (w.e - o.k) / w.z + 20, 0) AS uj, round_even(20 * w.n / w.z + 2, 0) AS vj FROM w, (SELECT unnest(range(5)) AS k) o WHERE o.k <> w.cam),
    g AS (SELECT m.cam, m.px, m.py, count(*) + 1 AS views FROM m JOIN d ON d.cam = m.other AND d.px = uj AND d.py = vj WHERE abs(d.z - m.z) < 0.03 * m.z + 0.05 GROUP BY ALL) SELECT w.cam, w.px, w.py, round(w.e, 5)::DOUBLE AS e, round(w.n, 5)::DOUBLE AS n, views::BIGINT AS views, least(views / 4, 1.0)::DOUBLE AS conf FROM w JOIN g USING (cam, px, py) WHERE views >= 2"""
)
def consistent_depths(v: Views) -> DataFrame:
    """Depth pixels of five cameras in a row that another one agrees with."""
    i = F.col("s_suppkey")
    d = v.table("supplier").select((i % 5).cast("int").alias("cam"), (F.floor(i / 5) % 40).cast("int").alias("px"), F.floor(i / 200).cast("int").alias("py"), (10 + i % 4 * 0.2).alias("z"))
    cams = v.spark.range(5).select(F.col("id").cast("int").alias("cam"), F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)]).alias("r"), F.array(-F.col("id").cast("double"), F.lit(0.0), F.lit(0.0)).alias("t"))
    views = cams.select("cam").join(cams.select(F.col("cam").alias("other")), F.col("cam") != F.col("other"))
    return rounded(sfm.consistent(d, cams, {"fx": 20.0, "fy": 20.0, "cx": 20.0, "cy": 2.0}, views).select("cam", "px", "py", "e", "n", "views", "conf"), 5)


_PAIRS = "+ m AS (SELECT l_suppkey AS i, l_partkey AS j, count(*) * 30 AS knn, count(*) * 20 AS ratio, sum(l_linenumber)::BIGINT AS inliers, sum(l_quantity) % 100 / 100 AS hr FROM lineitem GROUP BY ALL)"


def _matched(v: Views) -> DataFrame:
    n = F.count(F.lit(1))
    return v.table("lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg((n * 30).alias("knn"), (n * 20).alias("ratio"), F.sum("l_linenumber").alias("inliers"), (F.sum("l_quantity") % 100 / 100).alias("homography_ratio"))


@query(_PAIRS + " SELECT sum(knn)::BIGINT AS knn, sum(ratio)::BIGINT AS ratio, sum(inliers)::BIGINT AS inliers, (count(*) FILTER (WHERE inliers >= 15))::BIGINT AS good_pairs, (sum(ratio) - sum(inliers))::BIGINT AS outliers_removed FROM m")
def matching_totals(v: Views) -> DataFrame:
    return sfm.matching_totals(_matched(v))


@query(_PAIRS + " SELECT i, j, inliers FROM m WHERE inliers >= 15")
def good_pairs(v: Views) -> DataFrame:
    return sfm.good_pairs(_matched(v)).select("i", "j", "inliers")


@query(_PAIRS + " SELECT i, j, inliers, round(inliers * (1.15 - hr), 6) AS score FROM m WHERE inliers >= 10 ORDER BY inliers * (1.15 - hr) DESC, i, j LIMIT 1")
def initial_pair(v: Views) -> DataFrame:
    return rounded(sfm.initial_pair(_matched(v), 10).select("i", "j", "inliers", "score"))


@query("SELECT img, count(DISTINCT point)::BIGINT AS matches FROM sights WHERE point % 3 = 0 AND img % 4 <> 1 GROUP BY img HAVING count(DISTINCT point) >= 12 ORDER BY matches DESC, img LIMIT 1")
def next_image(v: Views) -> DataFrame:
    t = v.sights.withColumnRenamed("point", "track")
    return sfm.next_image(t, t.where("track % 3 = 0"), t.where("img % 4 = 1"))


@query(
    """+ p AS (SELECT 'im' || s_suppkey AS name, s_acctbal AS pose FROM supplier WHERE s_suppkey % 3 > 0), i AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'a/b/' ELSE '' END || 'im' || c_custkey AS name FROM customer)
    SELECT id, coalesce(w.pose, b.pose) AS pose FROM i LEFT JOIN p w ON w.name = i.name LEFT JOIN p b ON b.name = split_part(i.name, '/', -1) WHERE coalesce(w.pose, b.pose) IS NOT NULL"""
)
def image_poses(v: Views) -> DataFrame:
    p = v.table("supplier").where("s_suppkey % 3 > 0").select(F.concat(F.lit("im"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_acctbal").alias("pose"))
    i = v.table("customer").select(F.col("c_custkey").alias("id"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "a/b/").otherwise(""), F.lit("im"), F.col("c_custkey").cast("string")).alias("name"))
    return sfm.poses_of_images(i, p).select("id", "pose")


@query("SELECT round(sqrt(avg(pow(s.e - c.e, 2) + pow(s.n - c.n, 2) + pow(s.u - c.u, 2))), 6) AS rmse_m FROM suppliers s JOIN customers c ON s.id = c.id")
def alignment_error(v: Views) -> DataFrame:
    g = v.customers.select("id", *[F.col(a).alias(f"g{a}") for a in "enu"])
    return rounded(sfm.alignment_error(v.suppliers.join(g, "id")))


_MATCHES = "+ m AS (SELECT (c_custkey % 6)::BIGINT * 4294967296 + c_custkey // 6 % 50 AS a, ((c_custkey + 1 + c_nationkey % 2) % 6)::BIGINT * 4294967296 + c_custkey // 7 % 50 AS b FROM customer)"


@query(
    _MATCHES + """, u AS (SELECT a, b FROM m UNION SELECT b, a FROM m), c(node, comp) AS (SELECT a, a FROM u UNION SELECT u.b, c.comp FROM c JOIN u ON u.a = c.node), k AS (SELECT min(comp) AS track, node // 4294967296 AS img, node % 4294967296 AS kp FROM c GROUP BY node),
    g AS (SELECT track FROM (SELECT track, img, count(*) AS c FROM k GROUP BY track, img) GROUP BY track HAVING max(c) = 1 AND count(*) >= 2) SELECT track, img::INT AS img, kp::BIGINT AS kp FROM k WHERE track IN (SELECT track FROM g)"""
)
def feature_tracks(v: Views) -> DataFrame:
    c = F.col("c_custkey")
    m = v.table("customer").select((c % 6).alias("i"), (F.floor(c / 6) % 50).alias("ka"), ((c + 1 + F.col("c_nationkey") % 2) % 6).alias("j"), (F.floor(c / 7) % 50).alias("kb"))
    return graph.tracks(m).select("track", "img", "kp")


@query(
    """+ x AS (SELECT label AS img, vec_id AS kp, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.img AS i, b.img AS j, a.kp AS ka, b.kp AS kb, list_distance(a.v, b.v) AS d FROM x a JOIN x b ON a.img < b.img),
    r AS (SELECT *, row_number() OVER (PARTITION BY i, j, ka ORDER BY d, kb) AS ra, lead(d) OVER (PARTITION BY i, j, ka ORDER BY d, kb) AS sa, row_number() OVER (PARTITION BY i, j, kb ORDER BY d, ka) AS rb, lead(d) OVER (PARTITION BY i, j, kb ORDER BY d, ka) AS sb FROM d)
    SELECT i, j, ka, kb, round(d, 6) AS d FROM r WHERE ra = 1 AND rb = 1 AND d < 0.8 * sa AND d < 0.8 * sb"""
)
def mutual_ratio_strict(v: Views) -> DataFrame:
    """The same at the usual ratio of 0.8."""
    d = v.table("embeddings").select(F.col("label").alias("img"), F.col("vec_id").alias("kp"), F.col("embedding").alias("desc"))
    i = d.select("img").distinct()
    return rounded(matching.mutual_matches(d, i.select(F.col("img").alias("i")).join(i.select(F.col("img").alias("j")), F.col("i") < F.col("j")), 0.8, 1))


# contracts, logs and sinks

_SAMPLE = """+ s AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 's' || doc_id END AS sample_id, source, (doc_id % 4)::INT AS frames, (doc_id % 4 + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END)::INT AS poses, doc_id % 19 = 0 AS far, doc_id % 23 = 0 AS lost FROM documents)"""


@query(
    _SAMPLE + """ SELECT 'ids_missing' AS rule, sample_id AS subject FROM s WHERE sample_id = '' OR coalesce(source, '') = '' UNION ALL SELECT 'no_frames', sample_id FROM s WHERE frames = 0 UNION ALL SELECT 'lengths_differ', sample_id FROM s WHERE frames <> poses
    UNION ALL SELECT 'origin_keys', sample_id FROM s WHERE far UNION ALL SELECT 'paths_missing', sample_id FROM s WHERE lost"""
)
def sample_violations(v: Views) -> DataFrame:
    i = F.col("doc_id")
    many = lambda n, x: F.when(n > 0, F.array_repeat(x, n.cast("int"))).otherwise(F.array().cast(x_type(x)))
    x_type = lambda x: "array<string>" if x is text else "array<double>" if x is number else "array<array<double>>"
    text, number, row = F.lit("f"), F.lit(1.0), F.array(F.lit(1.0))
    frames_, poses = i % 4, i % 4 + F.when(i % 17 == 0, 1).otherwise(0)
    origin = F.when(i % 19 == 0, F.create_map(F.lit("lat"), F.lit(0.0))).otherwise(F.create_map(*[F.lit(x) for k in ("lat", "lon", "alt") for x in (k, 0.0)]))
    s = v.table("documents").select(
        F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("s"), i.cast("string"))).alias("sample_id"), F.col("source").alias("scene_id"), many(frames_, text).alias("frame_paths"), many(frames_, number).alias("timestamps_s"),
        many(poses, row).alias("camera_poses_w2c"), many(frames_, row).alias("intrinsics"), origin.alias("origin"), F.lit("g").alias("visible_geometry_path"), F.when(i % 23 != 0, "v").alias("visibility_path"),
    )
    return contracts.sample_violations(s)


@query(
    """+ p AS (SELECT event_id AS i, value / 400 AS un FROM events) SELECT 'ids_missing' AS rule, CASE WHEN i % 29 <> 0 THEN 'p' || i END AS subject FROM p WHERE i % 29 = 0 UNION ALL SELECT 'negative_patch', CASE WHEN i % 29 <> 0 THEN 'p' || i END FROM p WHERE i % 31 = 0
    UNION ALL SELECT 'unknown_state', CASE WHEN i % 29 <> 0 THEN 'p' || i END FROM p WHERE i % 7 = 0 UNION ALL SELECT 'uncertainty_range', CASE WHEN i % 29 <> 0 THEN 'p' || i END FROM p WHERE un > 1 UNION ALL SELECT 'measurement_safe', CASE WHEN i % 29 <> 0 THEN 'p' || i END FROM p WHERE i % 37 = 0"""
)
def proposal_violations(v: Views) -> DataFrame:
    i = F.col("event_id")
    p = v.table("events").select(F.when(i % 29 != 0, F.concat(F.lit("p"), i.cast("string"))).alias("proposal_id"), F.lit("r").alias("scene_revision"), F.when(i % 31 == 0, -1).otherwise(2).alias("patch_id"), F.when(i % 7 == 0, "lost").otherwise("accepted").alias("state"), (F.col("value") / 400).alias("uncertainty"), (i % 37 == 0).alias("measurement_safe"))
    return contracts.proposal_violations(p)


@query("SELECT DISTINCT 'generated_measured' AS rule, n_nationkey::VARCHAR AS subject FROM nation WHERE n_nationkey % 5 = 0")
def scene_violations(v: Views) -> DataFrame:
    """Manifests as they are written, some spoiled."""
    m = sinks.scene_manifest(_scenes(v)).withColumn("measurement", F.struct(F.lit("metric_cloud").alias("source"), (F.col("scene_id") % 5 == 0).alias("generated_geometry_included")))
    return contracts.scene_violations(m)


def _scenes(v: Views) -> DataFrame:
    n = F.col("n_nationkey")
    return v.table("nation").select(n.alias("scene_id"), F.struct(n.cast("double").alias("lat"), F.lit(2.0).alias("lon"), F.lit(3.0).alias("alt")).alias("origin"), (n * 10).alias("points"), F.lit(4).alias("cameras"), F.when(n % 2 == 0, "ok").alias("mesh_status"), F.when(n % 2 == 0, "dsm25d").alias("mesh_method"), (n % 3 == 0).alias("has_spatial"))


@query("SELECT n_nationkey AS scene_id, n_nationkey * 10 AS points, CASE WHEN n_nationkey % 2 = 0 THEN 'ok' ELSE 'skipped' END AS mesh, n_nationkey % 3 = 0 AS spatial, true AS authoritative, false AS generated FROM nation")
def scene_manifests(v: Views) -> DataFrame:
    """Manifests through JSON and back."""
    m = sinks.scene_manifest(_scenes(v))
    text = m.select("scene_id", F.to_json(F.struct(*[c for c in m.columns if c != "scene_id"])).alias("j"))
    back = text.select("scene_id", F.from_json("j", files.SCENE).alias("s"))
    return back.select("scene_id", F.col("s.reconstruction.points").cast("int").alias("points"), F.col("s.mesh.status").alias("mesh"), F.col("s.spatial.available").alias("spatial"), F.col("s.reconstruction.measurement_authoritative").alias("authoritative"), F.col("s.measurement.generated_geometry_included").alias("generated"))


@query("SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM documents")
def scene_splits(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", contracts.scene_split(F.col("doc_id")).alias("split"))


@query(
    """+ c AS (SELECT user_id AS job, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) FILTER (WHERE value > 489) AS h FROM events GROUP BY user_id), k AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS place, unnest(['angles', 'blur', 'illum', 'dynamic', 'gps', 'realtime', 'occlude', 'metric']) AS id)
    SELECT job, place::INT AS place, id, CASE place WHEN 1 THEN e > 0 WHEN 2 THEN h > 0 WHEN 4 THEN h > 0 ELSE true END AS active FROM c, k"""
)
def challenge_rows(v: Views) -> DataFrame:
    yes = F.lit(True)
    c = v.table("events").groupBy(F.col("user_id").alias("job")).agg(F.count_if(F.col("event_type") == "error").alias("blur_dropped"), F.count_if(F.col("value") > 489).alias("illumination"))
    return contracts.challenges(c.withColumns({"sparse": yes, "dynamic": yes, "gps_downweighted": F.col("illumination") > 0, "near_rt": yes, "occlusions": yes, "metric": yes}), "job")


@query("SELECT event_id, trunc(12 + 80 * (event_id % 9 + 1) / 9)::INT AS progress, (event_id % 2 = 0)::INT AS stats FROM events")
def progress_mapped(v: Views) -> DataFrame:
    """A chunk's share of a stage as percent of its job, and statistics without nulls and reserved keys."""
    i = F.col("event_id")
    stats = contracts.safe_stats(F.create_map(F.lit("points"), F.when(i % 2 == 0, i.cast("string")), F.lit("status"), F.lit("x")))
    return v.table("events").select("event_id", contracts.progress(12, 92, i % 9 + 1, F.lit(9)).alias("progress"), F.size(F.map_keys(stats)).alias("stats"))


_EVENTS = f"+ g AS ({LOG.replace('{us}', '0')}), v AS (SELECT job, seq, type, CASE WHEN seq % 3 > 0 THEN 'm' || seq END AS message, progress, 's' || seq % 4 AS stage, CASE WHEN seq % 5 = 0 THEN 'running' ELSE 'done' END AS status FROM g WHERE type <> 'error' OR job % 2 = 0)"


@query(
    _EVENTS + """, w AS (SELECT *, CASE WHEN type = 'stage' THEN stage || ' - ' || status WHEN type IN ('status', 'done', 'error') THEN message END AS said, CASE WHEN type = 'done' THEN 100 WHEN type IN ('status', 'stage') AND progress <> 0 THEN progress END AS moved FROM v),
    j AS (SELECT job, max_by(said, seq) FILTER (WHERE said IS NOT NULL) AS message, coalesce(max_by(moved, seq) FILTER (WHERE moved IS NOT NULL), 0)::INT AS progress, CASE WHEN bool_or(type = 'error') THEN 'error' WHEN bool_or(type = 'done') THEN 'done' ELSE 'running' END AS status FROM w GROUP BY job),
    t AS (SELECT job, stage, max_by(status, seq) AS s FROM w WHERE type = 'stage' GROUP BY job, stage), u AS (SELECT t.job, string_agg(stage || '=' || CASE WHEN j.status = 'error' AND s = 'running' THEN 'failed' ELSE s END, ',' ORDER BY stage) AS stages FROM t JOIN j USING (job) GROUP BY t.job)
    SELECT job, CASE WHEN status = 'error' THEN 'Reconstruction failed' ELSE coalesce(message, '') END AS message, progress, status, coalesce(stages, '') AS stages FROM j LEFT JOIN u USING (job)"""
)
def job_snapshots(v: Views) -> DataFrame:
    """The whole fold of each job's events: message, progress, status and stages."""
    s = contracts.snapshot(_events(v))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("stages")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return s.select("job", "message", "progress", "status", listed.alias("stages"))


def _events(v: Views) -> DataFrame:
    s = F.col("seq")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    log = v.log.where("type <> 'error' or job % 2 = 0")
    return log.select("job", "seq", "type", F.when(s % 3 > 0, text("m", s)).alias("message"), "progress", text("s", s % 4).alias("stage"), F.lit(None).cast("string").alias("label"), F.when(s % 5 == 0, "running").otherwise("done").alias("status"), F.lit(None).cast("string").alias("payload"))


@query("SELECT user_id AS job, event_id AS seq, unnest(CASE WHEN event_type IN ('purchase', 'error') THEN [0, 1] ELSE [0] END)::INT AS part FROM events")
def sent_events(v: Views) -> DataFrame:
    """Events as they are sent, with end markers."""
    return jobs.with_end(v.log).select("job", "seq", "part")


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def event_properties(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT track, count(*)::BIGINT AS points, round(min(lon), 6) AS west FROM track GROUP BY track")
def trajectories(v: Views) -> DataFrame:
    """The flight of each track as a line, read back from its JSON."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("t", F.array("lon", "lat", "alt").alias("p")))), lambda x: x["p"])
    text = v.track.groupBy("track").agg(F.to_json(F.struct(line.alias("coordinates"))).alias("j"))
    back = F.from_json("j", "coordinates array<array<double>>")["coordinates"]
    return rounded(text.select("track", F.size(back).cast("long").alias("points"), F.array_min(F.transform(back, lambda p: p[0])).alias("west")))


@query("+ b AS (SELECT c_custkey AS id, 28.5 + c_acctbal / 1000000 AS lat, 77.2 + c_nationkey / 1000 AS lon, c_custkey % 7 + 1 AS n FROM customer) SELECT id FROM b WHERE n >= 4 AND lat BETWEEN 28.505 - 500 / 111320.0 AND 28.505 + 500 / 111320.0 AND lon BETWEEN 77.205 - 500 / (111320.0 * cos(radians(28.505))) AND 77.205 + 500 / (111320.0 * cos(radians(28.505))) ORDER BY id LIMIT 700")
def buildings_near(v: Views) -> DataFrame:
    c = v.table("customer").select(F.col("c_custkey").alias("id"), F.lit(9.0).alias("height"), F.array_repeat(F.array(77.2 + F.col("c_nationkey") / 1000, 28.5 + F.col("c_acctbal") / 1000000), (F.col("c_custkey") % 7 + 1).cast("int")).alias("ring"))
    return files.buildings_near(c, 28.505, 77.205, 500.0).select("id")


@query("SELECT i AS seq, round(round(i * 0.45, 3), 3)::DOUBLE AS t, CASE WHEN i BETWEEN 22 AND 26 THEN 3.4 ELSE round(0.9 + 0.15 * abs(sin(i / 9)), 2) END::DOUBLE AS hdop, round(216 + 78 + 0.8 * sin(i / 5), 6)::DOUBLE AS alt FROM (SELECT unnest(range(64)) AS i)")
def demo_flight(v: Views) -> DataFrame:
    d = demo.telemetry(v.spark)
    return d.select((F.row_number().over(Window.orderBy("t")) - 1).cast("long").alias("seq"), "t", "hdop", F.round("alt", 6).alias("alt"))


