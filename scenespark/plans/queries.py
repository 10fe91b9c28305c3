"""Queries of the library's operators over whole tables, with the same in SQL.

The tables stand in for tracks, clouds, meshes and logs; the projections are the same SQL text in
both engines, but for the microseconds since the first day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, scores
from ..operators import cloud, contracts, frames, graph, matching, mesh, telemetry

TRACK = """SELECT user_id AS track, event_id AS seq, {us} / 1000000.0 AS t, 28.5448 + value * 0.00001 AS lat, 77.1924 + (user_id % 100) * 0.00001 AS lon,
    200 + value / 10 AS alt, (value * 7) % 360 AS heading, value / 10 AS speed, CAST(0.8 + (event_id % 40) / 10.0 AS DOUBLE) AS hdop, event_id % 50 = 0 AS rtk FROM events"""
CLOUD = """SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity * 2 - 50 AS e, floor(l_extendedprice) / 1024 - 50 AS n, floor(l_discount * 1000 - l_tax * 500) / 16 AS u,
    CAST(l_orderkey % 256 AS INT) AS r, CAST(l_partkey % 256 AS INT) AS g, CAST(l_suppkey % 256 AS INT) AS b, 0.05 + 0.9 * l_tax / 0.08 AS conf, l_linenumber AS observations,
    l_returnflag AS source, l_linestatus AS status, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount + 0.05 END AS uncertainty_m, l_linestatus = 'O' AS synthetic,
    (((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey) * 1009 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS seq FROM lineitem"""
PARTS = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS e, p_retailprice / 20 AS n, CAST(p_partkey % 37 AS DOUBLE) / 4 AS u FROM part"
CUSTOMERS = "SELECT c_custkey AS id, c_acctbal / 100 AS e, CAST(c_nationkey AS DOUBLE) AS n, CAST(c_custkey % 19 AS DOUBLE) AS u, c_mktsegment AS source FROM customer"
SUPPLIERS = "SELECT s_suppkey AS id, s_acctbal / 100 AS e, CAST(s_nationkey AS DOUBLE) AS n, CAST(s_suppkey % 19 AS DOUBLE) AS u FROM supplier"
CAMERAS = "SELECT n_nationkey AS cam, n_nationkey * 4.0 - 50 AS e, n_regionkey * 20.0 - 45 AS n, CAST(30 + n_nationkey AS DOUBLE) AS u FROM nation"
FRAMES = """SELECT doc_id AS idx, CAST(n_chars % 97 AS DOUBLE) AS sharpness, CAST(n_chars % 331 AS DOUBLE) AS features, CAST(n_chars % 7 AS DOUBLE) AS texture,
    CAST(n_chars % 11 AS DOUBLE) / 10 AS exposure, CAST(n_chars % 1000 AS DOUBLE) / 1000 AS redundancy FROM documents"""
# a mesh of 100 columns: vertex p_partkey, two faces a square; a part's size tells whether its faces are seen
MESH = """SELECT p_partkey * 2 + h.half AS fid, p_partkey AS a, CASE WHEN h.half = 0 THEN p_partkey + 1 ELSE p_partkey + 101 END AS b,
    CASE WHEN h.half = 0 THEN p_partkey + 101 ELSE p_partkey + 100 END AS c, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END AS seen
    FROM part, (SELECT 0 AS half UNION ALL SELECT 1 AS half) h"""
# the whole faces of that mesh, its vertices, and cameras that look down at a slant
SOLID = MESH + " WHERE p_partkey + 101 <= (SELECT max(p_partkey) FROM part)"
VERTS = "SELECT p_partkey AS vid, CAST(p_partkey % 100 AS DOUBLE) AS x, CAST(floor(p_partkey / 100) AS DOUBLE) AS y, p_size / 10 AS z, CAST(p_partkey % 256 AS INT) AS r, CAST(p_size AS INT) AS g, 7 AS b FROM part"
CAMS = "SELECT n_nationkey AS cam, n_nationkey * 4.0 AS e, n_regionkey * 4.0 AS n, CAST(30 + n_nationkey AS DOUBLE) AS u, cos(radians(n_nationkey * 2.0)) AS c, sin(radians(n_nationkey * 2.0)) AS s FROM nation"
SIGHTS = "SELECT DISTINCT l_partkey AS point, l_suppkey AS img, CAST(l_partkey % 640 AS DOUBLE) AS x, CAST(l_suppkey % 480 AS DOUBLE) AS y FROM lineitem"
BOXES = """SELECT n_nationkey AS box, CASE n_nationkey % 4 WHEN 0 THEN 'road' WHEN 1 THEN 'facade' WHEN 2 THEN 'ground' ELSE 'fill' END AS tag, n_nationkey * 4.0 - 50 AS min_e, n_nationkey * 4.0 - 40 AS max_e,
    n_regionkey * 20.0 - 50 AS min_n, n_regionkey * 20.0 - 20 AS max_n, -2.0 AS min_u, 3.0 AS max_u FROM nation"""
LOG = "SELECT user_id AS job, event_id AS seq, CASE event_type WHEN 'click' THEN 'status' WHEN 'view' THEN 'stage' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'meta' END AS type, value, CAST(event_id % 7 AS INT) * 10 AS progress FROM events"
SAMPLES = "SELECT d.doc_id AS sample_id, d.source AS scene_id, CASE WHEN d.lang = 'de' THEN 'unknown' ELSE d.lang END AS license FROM documents d"
SPLITS = "SELECT CASE l.quality + 2 * l.toxic WHEN 0 THEN 'test' WHEN 1 THEN 'train' WHEN 2 THEN 'extra' ELSE 'val' END AS split, l.doc_id * 2 AS sample_id FROM labels l"
EDGES = "SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem"
PAIRS = "SELECT e AS px, n AS py, u AS pz, 10 - 3.4 * n AS qx, -4 + 3.4 * e AS qy, 2 + 3.4 * u AS qz FROM cloud"

VIEWS = {"track": TRACK, "cloud": CLOUD, "parts": PARTS, "customers": CUSTOMERS, "suppliers": SUPPLIERS, "cameras": CAMERAS, "frames": FRAMES, "mesh": MESH, "boxes": BOXES, "log": LOG, "samples": SAMPLES, "splits": SPLITS, "edges": EDGES, "solid": SOLID, "verts": VERTS, "cams": CAMS, "sights": SIGHTS}
TABLES = ("nation", "customer", "supplier", "part", "lineitem", "events", "documents", "embeddings", "labels", "orders")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Views:
    """The projections of one folder's tables, each read when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        sql = VIEWS[name].replace("{us}", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
        own = {t: self.table(t) for t in TABLES if f" {t}" in sql}
        for t in own:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
        return self.spark.sql(sql, **own)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            used = [v for v in VIEWS if f" {v}" in sql]
            ctes = ", ".join(f"{v} AS ({VIEWS[v].replace('{us}', chr(39).join(['date_diff(', 'microsecond', ', TIMESTAMP ', '2024-01-01 00:00:00', ', ts)']))})" for v in used)
            own = sql.lstrip().startswith("+")
            ORACLE_SQL[f.__name__] = (f"WITH RECURSIVE {ctes}" if ctes or own else "") + (", " if ctes and own else " ") + sql.lstrip().removeprefix("+")
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# lengths and tracks

_ECEF = """+ g AS (SELECT *, 6378137.0 / sqrt(1 - 0.00669437999014 * sin(radians(lat)) * sin(radians(lat))) AS nn FROM track),
    x AS (SELECT *, (nn + alt) * cos(radians(lat)) * cos(radians(lon)) AS cx, (nn + alt) * cos(radians(lat)) * sin(radians(lon)) AS cy, (nn * (1 - 0.00669437999014) + alt) * sin(radians(lat)) AS cz FROM g),
    d AS (SELECT track, seq, sqrt(pow(cx - lag(cx) OVER w, 2) + pow(cy - lag(cy) OVER w, 2) + pow(cz - lag(cz) OVER w, 2)) AS m FROM x WINDOW w AS (PARTITION BY track ORDER BY t, seq))"""


@query(_ECEF + " SELECT track, seq, round(m, 3) AS measured_m, round(abs(m - 20), 3) AS abs_error_m, round(abs(m - 20) / 20 * 100, 2) AS pct_error, 1.0::DOUBLE AS tolerance_m, abs(m - 20) <= 1 AS pass FROM d WHERE m IS NOT NULL")
def metric_measure(v: Views) -> DataFrame:
    from pyspark.sql import Window

    origin, s = geo.Origin(28.5448, 77.1924, 200.0), v.track
    w = Window.partitionBy("track").orderBy("t", "seq")
    s = s.select("track", "seq", "t", *[c.alias(a) for a, c in zip("enu", origin.enu(F.col("lat"), F.col("lon"), F.col("alt")))])
    m = s.select("track", "seq", F.sqrt(sum((F.pow(F.col(a) - F.lag(a).over(w), 2) for a in "nu"), F.pow(F.col("e") - F.lag("e").over(w), 2))).alias("m")).where("m is not null")
    return m.select("track", "seq", *[c.alias(k) for k, c in scores.evaluate_length(F.col("m"), F.lit(20.0), F.lit(None).cast("double"), F.lit(5.0)).items()])


_STEPS = """+ s AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(speed) OVER w AS pspeed, greatest(t - lag(t) OVER w, 0.001) AS dt FROM track WINDOW w AS (PARTITION BY track ORDER BY t, seq)),
    g AS (SELECT *, sqrt(pow((lat - plat) * 111320.0, 2) + pow((lon - plon) * 111320.0 * cos(radians(plat)), 2)) / dt AS v FROM s)"""


@query(_STEPS + " SELECT track, seq, round(v, 6) AS ground_speed, v > 6 * greatest(speed, pspeed, 1.0) AND v > 40 AS jump FROM g WHERE v IS NOT NULL")
def speed_jumps(v: Views) -> DataFrame:
    return telemetry.steps(v.track).where("ground_speed is not null").select("track", "seq", F.round("ground_speed", 6).alias("ground_speed"), telemetry.is_jump().alias("jump"))


@query(
    _STEPS + """, r AS (SELECT track, median(hdop) AS median_hdop, count(*) FILTER (WHERE v > 6 * greatest(speed, pspeed, 1.0) AND v > 40) AS jumps, count(*) AS n, bool_or(rtk) AS rtk FROM g GROUP BY track)
    SELECT track, round(median_hdop, 6) AS median_hdop, jumps::BIGINT AS jumps, round(least(greatest(least(greatest(1 - (median_hdop - 0.8) / 4, 0.15), 1.0) - least(0.6, jumps / n * 8) + CASE WHEN rtk THEN 0.12 ELSE 0 END, 0.1), 1.0), 6) AS reliability FROM r"""
)
def track_reliability(v: Views) -> DataFrame:
    return rounded(telemetry.reliability(v.track))


_ASOF = """+ p AS (SELECT track, seq AS probe_id, t + 1800.25 AS tt FROM track),
    b AS (SELECT track, t AS tt, 0 AS kind, NULL::BIGINT AS probe_id, seq, {'t': t, 'lat': lat, 'lon': lon, 'alt': alt, 'speed': speed, 'hdop': hdop, 'heading': heading, 'rtk': rtk} AS s FROM track
        UNION ALL SELECT track, tt, 1, probe_id, NULL::BIGINT, NULL FROM p),
    w AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY track ORDER BY tt, kind, seq NULLS FIRST, probe_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x,
        first_value(s IGNORE NULLS) OVER (PARTITION BY track ORDER BY tt, kind, seq NULLS FIRST, probe_id NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y FROM b),
    c AS (SELECT track, probe_id, tt, coalesce(x, y) AS a, coalesce(y, x) AS z FROM w WHERE kind = 1),
    f AS (SELECT *, CASE WHEN z.t = a.t THEN 0 ELSE (tt - a.t) / (z.t - a.t) END AS k, ((z.heading - a.heading + 180) % 360 + 360) % 360 - 180 AS turn FROM c)"""


@query(
    _ASOF + """ SELECT track, probe_id, round(CASE WHEN z.t = a.t THEN a.t ELSE tt END, 6) AS t, round(a.lat + k * (z.lat - a.lat), 6) AS lat, round(a.lon + k * (z.lon - a.lon), 6) AS lon, round(a.alt + k * (z.alt - a.alt), 6) AS alt,
    round(a.speed + k * (z.speed - a.speed), 6) AS speed, round(a.hdop + k * (z.hdop - a.hdop), 6) AS hdop, round(((a.heading + k * turn) % 360 + 360) % 360, 6) AS heading, a.rtk AND z.rtk AS rtk FROM f"""
)
def asof_interpolate(v: Views) -> DataFrame:
    s = v.track
    return rounded(telemetry.interpolate(s, s.select("track", F.col("seq").alias("probe_id"), (F.col("t") + 1800.25).alias("at"))))


# clouds

_CONF = "least(greatest(0.28 * least(observations / 6, 1.0) + 0.22 * least(abs(u) / 5, 1.0) + 0.18 * least(conf, 1.0) + 0.18 * conf + 0.14 * least(greatest(1 - abs(u) / 4, 0), 1), 0.05), 0.98)"


@query(f"+ c AS (SELECT {_CONF} AS c, source FROM cloud) SELECT source, count(*)::BIGINT AS points, count(*) FILTER (WHERE c >= 0.72)::BIGINT AS high, count(*) FILTER (WHERE c >= 0.42 AND c < 0.72)::BIGINT AS medium, count(*) FILTER (WHERE c < 0.42)::BIGINT AS low, round(avg(least(greatest(1 / greatest(c, 0.05), 0.05), 20)), 6) AS mean_uncertainty FROM c GROUP BY source")
def confidence_bands(v: Views) -> DataFrame:
    c = v.cloud.withColumn("c", scores.point_confidence(F.col("observations"), F.abs("u") / 5, F.col("conf"), F.col("conf"), F.abs("u")))
    b = scores.band(F.col("c"))
    return rounded(c.groupBy("source").agg(F.count(F.lit(1)).alias("points"), *[F.count_if(b == x).alias(x) for x in ("high", "medium", "low")], F.avg(scores.uncertainty(F.col("c"))).alias("mean_uncertainty")))


def _voxel_sql(key: str) -> str:
    keys = ", ".join(f"{key.replace('X', a)}::BIGINT AS k{a}" for a in "enu")
    return f"""+ k AS (SELECT *, {keys} FROM cloud), s AS (SELECT ke, kn, ku, source, count(*) AS m, min(seq) AS f FROM k GROUP BY ALL),
    t AS (SELECT ke, kn, ku, source FROM s QUALIFY row_number() OVER (PARTITION BY ke, kn, ku ORDER BY m DESC, f) = 1)
    SELECT ke, kn, ku, round(avg(e), 6) AS e, round(avg(n), 6) AS n, round(avg(u), 6) AS u, floor(avg(r))::INT AS r, floor(avg(g))::INT AS g, floor(avg(b))::INT AS b, count(*)::BIGINT AS points, round(least(0.98, max(conf) + least(0.12, 0.02 * count(*))), 6) AS conf,
    sum(observations)::BIGINT AS observations, t.source AS source, list_sort(list_distinct(flatten(list([k.source, status]))))::VARCHAR AS provenance, round(min(uncertainty_m), 6) AS uncertainty_m, bool_and(synthetic) AS synthetic
    FROM k JOIN t USING (ke, kn, ku) GROUP BY ke, kn, ku, t.source"""


def _fused(v: Views, floor: bool) -> DataFrame:
    out = cloud.voxel_fuse(v.cloud.withColumn("provenance", F.array("source", "status")), 5.0, floor)
    return rounded(out.withColumn("provenance", F.concat(F.lit("["), F.array_join("provenance", ", "), F.lit("]"))))


@query(_voxel_sql("trunc(X / 5.0)"))
def voxel_fuse(v: Views) -> DataFrame:
    return _fused(v, False)


@query(_voxel_sql("floor(X / 5.0)"))
def voxel_fuse_floor(v: Views) -> DataFrame:
    return _fused(v, True)


@query("+ q AS (SELECT quantile_cont(e, 0.005) AS q1, quantile_cont(e, 0.995) AS q2, quantile_cont(n, 0.005) AS q3, quantile_cont(n, 0.995) AS q4 FROM cloud) SELECT id, seq, round(e, 6) AS e, round(n, 6) AS n FROM cloud, q WHERE e BETWEEN q1 AND q2 AND n BETWEEN q3 AND q4")
def percentile_trim(v: Views) -> DataFrame:
    return rounded(cloud.percentile_trim(v.cloud).select("id", "seq", "e", "n"))


@query("+ p AS (SELECT row_number() OVER () AS k, seq, e, n, u FROM cloud), d AS (SELECT k, seq, min(sqrt(pow(p.e - c.e, 2) + pow(p.n - c.n, 2) + pow(p.u - c.u, 2))) AS m FROM p, cameras c GROUP BY k, seq), q AS (SELECT median(m) AS mid FROM d) SELECT seq, round(m, 6) AS camera_m FROM d, q WHERE m <= 1.6 * mid")
def range_gate(v: Views) -> DataFrame:
    return rounded(cloud.range_gate(v.cloud, v.cameras).select("seq", "camera_m"))


_KNN = """+ d AS (SELECT a.id, b.id AS other, sqrt((a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n) + (a.u - b.u) * (a.u - b.u)) AS d, b.u FROM parts a JOIN parts b ON a.id <> b.id),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other)::INT AS rank FROM d)"""


@query(_KNN + " SELECT id, rank, other, round(d, 6) AS d FROM k WHERE rank <= 5")
def knn_topk(v: Views) -> DataFrame:
    p = v.parts
    return rounded(cloud.nearest(p, p, 5, same=True).select("id", "rank", "other", "d"))


@query(_KNN + ", m AS (SELECT id, avg(d) AS m FROM k WHERE rank <= 12 GROUP BY id), s AS (SELECT avg(m) + 2 * stddev_pop(m) AS bound FROM m) SELECT id, round(m, 6) AS mean_m, m <= bound AS keep FROM m, s")
def sigma_outliers(v: Views) -> DataFrame:
    return rounded(cloud.sigma_outliers(v.parts))


@query(_KNN + ", m AS (SELECT id, median(u) AS m FROM k WHERE rank <= 24 GROUP BY id), r AS (SELECT p.id, abs(p.u - m.m) AS r FROM parts p JOIN m USING (id)), s AS (SELECT greatest(3, 6 * median(r)) AS bound FROM r) SELECT id, round(r, 6) AS residual_m, r <= bound AS keep FROM r, s")
def height_residual(v: Views) -> DataFrame:
    return rounded(cloud.height_residual(v.parts))


@query("+ d AS (SELECT c.id, s.id AS other, sqrt(pow(c.e - s.e, 2) + pow(c.n - s.n, 2) + pow(c.u - s.u, 2)) AS d FROM customers c, suppliers s) SELECT id, other, round(d, 6) AS d FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, other) = 1")
def nearest_attribute(v: Views) -> DataFrame:
    return rounded(cloud.nearest(v.customers, v.suppliers, 1).select("id", "other", "d"))


@query("SELECT c.id, c.source FROM customers c WHERE EXISTS (SELECT 1 FROM suppliers s WHERE sqrt(pow(c.e - s.e, 2) + pow(c.n - s.n, 2) + pow(c.u - s.u, 2)) < 4.0)")
def radius_semijoin(v: Views) -> DataFrame:
    return cloud.agreeing(v.suppliers, v.customers, 4.0).select("id", "source")


_PAIRS = "+ d AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.e - b.e, 2) + pow(a.n - b.n, 2) + pow(a.u - b.u, 2)), b.id) AS k FROM suppliers a JOIN suppliers b ON a.id <> b.id)"


@query(_PAIRS + " SELECT least(id, other) AS i, greatest(id, other) AS j FROM d WHERE k <= 6 UNION SELECT a.id, b.id FROM suppliers a JOIN suppliers b ON b.id > a.id AND b.id <= a.id + 4")
def candidate_pairs(v: Views) -> DataFrame:
    s = v.suppliers
    return matching.candidate_pairs(s, cloud.nearest(s, s, 6, same=True))


@query(
    """+ x AS (SELECT label AS img, vec_id AS kp, embedding::DOUBLE[] AS v FROM embeddings), d AS (SELECT a.img AS i, b.img AS j, a.kp AS ka, b.kp AS kb, list_distance(a.v, b.v) AS d FROM x a JOIN x b ON a.img < b.img),
    r AS (SELECT *, row_number() OVER (PARTITION BY i, j, ka ORDER BY d, kb) AS ra, lead(d) OVER (PARTITION BY i, j, ka ORDER BY d, kb) AS sa, row_number() OVER (PARTITION BY i, j, kb ORDER BY d, ka) AS rb, lead(d) OVER (PARTITION BY i, j, kb ORDER BY d, ka) AS sb FROM d)
    SELECT i, j, ka, kb, round(d, 6) AS d FROM r WHERE ra = 1 AND rb = 1 AND d < 0.95 * sa AND d < 0.95 * sb"""
)
def mutual_ratio_match(v: Views) -> DataFrame:
    d = v.table("embeddings").select(F.col("label").alias("img"), F.col("vec_id").alias("kp"), F.col("embedding").alias("desc"))
    i = d.select("img").distinct()
    pairs = i.select(F.col("img").alias("i")).join(i.select(F.col("img").alias("j")), F.col("i") < F.col("j"))
    return rounded(matching.mutual_matches(d, pairs, 0.95, 1))


# rasters and meshes

_GRID = "+ g AS (SELECT floor(e / 4.0)::BIGINT AS ix, floor(n / 4.0)::BIGINT AS iy, median(u) AS h, median(r) AS r, median(g) AS g, median(b) AS b, count(*)::BIGINT AS points FROM cloud GROUP BY ALL), q AS (SELECT count(*) FILTER (WHERE points >= 2) >= 0.6 * count(*) AS need FROM g)"


@query(_GRID + " SELECT ix, iy, round(h, 6) AS h, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, points FROM g, q WHERE points >= 2 OR NOT need")
def grid_median(v: Views) -> DataFrame:
    return rounded(mesh.supported(mesh.raster(v.cloud, 4.0)))


@query(
    _GRID + """, s AS (SELECT a.ix, a.iy, a.h AS h0, b.h AS h1, c.h AS h2, d.h AS h3 FROM g a JOIN g b ON b.ix = a.ix AND b.iy = a.iy + 1 JOIN g c ON c.ix = a.ix + 1 AND c.iy = a.iy JOIN g d ON d.ix = a.ix + 1 AND d.iy = a.iy + 1),
    f AS (SELECT ix, iy, 0 AS half, greatest(h0, h2, h3) - least(h0, h2, h3) AS x FROM s UNION ALL SELECT ix, iy, 1, greatest(h0, h3, h1) - least(h0, h3, h1) FROM s) SELECT ix, iy, half, round(x, 6) AS stretch FROM f WHERE x <= 20"""
)
def grid_faces(v: Views) -> DataFrame:
    return rounded(mesh.grid_faces(mesh.raster(v.cloud, 4.0), 4.0))


_EDGE = "+ x AS (SELECT fid, seen, least(a, b) AS i, greatest(a, b) AS j FROM mesh UNION ALL SELECT fid, seen, least(b, c), greatest(b, c) FROM mesh UNION ALL SELECT fid, seen, least(a, c), greatest(a, c) FROM mesh), g AS (SELECT i, j, count(*) AS n, count(*) FILTER (WHERE seen > 0) AS s, min(fid) AS fa, max(fid) AS fb FROM x GROUP BY i, j)"


@query(_EDGE + " SELECT i, j, kind FROM (SELECT i, j, CASE WHEN n = 2 AND s = 1 THEN 'occlusion' WHEN n = 1 THEN 'boundary' END AS kind FROM g) WHERE kind IS NOT NULL ORDER BY kind DESC, i, j LIMIT 2000")
def faultline_edges(v: Views) -> DataFrame:
    return mesh.faultlines(v.mesh)


@query(
    _EDGE + """, e AS (SELECT fa AS a, fb AS b FROM g WHERE n = 2 AND s = 0 UNION SELECT fb, fa FROM g WHERE n = 2 AND s = 0), c(node, comp) AS (SELECT fid, fid FROM mesh WHERE seen = 0 UNION SELECT e.b, c.comp FROM c JOIN e ON e.a = c.node),
    m AS (SELECT node, min(comp) AS first_face FROM c GROUP BY node), z AS (SELECT first_face, count(*)::BIGINT AS faces FROM m GROUP BY first_face) SELECT (row_number() OVER (ORDER BY faces DESC, first_face) - 1)::BIGINT AS patch, faces, first_face FROM z"""
)
def unseen_patches(v: Views) -> DataFrame:
    return mesh.unseen_patches(v.mesh)


@query(
    """+ p AS (SELECT l.seq, c.cam, c.u - l.u AS depth, 40 * (l.e - c.e) / (c.u - l.u) + 32 AS px, 40 * (c.n - l.n) / (c.u - l.u) + 24 AS py FROM (SELECT DISTINCT seq, e, n, u FROM cloud) l, cameras c WHERE c.u - l.u > 0.5),
    q AS (SELECT seq, cam, depth, floor(px * 8 / 64)::BIGINT AS bx, floor(py * 8 / 48)::BIGINT AS byy FROM p WHERE px >= 0 AND px < 64 AND py >= 0 AND py < 48), f AS (SELECT cam, bx, byy, min(depth) AS near FROM q GROUP BY ALL),
    s AS (SELECT seq, count(DISTINCT cam) AS seen FROM q JOIN f USING (cam, bx, byy) WHERE depth <= near * 1.03 + 0.4 GROUP BY seq) SELECT seen::BIGINT AS seen, count(*)::BIGINT AS faces FROM (SELECT coalesce(seen, 0) AS seen FROM (SELECT DISTINCT seq FROM cloud) LEFT JOIN s USING (seq)) GROUP BY seen"""
)
def zbuffer_visible(v: Views) -> DataFrame:
    c = v.cloud.select(F.col("seq").alias("fid"), "e", "n", "u").distinct()
    return mesh.visible_counts(c, v.cameras, 64, 48, 40.0).groupBy("seen").agg(F.count(F.lit(1)).alias("faces"))


@query("SELECT c.seq AS id, list_sort(list(DISTINCT b.tag))::VARCHAR AS tags FROM (SELECT DISTINCT seq, e, n, u FROM cloud) c JOIN boxes b ON e BETWEEN min_e AND max_e AND n BETWEEN min_n AND max_n AND u BETWEEN min_u - 0.5 AND max_u + 0.5 GROUP BY c.seq")
def point_in_box(v: Views) -> DataFrame:
    got = mesh.points_in_boxes(v.cloud.select(F.col("seq").alias("id"), "e", "n", "u").distinct(), v.boxes)
    return got.select("id", F.concat(F.lit("["), F.array_join("tags", ", "), F.lit("]")).alias("tags"))


@query(
    """+ u AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), c(node, comp) USING KEY (node) AS (SELECT DISTINCT a, a FROM u UNION
        (SELECT u.b, min(c.comp) FROM c JOIN u ON u.a = c.node JOIN recurring.c o ON o.node = u.b WHERE c.comp < o.comp GROUP BY u.b)) SELECT node, comp FROM c"""
)
def connected_components(v: Views) -> DataFrame:
    return graph.components(v.edges)


# frames

_SCORE = "0.35 * least(sharpness / 120, 1) + 0.3 * least(features / 250, 1) + 0.15 * least(texture / 5, 1) + 0.1 * exposure + 0.1 * (1 - redundancy)"


@query(
    f"""+ g AS (SELECT idx, {_SCORE} AS score, sharpness < 18 AS x, exposure < 0.18 AS y, redundancy > 0.992 AS z FROM frames), r AS (SELECT *, count(*) FILTER (WHERE NOT (x OR y OR z)) OVER (ORDER BY idx) AS k FROM g)
    SELECT idx, round(score, 6) AS score, concat_ws(',', CASE WHEN x THEN 'motion_blur' END, CASE WHEN y THEN 'illumination' END, CASE WHEN z THEN 'redundant' END) AS reasons, NOT (x OR y OR z) AND k <= 90 AS keep FROM r"""
)
def frame_gate(v: Views) -> DataFrame:
    f = v.frames.withColumn("score", scores.frame_score(*map(F.col, ("sharpness", "features", "texture", "exposure", "redundancy"))))
    return rounded(frames.gate(f).withColumn("reasons", F.array_join("reasons", ",")))


_RN = "+ p AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS rn, count(*) OVER () AS total FROM frames)"


@query(_RN + " SELECT idx, floor(rn / ceil(total / 9))::BIGINT AS chunk FROM p")
def equal_chunks(v: Views) -> DataFrame:
    return frames.equal_chunks(v.frames, "idx", 9).select("idx", "chunk")


@query(_RN + ", w AS (SELECT idx, total, (rn // 3)::BIGINT AS x FROM p UNION ALL SELECT idx, total, (rn // 3 - 1)::BIGINT FROM p WHERE rn % 3 = 0 AND rn > 0) SELECT idx, x AS \"window\" FROM w WHERE x * 3 + 1 < total")
def overlap_windows(v: Views) -> DataFrame:
    return frames.overlapping(v.frames, "idx", 4).select("idx", "window")


@query(_RN + " SELECT idx, rn::BIGINT AS rn FROM p WHERE rn IN (SELECT round_even(i * (total - 1) / 59, 0)::BIGINT FROM (SELECT unnest(range(60)) AS i), (SELECT max(total) AS total FROM p))")
def even_thinning(v: Views) -> DataFrame:
    return frames.thin(v.frames, "idx", 60).select("idx", "rn")


# contracts, logs, fits


@query(
    """SELECT 'duplicate_sample' AS rule, sample_id::VARCHAR AS subject FROM samples GROUP BY sample_id HAVING count(*) > 1 UNION ALL SELECT 'unknown_license', sample_id::VARCHAR FROM samples WHERE license IS NULL OR license = 'unknown'
    UNION ALL SELECT 'unknown_split', sample_id::VARCHAR FROM splits WHERE split NOT IN ('train', 'val', 'test') UNION ALL SELECT DISTINCT 'unknown_sample', sample_id::VARCHAR FROM splits WHERE sample_id NOT IN (SELECT sample_id FROM samples)
    UNION ALL SELECT DISTINCT 'unassigned_sample', sample_id::VARCHAR FROM samples WHERE sample_id NOT IN (SELECT sample_id FROM splits) UNION ALL SELECT 'sample_in_two_splits', sample_id::VARCHAR FROM splits GROUP BY sample_id HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'scene_in_two_splits', scene_id FROM samples JOIN splits USING (sample_id) GROUP BY scene_id HAVING count(DISTINCT split) > 1"""
)
def manifest_violations(v: Views) -> DataFrame:
    return contracts.manifest_violations(v.samples, v.splits)


@query(
    """SELECT job, count(*)::BIGINT AS events, max(seq) AS last_seq, max_by(value, seq) FILTER (WHERE type = 'status') AS last_status, max_by(value, seq) FILTER (WHERE type = 'stage') AS last_stage, max_by(value, seq) FILTER (WHERE type = 'done') AS last_done,
    max_by(value, seq) FILTER (WHERE type = 'error') AS last_error, coalesce(max_by(progress, seq) FILTER (WHERE progress > 0), 0)::INT AS progress, bool_or(type IN ('done', 'error')) AS ended FROM log GROUP BY job"""
)
def job_snapshot_fold(v: Views) -> DataFrame:
    return contracts.fold_jobs(v.log)


@query("+ r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq) AS i FROM log), g AS (SELECT *, i - row_number() OVER (PARTITION BY job ORDER BY seq) AS g FROM r WHERE type = 'error') SELECT job, min(seq) AS first_seq, max(seq) AS last_seq, count(*)::BIGINT AS events FROM g GROUP BY job, g")
def unseen_runs(v: Views) -> DataFrame:
    return contracts.runs(v.log.withColumn("bad", F.col("type") == "error"), "bad")


@query(
    """SELECT p_partkey, round(CASE p_size % 3 WHEN 0 THEN least(greatest(p_size::DOUBLE, 4), 140) WHEN 1 THEN least(greatest((p_size % 10) * 3.1, 4), 140)
    ELSE CASE WHEN split_part(p_type, ' ', 1) IN ('LARGE', 'PROMO') THEN 16 ELSE 9 END END, 6)::DOUBLE AS h FROM part"""
)
def building_height(v: Views) -> DataFrame:
    size, kind = F.col("p_size"), F.split("p_type", " ")[0]
    height = F.when(size % 3 == 0, F.concat(size.cast("string"), F.lit(" m"))).when(size % 3 == 1, "tall").when(size % 2 == 0, "unknown m")
    levels = F.when(size % 3 < 2, F.concat((size % 10).cast("string"), F.lit(";x"))).when(size % 4 < 2, "x;2")
    return rounded(v.table("part").select("p_partkey", scores.building_height(height, levels, kind, ("LARGE", "PROMO")).alias("h")))


_NINE = [(a, b) for a in "xyz" for b in "xyz"]


@query(f"+ q AS ({PAIRS}) SELECT count(*)::BIGINT AS n, round(var_pop(px) + var_pop(py) + var_pop(pz), 4) AS var, " + ", ".join(f"round(covar_pop(p{a}, q{b}), 4) AS c{a}{b}" for a, b in _NINE) + ", round(avg(qx), 4) AS mqx FROM q")
def umeyama_moments(v: Views) -> DataFrame:
    m = matching.similarity_moments(_pairs(v))
    return rounded(m.select("n", "var", *[f"c{a}{b}" for a, b in _NINE], "mqx"), 4)


# the pairs are an exact similarity in which each target axis follows one source axis: slopes and means tell it
@query(
    f"""+ q AS ({PAIRS}), k AS (SELECT sqrt((var_pop(qx) + var_pop(qy) + var_pop(qz)) / (var_pop(px) + var_pop(py) + var_pop(pz))) AS s, regr_slope(qx, py) AS xy, regr_slope(qy, px) AS yx, regr_slope(qz, pz) AS zz,
        avg(px) AS mx, avg(py) AS my, avg(pz) AS mz, avg(qx) AS nx, avg(qy) AS ny, avg(qz) AS nz FROM q), x AS (SELECT regr_slope(qx - k.xy * py, px) AS xx FROM q, k)
    SELECT round(s, 6) + 0.0 AS scale, round(xx / s, 6) + 0.0 AS xx, round(xy / s, 6) + 0.0 AS xy, round(yx / s, 6) + 0.0 AS yx, round(zz / s, 6) + 0.0 AS zz, round(nx - xy * my, 6) + 0.0 AS tx, round(ny - yx * mx, 6) + 0.0 AS ty, round(nz - zz * mz, 6) + 0.0 AS tz FROM k, x"""
)
def umeyama_fit(v: Views) -> DataFrame:
    f = matching.fit_similarity(matching.similarity_moments(_pairs(v)))
    near = lambda c: (F.round(c, 6) + 0.0)
    r, t = F.col("rotation"), F.col("translation")
    return f.select(near("scale").alias("scale"), near(r[0]).alias("xx"), near(r[1]).alias("xy"), near(r[3]).alias("yx"), near(r[8]).alias("zz"), near(t[0]).alias("tx"), near(t[1]).alias("ty"), near(t[2]).alias("tz"))


def _pairs(v: Views) -> DataFrame:
    return v.spark.sql(PAIRS.replace("FROM cloud", "FROM {cloud}"), cloud=v.cloud)


# the other half registers itself here
from . import scene_queries  # noqa: E402, F401
