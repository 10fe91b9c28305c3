"""Height rasters, grid meshes, edges and visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import written
from .cloud import finite, nearest
from .graph import components
from .quantiles import quantiles
from .route import centroids


def raster(points: DataFrame, cell: float) -> DataFrame:
    """Median height and colour, and the count, of each cell (ix, iy); rows without a finite position go."""
    points = points.where(finite("e", "n", "u"))
    key = [F.floor(F.col(a) / cell).cast("long").alias(k) for a, k in (("e", "ix"), ("n", "iy"))]
    return points.groupBy(*key).agg(F.median("u").alias("h"), *[F.median(c).alias(c) for c in "rgb"], F.count(F.lit(1)).alias("points"))


def supported(cells: DataFrame, share: float = 0.6) -> DataFrame:
    """Cells of at least two points if that many cells have them, else all."""
    rule = cells.agg((F.count_if(F.col("points") >= 2) >= share * F.count(F.lit(1))).alias("__need"))
    return cells.crossJoin(F.broadcast(rule)).where("points >= 2 or not __need").drop("__need")


def grid_faces(cells: DataFrame, cell: float) -> DataFrame:
    """Two triangles for each four neighbouring cells that are all there; those whose heights
    differ by more than max(5 cells, 3) are stretched and go. One aggregation by corner."""
    corners = F.explode(F.array(*[F.struct((F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy"), F.lit(2 * dx + dy).alias("k")) for dx in (0, 1) for dy in (0, 1)]))
    squares = cells.select(corners.alias("c"), "h").groupBy("c.ix", "c.iy").agg(*[F.max(F.when(F.col("c.k") == k, F.col("h"))).alias(f"h{k}") for k in range(4)])
    squares = squares.where("h0 is not null and h1 is not null and h2 is not null and h3 is not null")
    side = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.array("h0", "h2", "h3").alias("hs")), F.struct(F.lit(1).alias("half"), F.array("h0", "h3", "h1").alias("hs"))))
    faces = squares.select("ix", "iy", side.alias("f")).select("ix", "iy", "f.half", (F.array_max("f.hs") - F.array_min("f.hs")).alias("stretch"))
    return faces.where(F.col("stretch") <= max(5 * cell, 3.0))


def edges(faces: DataFrame) -> DataFrame:
    """(i, j, fid): the undirected edges of faces (fid, a, b, c)."""
    e = F.explode(F.array(*[F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j")) for x, y in (("a", "b"), ("b", "c"), ("a", "c"))]))
    return faces.select("*", e.alias("__e")).select("__e.i", "__e.j", *[c for c in faces.columns if c not in "abc"])


def faultlines(faces: DataFrame, most: int = 2000) -> DataFrame:
    """Edges of one face (boundary) or of two of which one is seen (occlusion), occlusions first."""
    g = edges(faces).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seen") > 0).alias("s"))
    kind = F.when((F.col("n") == 2) & (F.col("s") == 1), "occlusion").when(F.col("n") == 1, "boundary")
    return g.select("i", "j", kind.alias("kind")).where("kind is not null").orderBy(F.col("kind").desc(), "i", "j").limit(most)


def unseen_patches(faces: DataFrame) -> DataFrame:
    """patch (rank from 0 by size, then least face), size and least face of the components of unseen
    faces over edges that exactly two faces share, both unseen."""
    sizes = patch_members(faces).groupBy("first_face").agg(F.count(F.lit(1)).alias("faces"))
    return ranked_patches(sizes).select("patch", "faces", "first_face")


# fixed values: what a camera without intrinsics is taken to have
FOCAL, IMAGE = 800.0, (1280, 720)
#: Cameras, or boxes, that go to all tasks at once.
BLOCK = 10_000


def full_cameras(cameras: DataFrame) -> DataFrame:
    """cam, e, n, u, rotation (camera to world), fx, fy, cx, cy, width, height, the missing ones by default;
    cameras whose rotation has not nine numbers go. Columns other than cam, e, n, u and rotation may be
    left out."""
    has = lambda c, kind: F.col(c).cast(kind) if c in cameras.columns else F.lit(None).cast(kind)
    some = lambda x: F.when(x != 0, x)
    d = cameras.where(F.size("rotation") == 9)
    width, height, fx = F.coalesce(some(has("width", "int")), F.lit(IMAGE[0])), F.coalesce(some(has("height", "int")), F.lit(IMAGE[1])), F.coalesce(some(has("fx", "double")), F.lit(FOCAL))
    return d.select("cam", *[F.col(a).cast("double").alias(f"c{a}") for a in "enu"], "rotation", fx.alias("fx"), F.coalesce(some(has("fy", "double")), fx).alias("fy"), F.coalesce(has("cx", "double"), width / 2.0).alias("cx"), F.coalesce(has("cy", "double"), height / 2.0).alias("cy"), width.alias("width"), height.alias("height"))


def blocks_of(small: DataFrame, key: str, most: int = BLOCK) -> list[DataFrame]:
    """A small table in parts of about most rows, by the hash of a key: a stated set that meets all rows
    part by part, however large it is."""
    n = small.count()
    parts = -(-n // most)
    return [small] if parts <= 1 else [small.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def seen_counts(faces: DataFrame, cameras: DataFrame) -> DataFrame:
    """fid, seen: by how many cameras each face (fid, e, n, u and normal nx, ny, nz, as `centroids` gives
    them; without a normal any side counts) is seen. A camera sees what is more than 0.5 m in front of it,
    inside its image and turned toward it, and of each cell of an eighth of its image the nearest depth
    and what lies within 3 % and 0.4 m of it. Faces meet cameras in blocks that go to all tasks; the
    nearest depths are an aggregation, so a full cell is combined before it moves."""
    total = None
    turned = "nx" in faces.columns
    for block in blocks_of(full_cameras(cameras), "cam"):
        p = faces.join(F.broadcast(block), F.lit(True))
        d = [F.col(a) - F.col(f"c{a}") for a in "enu"]
        r = F.col("rotation")
        axis = lambda k: d[0] * r[k] + d[1] * r[3 + k] + d[2] * r[6 + k]
        p = p.withColumn("depth", axis(2)).where("depth > 0.5")
        if turned:
            size, away = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")), F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
            p = p.where((size > 1e-8) & (-(F.col("nx") * d[0] + F.col("ny") * d[1] + F.col("nz") * d[2]) / (size * away + 1e-9) > 0.25))
        p = p.withColumns({"px": F.col("fx") * axis(0) / F.col("depth") + F.col("cx"), "py": F.col("fy") * axis(1) / F.col("depth") + F.col("cy")})
        p = p.where((F.col("px") >= 0) & (F.col("px") < F.col("width")) & (F.col("py") >= 0) & (F.col("py") < F.col("height")))
        cell = lambda x, side: F.least(F.floor(F.col(x) * F.greatest(F.lit(8), F.floor(F.col(side) / 8)) / F.col(side)), F.greatest(F.lit(8), F.floor(F.col(side) / 8)) - 1).cast("long")
        p = p.select("fid", "cam", "depth", cell("px", "width").alias("bx"), cell("py", "height").alias("by"))
        front = p.groupBy("cam", "bx", "by").agg(F.min("depth").alias("near"))
        seen = p.join(front, ["cam", "bx", "by"]).where(F.col("depth") <= F.col("near") * 1.03 + 0.4).groupBy("fid").agg(F.countDistinct("cam").alias("seen"))
        total = seen if total is None else written(total, "seen").unionByName(seen).groupBy("fid").agg(F.sum("seen").alias("seen"))
    return faces.select("fid").join(total, "fid", "left").select("fid", F.coalesce("seen", F.lit(0)).cast("long").alias("seen"))


def visible_counts(centroids: DataFrame, cameras: DataFrame, width: int, height: int, focal: float) -> DataFrame:
    """fid, seen: how many cameras (cam, e, n, u) that look straight down see each face's centre."""
    down = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, -1, 0, 0, 0, -1)])
    full = cameras.select("cam", "e", "n", "u", down.alias("rotation"), F.lit(focal).alias("fx"), F.lit(width).alias("width"), F.lit(height).alias("height"))
    return seen_counts(centroids.select("fid", "e", "n", "u"), full)


def spatial_map(vertices: DataFrame, faces: DataFrame, cameras: DataFrame) -> dict[str, DataFrame]:
    """faces with seen and face_state, their patches, faultlines and one row of summary. An empty mesh gives
    empty tables and zeros."""
    seen = written(faces.join(seen_counts(centroids(vertices, faces), cameras), "fid", "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("long"))), "seen")
    state = seen.withColumn("face_state", F.when(F.col("seen") == 0, "unseen").otherwise("observed"))
    patches = written(patch_summary(vertices, seen), "patches")
    lines = written(faultline_segments(vertices, seen), "lines")
    return {"faces": state, "patches": patches, "faultlines": lines, "summary": spatial_summary(seen, patches, lines)}


def spatial_summary(faces: DataFrame, patches: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: faces, seen_faces, seen_fraction, largest_unseen_patch and faultlines."""
    f = faces.agg(F.count(F.lit(1)).alias("faces"), F.count_if(F.col("seen") > 0).alias("seen_faces"), F.coalesce(F.round(F.avg((F.col("seen") > 0).cast("double")), 4), F.lit(0.0)).alias("seen_fraction"))
    largest = patches.agg(F.coalesce(F.max("faces"), F.lit(0)).cast("long").alias("largest_unseen_patch"))
    return f.crossJoin(largest).crossJoin(lines.agg(F.count(F.lit(1)).alias("faultlines")))


def largest_unseen_patch(faces: DataFrame) -> DataFrame:
    return unseen_patches(faces).agg(F.coalesce(F.max("faces"), F.lit(0)).cast("long").alias("faces"))


def patch_members(faces: DataFrame) -> DataFrame:
    """(fid, first_face): the unseen faces with the least face of their patch."""
    shared = edges(faces).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seen") > 0).alias("s"), F.min("fid").alias("a"), F.max("fid").alias("b")).where("n = 2 and s = 0").select("a", "b")
    unseen = faces.where("seen = 0").select("fid")
    return unseen.join(components(shared).withColumnRenamed("node", "fid"), "fid", "left").select("fid", F.coalesce("comp", "fid").alias("first_face"))


def patch_summary(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """patch (rank from 0 by size, then least face), faces, first_face, bounds (min_x ... max_z), area_hint_m2,
    state and measurement_safe of each patch of unseen faces; `patch_members` lists the faces."""
    shape = centroids(vertices, faces.where("seen = 0").select("fid", "a", "b", "c")).join(patch_members(faces), "fid")
    half = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")) * 0.5
    bounds = [F.round(f(f"{k}_{a}"), 3).alias(f"{k}_{a}") for a in "xyz" for k, f in (("min", F.min), ("max", F.max))]
    g = shape.groupBy("first_face").agg(F.count(F.lit(1)).alias("faces"), *bounds, F.round(F.sum(half), 3).alias("area_hint_m2"))
    return ranked_patches(g).select("patch", "faces", "first_face", *[f"{k}_{a}" for a in "xyz" for k in ("min", "max")], "area_hint_m2", F.lit("unseen").alias("state"), F.lit(False).alias("measurement_safe"))


def ranked_patches(sizes: DataFrame) -> DataFrame:
    """patch: the place from 0 by size, then least face. Places are counted by size first (few sizes), then
    within one size, so that no task ranks all patches."""
    larger = sizes.groupBy("faces").agg(F.count(F.lit(1)).alias("__n")).select("faces", (F.sum("__n").over(Window.orderBy(F.desc("faces"))) - F.col("__n")).alias("__larger"))
    chunked = sizes.withColumn("__c", F.floor(F.col("first_face") / 65_536))
    own = chunked.groupBy("faces", "__c").agg(F.count(F.lit(1)).alias("__n")).select("faces", "__c", (F.sum("__n").over(Window.partitionBy("faces").orderBy("__c")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("faces", "__c").orderBy("first_face")) - 1
    return chunked.withColumn("__p", place).join(own, ["faces", "__c"]).join(larger, "faces").withColumn("patch", (F.col("__larger") + F.col("__before") + F.col("__p")).cast("long")).drop("__c", "__p", "__before", "__larger")


def faultline_segments(vertices: DataFrame, faces: DataFrame, most: int = 2000) -> DataFrame:
    """faultlines with the rounded ends (ax, ay, az, bx, by, bz) of each."""
    end = lambda k, p: vertices.select(F.col("vid").alias(k), *[F.round(a, 2).alias(f"{p}{a}") for a in "xyz"])
    return faultlines(faces, most).join(end("i", "a"), "i").join(end("j", "b"), "j").select("i", "j", "kind", *[f"{p}{a}" for p in "ab" for a in "xyz"])


def face_attributes(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """fid with the mean confidence of the three vertices (vid, conf, source, state), the source of the first
    and the state: generated if any vertex is. Nothing here is safe to measure."""
    v = lambda c: vertices.select(F.col("vid").alias(c), F.struct("conf", "source", "state").alias(f"v{c}"))
    d = faces.select("fid", "a", "b", "c")
    for c in "abc":
        d = d.join(v(c), c)
    made = (F.col("va.state") == "generated") | (F.col("vb.state") == "generated") | (F.col("vc.state") == "generated")
    return d.select("fid", F.round((F.col("va.conf") + F.col("vb.conf") + F.col("vc.conf")) / 3, 4).alias("face_confidence"), F.col("va.source").alias("face_source"), F.when(made, "generated").otherwise("observed").alias("face_state"), F.lit(False).alias("measurement_safe"))


def vertex_attributes(vertices: DataFrame, cloud: DataFrame) -> DataFrame:
    """vid, conf, source and state of the nearest point of the cloud (id, e, n, u, conf, source, synthetic);
    without a cloud, certain and observed."""
    near = nearest(vertices.select(F.col("vid").alias("id"), F.col("x").alias("e"), F.col("y").alias("n"), F.col("z").alias("u")), cloud, 1, squares=True).select(F.col("id").alias("vid"), "other")
    point = cloud.select(F.col("id").alias("other"), "conf", "source", F.when(F.col("synthetic"), "generated").otherwise("observed").alias("state"))
    return vertices.select("vid").join(near.join(point, "other"), "vid", "left").select("vid", F.coalesce("conf", F.lit(1.0)).alias("conf"), F.coalesce("source", F.lit("photogrammetry")).alias("source"), F.coalesce("state", F.lit("observed")).alias("state"))


def vertex_coverage(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vid and the share of its faces that were seen; 0 without faces."""
    corner = faces.select(F.explode(F.array("a", "b", "c")).alias("vid"), (F.col("seen") > 0).cast("double").alias("s"))
    return vertices.select("vid").join(corner.groupBy("vid").agg(F.avg("s").alias("coverage")), "vid", "left").select("vid", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def cell_means(points: DataFrame, cell: float = 1.4) -> DataFrame:
    """The plain grid: mean place and, cut to whole numbers, colour of each cell (ix, iy)."""
    key = [F.floor(F.col(a) / cell).cast("long").alias(k) for a, k in (("e", "ix"), ("n", "iy"))]
    return points.where(finite("e", "n", "u")).groupBy(*key).agg(*[F.avg(a).alias(a) for a in "enu"], *[F.avg(c).cast("int").alias(c) for c in "rgb"])


def grid_triangles(cells: DataFrame) -> DataFrame:
    """(ix, iy, half) of the plain grid's faces: a square of four cells gives two triangles, its lower left
    three alone give one."""
    corners = F.explode(F.array(*[F.struct((F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy"), F.lit(1 << (2 * dx + dy)).alias("bit")) for dx in (0, 1) for dy in (0, 1)]))
    held = cells.select(corners.alias("c")).groupBy("c.ix", "c.iy").agg(F.bit_or("c.bit").alias("m"))
    has = lambda bits: F.col("m").bitwiseAND(F.lit(bits)) == bits
    half = F.array_compact(F.array(F.when(has(0b0111), F.lit(0)), F.when(has(0b1111), F.lit(1))))
    return held.select("ix", "iy", F.explode(half).alias("half"))


def surface_cell(points: DataFrame, most_cells: int = 110_000) -> float:
    """The cell of a surface raster: 1.6 times the median, over points, of the mean distance over ground to
    the four nearest, between 0.2 and 6 m, and larger by quarters while there would be too many cells."""
    flat = points.select("id", "e", "n")
    near = nearest(flat, flat, 4, axes=("e", "n"), same=True).groupBy("id").agg(F.avg("d").alias("d"))
    (middle,) = quantiles(written(near.select("d"), "spacing"), [("d", 0.5)])
    cell = min(max(1.6 * (middle or 0.0), 0.2), 6.0)
    b = points.agg(*[(F.max(a) - F.min(a)).alias(a) for a in "en"]).first()
    side = [max(b[a] or 0.0, cell) for a in "en"]
    while (side[0] / cell + 1) * (side[1] / cell + 1) > most_cells:
        cell *= 1.25
    return cell


def points_in_boxes(points: DataFrame, boxes: DataFrame, slack: float = 0.5) -> DataFrame:
    """id and the sorted tags of the boxes (box, tag, min_e ... max_u) that hold the point, heights with
    some slack. Boxes meet all points in blocks that go to all tasks."""
    inside = (F.col("e").between(F.col("min_e"), F.col("max_e"))) & (F.col("n").between(F.col("min_n"), F.col("max_n"))) & (F.col("u").between(F.col("min_u") - slack, F.col("max_u") + slack))
    found = None
    for block in blocks_of(boxes, "box"):
        part = points.join(F.broadcast(block), inside).groupBy("id").agg(F.collect_set("tag").alias("tags"))
        found = part if found is None else written(found, "tags").unionByName(part)
    return found.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
