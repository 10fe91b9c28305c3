"""Dataset contracts and folds over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def manifest_violations(samples: DataFrame, splits: DataFrame) -> DataFrame:
    """(rule, subject): no samples at all, repeated and unassigned samples, unknown licences and splits,
    samples that are in several splits or in none of the manifest, scenes in several splits."""
    s, p = samples.select("sample_id", "scene_id", "license"), splits.select("split", "sample_id")
    row = lambda df, rule, col: df.select(F.lit(rule).alias("rule"), F.col(col).cast("string").alias("subject"))
    nothing = s.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("no_samples").alias("rule"), F.lit(None).cast("string").alias("subject"))
    found = [
        nothing,
        row(s.groupBy("sample_id").count().where("count > 1"), "duplicate_sample", "sample_id"),
        row(s.where("license is null or license = 'unknown'"), "unknown_license", "sample_id"),
        row(p.where(~F.coalesce(F.col("split").isin("train", "val", "test"), F.lit(False))), "unknown_split", "sample_id"),
        row(p.join(s, "sample_id", "left_anti").distinct(), "unknown_sample", "sample_id"),
        row(s.join(p, "sample_id", "left_anti").distinct(), "unassigned_sample", "sample_id"),
        row(p.groupBy("sample_id").agg(F.countDistinct("split").alias("n")).where("n > 1"), "sample_in_two_splits", "sample_id"),
        row(s.join(p, "sample_id").groupBy("scene_id").agg(F.countDistinct("split").alias("n")).where("n > 1"), "scene_in_two_splits", "scene_id"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _named(df: DataFrame, subject: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, subject) of each row that breaks a rule: one row a broken rule, in one pass."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(subject).cast("string").alias("subject"))


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c) == "", F.lit(True))


def sample_violations(samples: DataFrame) -> DataFrame:
    """(rule, subject) of training samples that break a rule: ids, at least one frame, four arrays of one
    length, an origin (a map) of lat, lon and alt alone, and the paths of geometry and visibility."""
    arrays = ("frame_paths", "timestamps_s", "camera_poses_w2c", "intrinsics")
    sizes = [F.coalesce(F.size(c), F.lit(0)) for c in arrays]
    keys = F.array_sort(F.map_keys("origin"))
    return _named(
        samples,
        "sample_id",
        {
            "ids_missing": _blank("sample_id") | _blank("scene_id"),
            "no_frames": sizes[0] <= 0,
            "lengths_differ": (F.greatest(*sizes) != F.least(*sizes)),
            "origin_keys": ~F.coalesce(keys == F.array(F.lit("alt"), F.lit("lat"), F.lit("lon")), F.lit(False)),
            "paths_missing": _blank("visible_geometry_path") | _blank("visibility_path"),
        },
    )


STATES = ("proposed", "accepted", "rejected")


def proposal_violations(proposals: DataFrame) -> DataFrame:
    """(rule, subject) of completion proposals that break a rule. A proposal is made up, so it is never safe
    to measure."""
    return _named(
        proposals,
        "proposal_id",
        {
            "ids_missing": _blank("proposal_id") | _blank("scene_revision"),
            "negative_patch": F.col("patch_id") < 0,
            "unknown_state": ~F.col("state").isin(*STATES),
            "uncertainty_range": ~F.coalesce(F.col("uncertainty").between(0.0, 1.0), F.lit(False)) | F.isnan("uncertainty"),
            "measurement_safe": F.col("measurement_safe"),
        },
    )


def scene_violations(scenes: DataFrame) -> DataFrame:
    """(rule, subject) of scene manifests (scene_id and the manifest's columns): the measured cloud is the
    authority, and nothing generated is ever part of what is measured."""
    return _named(
        scenes,
        "scene_id",
        {
            "cloud_not_authoritative": ~F.col("reconstruction.measurement_authoritative"),
            "mesh_authoritative": F.col("mesh.measurement_authoritative"),
            "generated_in_spatial": F.col("spatial.generated_geometry_allowed"),
            "generated_measured": F.col("measurement.generated_geometry_included"),
            "source_not_cloud": F.col("measurement.source") != "metric_cloud",
        },
    )


SAMPLE = """sample_id string, scene_id string, frame_paths array<string>, timestamps_s array<double>, camera_poses_w2c array<array<double>>,
    intrinsics array<array<double>>, origin map<string, double>, visible_geometry_path string, visibility_path string, target_view_paths array<string>,
    target_geometry_path string, patch_targets_path string, view_targets_path string, license_name string, license_url string, source_url string, metadata map<string, string>"""


def coerced_samples(texts: DataFrame, column: str = "value") -> DataFrame:
    """Samples from JSON texts, with defaults for what is missing; texts that are no JSON objects have null
    ids and so break the rules. Empty optional paths are null, and no license is "unknown"."""
    d = texts.select(F.from_json(column, SAMPLE, {"mode": "PERMISSIVE"}).alias("s")).select("s.*")
    empty = {"array<string>": F.array().cast("array<string>"), "array<double>": F.array().cast("array<double>"), "array<array<double>>": F.array().cast("array<array<double>>")}
    out = []
    for f in d.schema:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        if kind in empty:
            c = F.coalesce(c, empty[kind])
        elif f.name == "license_name":
            c = F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
        elif f.name == "metadata":
            c = F.coalesce(c, F.create_map().cast("map<string,string>"))
        elif f.name == "origin":
            c = F.map_filter(c, lambda k, v: k.isin("lat", "lon", "alt") & v.isNotNull())
        elif f.name in ("sample_id", "scene_id", "visible_geometry_path", "visibility_path"):
            c = F.coalesce(c, F.lit(""))
        elif kind == "string":
            c = F.nullif(c, F.lit(""))
        out.append(c.alias(f.name))
    return d.select(*out)


def camera_features(samples: DataFrame) -> DataFrame:
    """(sample_id, view, features): the 16 numbers of each frame's pose and the 9 of its intrinsics."""
    d = samples.select("sample_id", F.posexplode(F.arrays_zip("camera_poses_w2c", "intrinsics")).alias("view", "z"))
    return d.select("sample_id", "view", F.concat(F.slice("z.camera_poses_w2c", 1, 16), F.slice("z.intrinsics", 1, 9)).alias("features"))


def scene_split(scene: Column) -> Column:
    """Of every ten scenes one is for tests, one for validation, and the rest for training; all frames of a
    scene go together."""
    return F.when(F.pmod(scene, F.lit(10)) == 0, "test").when(F.pmod(scene, F.lit(10)) == 1, "val").otherwise("train")


CHALLENGES = (
    ("angles", "sparse"),
    ("blur", "blur_dropped"),
    ("illum", "illumination"),
    ("dynamic", "dynamic"),
    ("gps", "gps_downweighted"),
    ("realtime", "near_rt"),
    ("occlude", "occlusions"),
    ("metric", "metric"),
)


def challenges(state: DataFrame, *keys: str) -> DataFrame:
    """(keys, place, id, active): the eight conditions of a run, from columns that are flags or counts."""
    each = F.posexplode(F.array(*[F.struct(F.lit(name).alias("id"), (F.coalesce(F.col(c).cast("int"), F.lit(0)) > 0).alias("active")) for name, c in CHALLENGES]))
    return state.select(*keys, each.alias("place", "c")).select(*keys, "place", "c.id", "c.active")


def progress(start: int, end: int, done: Column, total: Column) -> Column:
    """Whole percent of a job while one stage, which lies between start and end, is at done of total."""
    return (start + (end - start) * done / F.greatest(total, F.lit(1))).cast("int")


RESERVED = ("type", "stage", "status", "label", "progress", "message")


def safe_stats(stats: Column) -> Column:
    """A map of statistics without null values and without the keys that an event has itself."""
    return F.map_filter(stats, lambda k, v: v.isNotNull() & ~k.isin(*RESERVED))


def skipped_stage(scenes: DataFrame) -> DataFrame:
    """The row that the optional completion stage leaves: skipped, without proposals, nothing safe to measure.
    scenes: scene_id, has_scene, has_spatial and the reason of the adapter."""
    reason = F.when(~F.col("has_scene"), "scene manifest missing").when(~F.col("has_spatial"), "spatial map missing").otherwise(F.col("reason"))
    return scenes.select("scene_id", F.lit("skipped").alias("status"), reason.alias("reason"), F.lit(0).cast("long").alias("proposals"), F.lit(False).alias("measurement_safe"))


def fold_jobs(log: DataFrame) -> DataFrame:
    """One row a job from its events (job, seq, type, value): how many, the last of each type, the last
    positive progress. Aggregations only, combined before the shuffle."""
    last = lambda t: F.max_by("value", F.when(F.col("type") == t, F.col("seq"))).alias(f"last_{t}")
    progress = F.max_by("progress", F.when(F.coalesce("progress", F.lit(0)) > 0, F.col("seq")))
    return log.groupBy("job").agg(F.count(F.lit(1)).alias("events"), F.max("seq").alias("last_seq"), last("status"), last("stage"), last("done"), last("error"), F.coalesce(progress, F.lit(0)).alias("progress"), F.bool_or(F.col("type").isin("done", "error")).alias("ended"))


def snapshot(log: DataFrame) -> DataFrame:
    """What a dashboard shows of each job, from its events (job, seq, type, message, progress, stage, label,
    status, payload): the fold of all events in order, as aggregations combined before the shuffle.

    message: the last that is not empty, of status, done and error events, or made of a stage's label and
    status. progress: the last that is not 0, 100 after done. stages: the last status of each, where running
    ones have failed if the job has. meta, stats: the payload of the last such event. poses: payloads of pose
    events in order, bounded by a flight's length. status: done or error, if such an event came, else running."""
    t, when = F.col("type"), lambda ok: F.when(ok, F.col("seq"))
    filled = F.nullif(F.col("message"), F.lit(""))
    said = F.when(t == "stage", F.concat(F.coalesce("label", "stage"), F.lit(" - "), "status")).when(t.isin("status", "done", "error"), filled)
    moved = F.when(t == "done", F.lit(100)).when(t.isin("status", "stage", "chunk", "sparse", "dense") & (F.col("progress") != 0), F.col("progress"))
    d = log.withColumns({"__said": said, "__moved": moved})
    each = d.groupBy("job").agg(
        F.max_by("__said", when(F.col("__said").isNotNull())).alias("message"),
        F.coalesce(F.max_by("__moved", when(F.col("__moved").isNotNull())), F.lit(0)).alias("progress"),
        F.max_by("payload", when(t == "meta")).alias("meta"),
        F.max_by("payload", when((t == "stats") & F.col("payload").isNotNull())).alias("stats"),
        F.transform(F.array_sort(F.collect_list(F.when((t == "pose") & F.col("payload").isNotNull(), F.struct("seq", "payload")))), lambda x: x["payload"]).alias("poses"),
        F.count_if(t.isin("chunk", "sparse", "dense")).alias("point_events"),
        F.when(F.bool_or(t == "error"), "error").when(F.bool_or(t == "done"), "done").otherwise("running").alias("status"),
    )
    stages = d.where("type = 'stage'").groupBy("job", "stage").agg(F.max_by("status", "seq").alias("s"))
    stages = stages.join(each.select("job", F.col("status").alias("end")), "job").withColumn("s", F.when((F.col("end") == "error") & (F.col("s") == "running"), "failed").otherwise(F.col("s")))
    stages = stages.groupBy("job").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "s")))).alias("stages"))
    out = each.join(stages, "job", "left").withColumn("stages", F.coalesce("stages", F.create_map().cast("map<string,string>")))
    return out.withColumn("message", F.when(F.col("status") == "error", "Reconstruction failed").otherwise(F.coalesce("message", F.lit(""))))


def runs(log: DataFrame, on: str) -> DataFrame:
    """(job, first_seq, last_seq, events) of each unbroken run of events for which column on is true."""
    w = Window.partitionBy("job").orderBy("seq")
    d = log.withColumn("__i", F.row_number().over(w)).where(F.col(on)).withColumn("__g", F.col("__i") - F.row_number().over(w))
    return d.groupBy("job", "__g").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("events")).drop("__g")
