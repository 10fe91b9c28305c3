"""Frame gates, thinning and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import written


def gate(frames: DataFrame, least_sharp: float = 18, least_exposure: float = 0.18, most_redundant: float = 0.992, most: int = 90) -> DataFrame:
    """idx, score, reasons and keep: blurred, washed out and redundant frames go, and of the rest all but
    the first most, in order. The order is global but one running count: chunks of it are counted
    first and their sums added, so that no task holds all frames."""
    reasons = F.array_compact(F.array(F.when(F.col("sharpness") < least_sharp, "motion_blur"), F.when(F.col("exposure") < least_exposure, "illumination"), F.when(F.col("redundancy") > most_redundant, "redundant")))
    f = frames.select("idx", "score", reasons.alias("reasons"), F.floor(F.col("idx") / 4096).alias("__chunk")).withColumn("good", (F.size("reasons") == 0).cast("int"))
    before = f.groupBy("__chunk").agg(F.sum("good").alias("g")).select("__chunk", (F.sum("g").over(Window.orderBy("__chunk")) - F.col("g")).alias("__before"))
    run = F.sum("good").over(Window.partitionBy("__chunk").orderBy("idx")) + F.col("__before")
    return f.join(before, "__chunk").select("idx", "score", "reasons", ((F.col("good") == 1) & (run <= most)).alias("keep"))


def rescue(gated: DataFrame) -> DataFrame:
    """If no frame is kept, the one with the best score (the first of equals) is, and is not redundant."""
    best = gated.agg(F.coalesce(F.bool_or("keep"), F.lit(False)).alias("__any"), F.max_by("idx", F.struct("score", -F.col("idx"))).alias("__best"))
    d = gated.crossJoin(F.broadcast(best)).withColumn("__own", ~F.col("__any") & (F.col("idx") == F.col("__best")))
    reasons = F.when(F.col("__own"), F.array_remove("reasons", "redundant")).otherwise(F.col("reasons"))
    return d.select("idx", "score", reasons.alias("reasons"), (F.col("keep") | F.col("__own")).alias("keep"))


def counters(gated: DataFrame) -> DataFrame:
    """One row: frames scanned, kept, dropped for blur, and gated for light."""
    has = lambda r: F.count_if(F.array_contains("reasons", r))
    return gated.agg(F.count(F.lit(1)).alias("scanned"), F.count_if("keep").alias("kept"), has("motion_blur").alias("blur_dropped"), has("illumination").alias("illumination"))


def redundancy(frames: DataFrame, chunk: int = 4096) -> DataFrame:
    """idx and redundancy: the correlation of a frame's thumbnail (an array) with that of the frame before
    it, kept or not; 0 for the first, 1 where there is none (a flat one). Chunks of the order are
    tasks; the last thumbnail of a chunk is carried into the next."""
    d = frames.select("idx", F.col("thumb").cast("array<double>").alias("thumb"), F.floor(F.col("idx") / chunk).alias("c"))
    last = d.groupBy("c").agg(F.max_by("thumb", "idx").alias("m"))
    carried = last.select("c", F.lag("m").over(Window.orderBy("c")).alias("m"))
    d = d.join(carried, "c").withColumn("p", F.coalesce(F.lag("thumb").over(Window.partitionBy("c").orderBy("idx")), F.col("m")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    mean = lambda c: total(F.col(c)) / F.size(c)
    d = d.withColumns({"mx": mean("thumb"), "my": mean("p")})
    x, y = F.transform("thumb", lambda v: v - F.col("mx")), F.transform("p", lambda v: v - F.col("my"))
    times = lambda a, b: total(F.zip_with(a, b, lambda u, v: u * v))
    r = times(x, y) / F.nullif(F.sqrt(times(x, x) * times(y, y)), F.lit(0.0))
    return d.select("idx", F.when(F.col("p").isNull(), 0.0).otherwise(F.coalesce(F.nanvl(r, F.lit(1.0)), F.lit(1.0))).alias("redundancy"))


def pixel_scores(frames: DataFrame) -> DataFrame:
    """idx with sharpness (the variance of the Laplacian), texture (the entropy of 32 grey levels) and exposure
    (1 at a mean of 118, less away from it) of grey images (width, pixels: an array by rows)."""
    size, w = F.size("pixels"), F.col("width")
    at = lambda i: F.element_at("pixels", i + 1).cast("double")
    height = (size / w).cast("int")
    # beyond an edge the image goes on as in a mirror
    mirror = lambda k, n: F.when(n == 1, 0).when(k < 0, -k).when(k >= n, 2 * n - 2 - k).otherwise(k)

    def laplacian(i):
        y, x = F.floor(i / w).cast("int"), (i % w).cast("int")
        return at(y * w + mirror(x - 1, w)) + at(y * w + mirror(x + 1, w)) + at(mirror(y - 1, height) * w + x) + at(mirror(y + 1, height) * w + x) - 4 * at(i)

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    d = frames.where(size > 0).select("idx", "pixels", F.transform(F.sequence(F.lit(0), size - 1), laplacian).alias("l"))
    d = d.select("idx", "pixels", "l", (total(F.col("l")) / F.size("l")).alias("lm"), (total(F.transform("pixels", lambda v: v.cast("double"))) / F.size("pixels")).alias("pm"))
    share = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.size(F.filter("pixels", lambda v: F.floor(v / 8) == b)) / F.size("pixels"))
    entropy = total(F.transform(share, lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)))
    variance = total(F.transform("l", lambda v: (v - F.col("lm")) * (v - F.col("lm")))) / F.size("l")
    return d.select("idx", variance.alias("sharpness"), entropy.alias("texture"), (1 - F.least(F.abs(F.col("pm") - 118.0) / 118.0, F.lit(1.0))).alias("exposure"))


def sampled(frames: DataFrame, fps: float, target: float = 3.0) -> DataFrame:
    """Every so-manieth frame of a video, so that about target of them make a second."""
    return frames.where(F.col("idx") % max(round(fps / target), 1) == 0)


def every_nth(df: DataFrame, by: str, step: int) -> DataFrame:
    """The first row in the order of by, and every step-th after it."""
    return positions(df, by, 4096).where(F.col("rn") % step == 0)


def pose_of_chunk(chunks: DataFrame, telemetry: DataFrame, by: str) -> DataFrame:
    """Each chunk (index, total) with the telemetry row at its share of the way."""
    p = positions(telemetry, by, 4096)
    spots = p.select(F.col("total").alias("__t")).limit(1).crossJoin(chunks.select("index", F.col("total").alias("__n")))
    spots = spots.withColumn("rn", F.least(((F.col("index") + 1) / F.col("__n") * (F.col("__t") - 1)).cast("long"), F.col("__t") - 1)).select("index", "rn")
    return spots.join(p.drop("total"), "rn")


def chunks_by_value(df: DataFrame, by: str, tie: str, chunks: int, parts: int | None = None) -> DataFrame:
    """Chunks of ceil(n / chunks) rows in the order of any column (ties by another that does not repeat);
    the last may be short. The order is made by ranges of it, whose sizes are counted first."""
    parts = parts or df.sparkSession.sparkContext.defaultParallelism
    ordered = written(df.repartitionByRange(parts, by, tie).sortWithinPartitions(by, tie).withColumn("__part", F.spark_partition_id()), "ordered")
    sizes = ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("__m"))
    every = Window.orderBy("__part")
    sizes = sizes.select("__part", (F.sum("__m").over(every) - F.col("__m")).alias("__before"), F.sum("__m").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__n"))
    rn = F.row_number().over(Window.partitionBy("__part").orderBy(by, tie)) - 1 + F.col("__before")
    return ordered.join(sizes, "__part").withColumn("chunk", F.floor(rn / F.ceil(F.col("__n") / chunks)).cast("long")).drop("__part", "__before", "__n")


def positions(df: DataFrame, by: str, chunk: int) -> DataFrame:
    """rn (from 0) and total: the place of each row in the order of by, whole numbers that do not
    repeat, by counting chunks of it first."""
    d = df.withColumn("__c", F.floor(F.col(by) / chunk))
    sums = d.groupBy("__c").agg(F.count(F.lit(1)).alias("__m"))
    every = Window.orderBy("__c")
    sums = sums.select("__c", (F.sum("__m").over(every) - F.col("__m")).alias("__before"), F.sum("__m").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    place = F.row_number().over(Window.partitionBy("__c").orderBy(by)) - 1
    return d.withColumn("__p", place).join(sums, "__c").withColumn("rn", (F.col("__p") + F.col("__before")).cast("long")).drop("__c", "__p", "__before")


def equal_chunks(df: DataFrame, by: str, chunks: int) -> DataFrame:
    """Chunks of ceil(n / chunks) rows; the last may be short."""
    return positions(df, by, 4096).withColumn("chunk", F.floor(F.col("rn") / F.ceil(F.col("total") / chunks)).cast("long"))


def overlapping(df: DataFrame, by: str, size: int) -> DataFrame:
    """Windows of size rows, each beginning with the last row of the one before; none of one row."""
    p = positions(df, by, 4096)
    own = F.floor(F.col("rn") / (size - 1)).cast("long")
    starts = F.array_compact(F.array(own, F.when((F.col("rn") % (size - 1) == 0) & (F.col("rn") > 0), own - 1)))
    return p.withColumn("window", F.explode(starts)).where(F.col("window") * (size - 1) + 1 < F.col("total"))


def thin(df: DataFrame, by: str, most: int) -> DataFrame:
    """most rows evenly spaced in the order of by, first and last among them (halves to even)."""
    p = positions(df, by, 4096)
    slot = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    wanted = p.select("total").limit(1).select(slot.alias("i"), "total").select(F.rint(F.col("i") * (F.col("total") - 1) / (most - 1)).cast("long").alias("rn")).distinct()
    return p.join(F.broadcast(wanted), "rn", "left_semi") if most > 1 else p.where("rn = 0")
