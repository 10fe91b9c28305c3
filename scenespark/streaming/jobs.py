"""Streaming twins: replay and tail of an append-only event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cloud
from ..operators.contracts import fold_jobs
from ..plans.tables import discard, written

ENDS = ("done", "error")


def emit(events: DataFrame, path: str) -> None:
    """Appends events (job, seq, type, ...) to the log."""
    events.write.mode("append").parquet(path)


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """All events from the first one, then those that come after."""
    return spark.readStream.schema(schema).parquet(path)


def events_after(log: DataFrame, job, after: int) -> DataFrame:
    """A job's events from an offset on, in order: what a client that has seen `after` events still needs."""
    return log.where((F.col("job") == job) & (F.col("seq") >= after)).orderBy("seq")


def with_end(events: DataFrame) -> DataFrame:
    """(job, seq, data): events as the lines that are sent, and after one that ends its job an end marker."""
    fields = [c for c in events.columns if c != "job"]
    own = F.to_json(F.struct(*fields))
    sent = F.when(F.col("type").isin(*ENDS), F.array(own, F.lit('{"type":"end"}'))).otherwise(F.array(own))
    line: Column = F.concat(F.lit("data: "), F.col("d"), F.lit("\n\n"))
    return events.select("job", "seq", F.posexplode(sent).alias("part", "d")).select("job", "seq", "part", line.alias("data"))


def fold_stream(log: DataFrame, name: str, checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """The batch fold kept up to date, a row a job, as the table `name` in the driver's memory: for the jobs
    of a dashboard. For many jobs use `fold_into`."""
    w = fold_jobs(log).writeStream.outputMode("complete").format("memory").queryName(name)
    w = w.option("checkpointLocation", checkpoint) if checkpoint else w
    return (w.trigger(availableNow=True) if available_now else w).start()


def fold_into(log: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """The fold of each micro-batch's changed jobs, appended to a Parquet folder with the batch's number: the
    latest row of a job counts, and no batch brings all jobs anywhere. every: at most one batch in that
    time ("0.5 seconds"), which throttles progress; None: what is there, then stop."""

    def save(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)

    w = fold_jobs(log).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def latest(folded: DataFrame) -> DataFrame:
    """The newest row of each job of what `fold_into` wrote."""
    rest = [c for c in folded.columns if c not in ("job", "batch")]
    return folded.groupBy("job").agg(F.max_by(F.struct(*rest), F.struct("batch", "events")).alias("r")).select("job", "r.*")


def save_results(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The events that end a job well, appended to a folder of results, a row a job."""

    def save(batch: DataFrame, _: int) -> None:
        batch.where("type = 'done'").write.mode("append").parquet(path)

    return log.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


class Fusion:
    """Incremental voxel fusion, chunk by chunk: use `step` with foreachBatch. Its state is a written table;
    the one before is deleted when the next is there."""

    def __init__(self, voxel: float):
        self.voxel, self.fused = voxel, None
        self.stats: list[dict] = []

    def step(self, chunk: DataFrame, batch: int) -> None:
        if chunk.isEmpty():
            return
        after = written(cloud.fuse_onto(self.fused, chunk, self.voxel), "fused")
        if self.fused is not None:
            discard(self.fused)
        self.fused = after
        self.stats.append(cloud.band_counts(after).first().asDict() | {"batch": batch})
