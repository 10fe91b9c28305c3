"""Tables written between steps of iterative plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors both see.

    Where that setting is empty (tests on one machine) a temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="scenespark-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = f"file://{_LOCAL[0]}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _hadoop(spark: SparkSession, path: str):
    """The folder and its file system, whatever the scheme: Spark's own readers go the same way."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def discard(*tables: DataFrame) -> None:
    """Deletes what `written` wrote; for tables that nothing still to be run reads."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        if path:
            p, fs = _hadoop(t.sparkSession, path)
            fs.delete(p, True)
