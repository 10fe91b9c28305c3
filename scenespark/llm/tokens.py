"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._encoders import PieceCounter, encoder
from ._shared import cut, exists, frugal, join_hot, materialize, shared_dir

_CACHE = "digest string, version string, n_tokens long"


def version_of(path: str) -> str:
    """The tokenizer's version: a digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def _encode(batches: Iterator[pa.RecordBatch], path: str, version: str) -> Iterator[pa.RecordBatch]:
    counter = encoder(PieceCounter, path)
    for whole in batches:
        for b in cut(whole, 1, 2 << 20):
            counts = counter.count(b.column(1).to_pylist())
            yield pa.record_batch({"digest": b.column(0), "version": pa.array([version] * len(counts)), "n_tokens": pa.array(counts, pa.int64())})


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, cache_path: str | None = None) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row of docs.

    A text's normal form is its UTF-8 bytes, null as empty (any stronger folding would change
    counts); its digest with the tokenizer's version is looked up in the cache, a Parquet table at
    cache_path that may not exist yet. Only distinct texts that are not there are encoded, and
    their counts appended. Without cache_path the cache lasts for this call. A half-written append
    is invisible, and a repeated one harmless: counts are grouped by digest when read. Repeated rows
    and null ids give a row each; an empty table gives an empty table; other columns are ignored."""
    spark, version = docs.sparkSession, version_of(model_path)
    docs = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    docs = docs.withColumn("digest", F.sha2("__text", 256))
    rows = materialize(docs.select("__id", "digest", F.octet_length("__text").cast("long").alias("n_bytes")), "digests")
    distinct = docs.groupBy("digest").agg(F.first("__text").alias("__text"))
    path = cache_path or shared_dir(spark, "token-cache")
    if cache_path and exists(spark, path):
        known = spark.read.schema(_CACHE).parquet(path).where(F.col("version") == version).select("digest")
        distinct = distinct.join(known, "digest", "left_anti")
    fresh = distinct.mapInArrow(frugal(partial(_encode, path=model_path, version=version), tables=True), _CACHE)
    fresh.write.mode("append").parquet(path)
    cache = spark.read.schema(_CACHE).parquet(path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    out = join_hot(rows, cache, ["digest"])
    return out.select(F.col("__id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
