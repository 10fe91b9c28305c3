"""Line dedup: normalised lines are exploded as hashes, documents are counted per hash, lines over
the threshold are dropped and the rest reassembled by position."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import cut, frugal, join_hot, materialize, unused

_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: str, min_chars: int) -> bytes | None:
    """The hash of a line without white space at both ends and with A-Z as a-z; None if too short."""
    line = line.strip(_SPACE)
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest() if len(line) >= min_chars else None


def _explode(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in cut(whole, 1):
            at, keys = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text is not None and len(text) >= min_chars:
                    found = {line_key(x, min_chars) for x in text.split("\n") if len(x) >= min_chars} - {None}
                    keys += found
                    at += [i] * len(found)
            yield pa.record_batch({"doc_id": b.column(0).take(pa.array(at, pa.int64())), "key": pa.array(keys, pa.binary())})


def _reassemble(batches: Iterator[pa.RecordBatch], at: int, min_chars: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The last column has the keys to drop."""
    for whole in batches:
        for b in cut(whole, at):
            texts, lines, dropped = [], [], []
            for text, drop in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                text = text or ""
                lines.append(text.count("\n") + 1)
                n = 0
                if drop:
                    drop = set(drop)
                    every = text.split("\n")
                    kept = [x for x in every if len(x) < min_chars or line_key(x, min_chars) not in drop]
                    n = len(every) - len(kept)
                    text = "\n".join(kept)
                texts.append(text)
                dropped.append(n)
            columns = [b.column(i) if i != at else pa.array(texts, pa.string()) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with repeated lines taken out of the text, and columns n_lines (before) and n_dropped.

    A key of at least min_chars code points that at least min_docs documents hold loses all its
    lines but those in the largest id that holds it. Null or empty texts are one empty line and come
    back empty. Rows with a null id are not counted and keep all lines; rows that repeat an id count
    as one document. Ids may be of any type that has an order. Columns named n_lines or n_dropped
    are replaced; others, whatever their names, pass through.
    An empty table stays empty."""
    docs = docs.drop("n_lines", "n_dropped")
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    lines = materialize(held.mapInArrow(frugal(partial(_explode, min_chars=min_chars)), f"doc_id {kind}, key binary").distinct(), "lines")
    often = lines.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= min_docs)
    often = materialize(often.select("key", "keeper"), "often")
    own, drop = unused(docs, "__doc"), unused(docs, "__drop")
    drops = join_hot(lines, often, ["key"]).where("doc_id <> keeper").groupBy(F.col("doc_id").alias(own)).agg(F.collect_list("key").alias(drop))
    joined = docs.join(drops, docs[id_col] == drops[own], "left").drop(own)
    fields = [T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(frugal(partial(_reassemble, at=docs.columns.index(text_col), min_chars=min_chars, names=schema.names)), schema)
