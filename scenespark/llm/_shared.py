"""What the operators share: written tables, joins with hot keys, and batches cut by bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import discard, exists, shared_dir  # noqa: F401
from ..plans.tables import written as materialize
from . import _encoders, _text

#: A key is hot if it holds more than one of so many rows; so there are fewer hot keys than this.
HOT = 1_000

def usable_vector(col: str, zero_ok: bool) -> Column:
    """True for an array without null, NaN or infinite components (and, if asked, not all zero)."""
    c = F.col(col)
    ok = c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if not zero_ok:
        ok = ok & F.exists(c, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def cut(batch: pa.RecordBatch, col: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about most_bytes of text in column col; a longer text stands alone."""
    texts = batch.column(col)
    start = size = 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > most_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Gives memory that a worker no longer uses back to the machine: workers outlive their tasks, and
    what one stage leaves in them counts against the next."""
    _text.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(f: Callable[[Iterator], Iterator], tables: bool = False) -> Callable[[Iterator], Iterator]:
    """f for mapInArrow or mapInPandas, whose task leaves no memory behind. Only stages that encode
    keep the tables of the encoders."""
    return partial(_frugal, f, tables)


def _frugal(f: Callable[[Iterator], Iterator], tables: bool, batches: Iterator) -> Iterator:
    if not tables:
        _encoders.forget()
    try:
        yield from f(batches)
    finally:
        release()


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with table, which has one row a key. Keys with more than 1 / HOT of all rows (and more
    than HOT rows), of which there are less than HOT, are sent to all tasks, so that their rows stay where
    they are; the others meet in a merge join, in which no key is large. Both should be written
    tables: rows is read three times, table twice."""
    least = max(rows.count() // HOT, HOT)
    hot = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > least).select(*keys), "hot")
    near = rows.join(F.broadcast(table.join(F.broadcast(hot), keys)), keys)
    far = rows.join(F.broadcast(hot), keys, "left_anti").join(table.hint("merge"), keys)
    return near.unionByName(far)


def unused(df: DataFrame, name: str) -> str:
    """name, made longer until no column of df has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
