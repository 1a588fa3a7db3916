"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsframe.session import small_table, written_table

#: Text characters that Python code works on at once.
CHUNK_CHARS = 1_000_000


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: str = "text") -> Column:
    """With the id (null or not), what a row's verdict is told by."""
    return F.xxhash64(F.col(text).cast("string"))


def without(docs: DataFrame, bad: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text_key are not those of a row of
    ``bad`` (doc_id, key). A null id equals a null id. A bounded number of rows of
    ``bad`` is broadcast whatever its bytes, so the texts of ``docs`` stay where they are."""
    n_id, n_key = fresh("bad_id", docs), fresh("bad_key", docs)
    bad = written_table(bad.select("doc_id", "key").distinct().toDF(n_id, n_key), name)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(n_id)) & (text_key() == F.col(n_key))
    return docs.join(small_table(bad), same, "left_anti")


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker process, so that what a
    task has worked out serves the worker's later tasks as well. A worker keeps
    one such dict: those of other names, left by an earlier stage, are emptied."""
    return _caches(name).setdefault(name, {})


def _caches(own: str | None) -> dict[str, dict]:
    """The worker's caches, after those of other names than ``own`` are emptied."""
    home = sys.modules.setdefault("_newsframe_worker", types.ModuleType("_newsframe_worker"))
    caches = home.__dict__.setdefault("caches", {})
    if others := caches.keys() - {own}:
        for other in others:
            caches.pop(other).clear()
        release_memory()
    return caches


def release_memory() -> None:
    """Give back to the system what a task's batches and strings held: workers
    are used again, and each would keep the most that any stage took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):     # where the C library has it
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
           cache: str | None = None) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of the batches with bounded text, and their texts (None for null). A
    batch is cut by its texts' lengths before any of them becomes a Python string.
    Free memory goes back to the system after each batch. The worker keeps the
    cache of that name, and empties what other stages left."""
    _caches(cache)
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            full = (size[start - 1] if start else 0) + CHUNK_CHARS
            stop = max(start + 1, int(np.searchsorted(size, full, "right")))
            part = batch.slice(start, stop - start)
            yield part, part.column(text).to_pylist()
            start = stop
        del batch
        release_memory()
