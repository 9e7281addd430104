"""Row keys, durable cuts and group streaming shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder

#: Names of the two 64-bit halves of a row key; unlikely to clash with a caller's columns.
KA, KB = "_sq_key_a", "_sq_key_b"

WORD = re.compile(r"[^\W_]+")


def work_folder(spark: SparkSession) -> str:
    """A folder for this application's intermediate tables in the shared one; it is removed when the driver ends."""
    sc = spark.sparkContext
    where = f"{shared_folder(spark)}/sparquill-{sc.applicationId}"
    if where not in _FOLDERS:
        _FOLDERS.add(where)
        atexit.register(remove, spark, where)
    return where


_FOLDERS: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):  # the driver's JVM may have ended before
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: its lineage ends there, and losing executors loses nothing."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sq_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote; nothing that is still to be computed may read it."""
    for t in tables:
        remove(t.sparkSession, t._sq_path)


#: Rows of keys that are broadcast at most; beyond it the join is left to a shuffle.
BROADCAST_ROWS = 200_000


def small_side(cutted: DataFrame) -> DataFrame:
    """A materialised table marked for broadcast if it has few rows, else as it is."""
    return F.broadcast(cutted) if cutted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else cutted


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add a 128-bit key of (id, text).

    It never is null, tells rows of one id but different texts apart, and is equal for rows repeated whole.
    """
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.withColumns({KA: F.xxhash64(i, t), KB: F.xxhash64(t, F.lit(7919), i)})


def select_in(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, key) and nothing else, whatever other columns there are. Ids keep their type."""
    return with_key(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text")


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def lists(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column out of its values and the lengths of its rows."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat, kind)).cast(pa.list_(kind))


def chunked(batches: Iterator[pa.RecordBatch], text_col: str, chars: int) -> Iterator[pa.RecordBatch]:
    """Regroup batches so that each holds about ``chars`` bytes of text, and one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start, lengths = 0, np.nan_to_num(np.asarray(pc.binary_length(batch.column(text_col)).to_numpy(zero_copy_only=False), float)).astype(np.int64)
        run = np.cumsum(lengths)
        while start < batch.num_rows:
            before = run[start - 1] if start else 0
            end = int(np.searchsorted(run, before + chars - size, side="left")) + 1
            end = min(max(end, start + 1), batch.num_rows)
            held.append(batch.slice(start, end - start))
            size += int(run[end - 1] - before)
            start = end
            if size >= chars:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(held) == 1:
        return held[0]
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if sum(b.num_rows for b in held) else held[0]


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Regroup a stream sorted by ``key`` so that no key is cut, with about ``rows`` rows at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = joined(held)
        keys = whole.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last:
            yield whole.slice(0, last)
        held, n = [whole.slice(last)], whole.num_rows - last
    if n:
        yield joined(held)


def bounds(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, with the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= _M1
        x ^= x >> np.uint64(27)
        x *= _M2
        x ^= x >> np.uint64(31)
    return x

