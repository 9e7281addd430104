"""An index as Parquet tables with a small description beside them."""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CODECS = {"raw": "none", "zlib": "gzip", "zstd": "zstd", "auto": "zstd"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, by ``spark.checkpoint.dir``. A temporary one is made only where that is unset on a single machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparquill-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


_FOLDERS: set[str] = set()


def work_folder(spark: SparkSession) -> str:
    """A folder for this application's intermediate tables in the shared one; it is removed when the driver ends."""
    where = f"{shared_folder(spark)}/sparquill-{spark.sparkContext.applicationId}"
    if where not in _FOLDERS:
        _FOLDERS.add(where)
        atexit.register(remove, spark, where)
    return where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables."""
    jvm = spark._jvm
    with contextlib.suppress(Exception):  # at the end the JVM may be gone already
        at = jvm.org.apache.hadoop.fs.Path(path)
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


def save(index: Any, path: str, compression: str = "auto") -> None:
    """Write the tables; postings and terms lie sorted by term, so that a term's row groups are found by their bounds.

    Postings are sorted in partitions of bounded size; the number of these follows that of the postings.
    """
    from ..operators.build import pieces, with_df

    if compression not in CODECS:
        raise ValueError(f"unknown compression: {compression}")
    t, o = index.tables, index.options
    codec = CODECS[compression]
    put = lambda df, name: df.write.mode("overwrite").option("compression", codec).parquet(f"{path}/{name}")
    put(t.docs, "docs")
    put(t.lengths, "lengths")
    n = t.pieces()
    terms = cut(t.terms)
    # Of an index that was read, postings have their df already.
    postings = t.postings if t.counted is None else with_df(t.counted, terms.repartition(n, "term"), n)
    by = ["term", "field_id", "doc_ord"]
    put(postings.repartitionByRange(pieces(t.size), *by).sortWithinPartitions(*by), "postings")
    put(terms.repartitionByRange(n, "term").sortWithinPartitions("term", "field_id"), "terms")
    release(terms)
    meta = json.dumps({"fields": list(o.fields), "id_field": o.id_field, "store_fields": list(o.store_fields), "averages": list(t.averages), "count": t.count, "version": 1})
    spark = t.docs.sparkSession
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str, options: Any = None) -> Any:
    """Read an index. Functions aren't saved, so give ``options`` to have others than the defaults; its fields have to be the same."""
    from ..index import SearchIndex
    from ..operators.build import IndexOptions, Tables

    meta = json.loads("".join(r["value"] for r in spark.read.text(f"{path}/meta").collect()))
    if options is not None and set(options.fields) != set(meta["fields"]):
        raise ValueError(f"fields {sorted(options.fields)} differ from those of the index, {sorted(meta['fields'])}")
    saved = {"fields": tuple(meta["fields"]), "id_field": meta["id_field"], "store_fields": tuple(meta["store_fields"])}
    o = IndexOptions(**saved) if options is None else IndexOptions(**{**options.__dict__, **saved})
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return SearchIndex(Tables(read("docs"), read("postings"), read("terms"), read("lengths"), tuple(meta["averages"]), meta["count"]), o)
