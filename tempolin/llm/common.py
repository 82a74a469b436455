"""Shared plumbing: the shared folder, lineage cuts and file access for executors."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only in local mode, where that is
    unset, a temporary folder of this machine is used.
    """
    named = spark.conf.get(_CHECKPOINT, None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{_CHECKPOINT} names no folder that the executors share")
        named = tempfile.mkdtemp(prefix="tempolin-")
        spark.conf.set(_CHECKPOINT, named)
    return named.rstrip("/")


class _Made(threading.local):
    """Scratch paths that a thread of the driver has named and not deleted: queries in other threads have their own."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder."""
    _made.paths.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made.paths[-1]


def mark() -> frozenset[str]:
    """The scratch paths that this thread has now, for :func:`clean`."""
    return frozenset(_made.paths)


def clean(spark: SparkSession, since: frozenset[str] = frozenset(), keep: DataFrame | None = None) -> None:
    """Delete the scratch tables and files that this thread made, but for those of ``since``.

    Results that read them are lazy, so call this when they have been written; ``keep`` is
    a table of :func:`cut` that stays.
    """
    stay = since if keep is None else since | {keep._scratch}
    for path in [p for p in _made.paths if p not in stay]:
        _made.paths.remove(path)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`cut` gave, once nothing reads it any more."""
    path = table._scratch
    if path in _made.paths:
        _made.paths.remove(path)
        _delete(table.sparkSession, path)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage at a table that outlives any executor, and lets several
    consumers read one result instead of computing it again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table._scratch = path
    return table


#: Keys that are met by broadcast: fewer than this.
HOT_KEYS = 2_500
#: Rows that a key must have at least for that.
HOT_ROWS = 256


def spread_join(rows: DataFrame, one: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` (``total`` of them, in a table) with the columns of ``one``, which has one row a key.

    Keys of more than ``total / HOT_KEYS`` rows are fewer than ``HOT_KEYS``, so their rows
    of ``one`` are broadcast and the rows that hold them stay where they are.  All other
    rows are shuffled, and no key has many of those.  Keys are counted first, and where
    none is hot this is a plain join.  ``how`` is inner or left; null keys meet nothing.
    """
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    found = counted.where(F.col("_n") > max(HOT_ROWS, total // HOT_KEYS)).select(key).collect()
    if not found:
        return rows.join(one, key, how)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, f"_hot {dict(rows.dtypes)[key]}"))
    some = rows.join(hot, F.col(key) == F.col("_hot"), "left_semi")
    others = rows.join(hot, F.col(key) == F.col("_hot"), "left_anti")
    known = F.broadcast(one.join(hot, F.col(key) == F.col("_hot"), "left_semi"))
    return some.join(known, key, how).unionByName(others.join(one, key, how))


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch of texts: a batch is in memory twice in the JVM and twice in the worker.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches be small by bytes, as texts can be long; a smaller setting of the session stays."""
    now = str(spark.conf.get(_BATCH_BYTES)).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def trimmed(body):
    """A function of Arrow batches that gives a worker's free memory back when a task ends.

    Workers are kept between tasks; what their allocators hold on to would count against
    the executor while the JVM works alone.
    """

    def run(batches):
        try:
            yield from body(batches)
        finally:
            import ctypes
            import gc

            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def open_fs(path: str):
    """(filesystem, path) for a folder that executors reach, by its URI or plain path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[5:]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)
