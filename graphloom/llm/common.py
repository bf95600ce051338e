"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes other than space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Used only where the session names no shared checkpoint folder and its master is local (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Bytes of an Arrow batch, so that a worker's batch is bounded by its size and not by its rows.
BATCH_BYTES = 8 << 20
#: Rows of a side that is broadcast.
SMALL = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = LOCAL_CHECKPOINTS
        os.makedirs(found, exist_ok=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound the session's Arrow batches by bytes. A smaller bound that is set already stays. The
    setting is read when a plan runs, which may be after an operator has returned, so it is left set;
    it changes no result."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


def lean(make: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker's function that gives its memory back to the system at its end. Workers are reused,
    and what one stage has used would else stay beside what the next one needs."""

    def each(batches: Iterator) -> Iterator:
        try:
            yield from make(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return each


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, to be broadcast if it is at most `most` rows (narrow ones, a few MB); else joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def trimmed(spark: SparkSession) -> None:
    """Let executors collect their garbage and give that memory back to the system. A heap that one
    stage has grown stays else beside the Python workers of the next. Each core gets a task, so a
    busy executor may be left out; that changes no result."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, and trim the
    executors. It does so when the driver collects garbage, which may be long after an operator's
    rounds have filled the disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trimmed(spark)


def saved(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_text(id_col: str | Column) -> Column:
    """An id as text; null is the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(c.cast("string"), F.lit(""))


def id_crc(id_col: str | Column) -> Column:
    return F.crc32(F.encode(id_text(id_col), "UTF-8"))


def word_count(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        x = f"__{name}"
        while x.lower() in used:
            x += "_"
        used.add(x.lower())
        out.append(x)
    return out
