"""Incremental refresh of the tag snapshot.

A snapshot is a folder of Parquet with one batch per refresh. A refresh parses only files whose
(rel_path, mtime_ns) the snapshot doesn't have; reading takes each current file's own batch. The
same merge serves a stream of arriving files through foreachBatch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from graphloom.sources.tags import extract_tags

SCHEMA = "rel_path string, mtime_ns long, line int, name string, kind string, error string"


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def refresh(files: DataFrame, folder: str) -> DataFrame:
    """Parse what is new, append it, and return the current tags. files: rel_path, text, mtime_ns."""
    spark = files.sparkSession
    have = snapshot(spark, folder).select("rel_path", "mtime_ns").distinct()
    stale = files.join(have, ["rel_path", "mtime_ns"], "left_anti")
    tags = extract_tags(stale)
    # a file without tags leaves a row as well, so that it isn't parsed again
    stale.select("rel_path", "mtime_ns").join(tags, "rel_path", "left").select([c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(folder)
    now = snapshot(spark, folder).join(files.select("rel_path", "mtime_ns"), ["rel_path", "mtime_ns"], "left_semi")
    return now.filter(F.col("name").isNotNull()).select("rel_path", "line", "name", "kind").distinct()


def refresh_stream(files: DataFrame, folder: str, checkpoint: str):
    """A streaming query that keeps the snapshot up to date with arriving files."""
    return files.writeStream.foreachBatch(lambda batch, _: refresh(batch, folder) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
