"""What all plans share: the checkpoint folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

#: Used only where the session names no shared folder (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def saved(df: DataFrame) -> DataFrame:
    """Materialise in the folder that all executors share and cut the lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or LOCAL_CHECKPOINTS
        if folder == LOCAL_CHECKPOINTS:
            os.makedirs(folder, exist_ok=True)
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
