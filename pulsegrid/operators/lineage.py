"""Where long plans are cut: written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, which a cluster has to name; a temporary one only on a local master, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = held.rsplit("/", 1)[0] if held else tempfile.mkdtemp(prefix="pulsegrid-")
    if held is None:
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there, so that it is computed once and lost executors cost no more."""
    shared(df.sparkSession, "")
    return df.checkpoint()
