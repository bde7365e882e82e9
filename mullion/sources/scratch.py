"""A folder for what a query writes on its way: shared by the driver and all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that isn't set, a local one on a local master and an error elsewhere."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
