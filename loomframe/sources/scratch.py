"""Where cut-off steps and streams keep their state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's where that is unset. Without
    either a local session gets a temporary folder; on a cluster there is none that all could reach, so it is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="loomframe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def state_path(spark: SparkSession, name: str = "state") -> str:
    """A new folder below it."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
