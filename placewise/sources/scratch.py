"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a local folder only where the session names none (tests)."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_to = tempfile.mkdtemp(prefix="placewise-")
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted when the session ends."""
    path = f"{shared_dir(spark)}/placewise-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
