"""Tables written to the folder that driver and executors share, where a plan is used more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    A local session without that setting gets a temporary folder. On a cluster executors couldn't read what another
    machine wrote there, so the setting is needed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="trackloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def keep(df: DataFrame) -> DataFrame:
    """The same rows, computed once: written below ``spark.checkpoint.dir`` and read back.

    Trackers are costly and their rows serve several joins; a table in the shared folder also outlives executors.
    Streams can't be kept.
    """
    path = folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
