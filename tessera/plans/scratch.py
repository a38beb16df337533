"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset, and
    everything runs on one machine, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once and read from there: what several branches of a plan
    use isn't computed again for each, and a lost executor costs no more than
    the step that is running."""
    path = f"{folder(df.sparkSession)}/tessera-{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    """Remove a table when the driver's Python ends."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may have gone already; the folder is temporary
        return
