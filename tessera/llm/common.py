"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The six ASCII white-space characters, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset, and
    everything runs on one machine, a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jvm_dir.get() if jvm_dir.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove_path(spark, path)
    except Exception:  # the JVM may have gone already; the folder is temporary
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there,
    so a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Remove tables that ``written`` gave, once nothing will read them again."""
    for table in tables:
        remove_path(table.sparkSession, table.scratch)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now: it does so when
    the driver's JVM collects what referred to them. On one machine, where
    tests run, that isn't worth its time."""
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def spread_lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, spread: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which ``written`` gave: one row
    per ``key``, whose ``weight`` says how many of ``rows`` may have it.

    Keys with more than a thousandth of all weight, of which there are fewer
    than a thousand whatever the input, are broadcast; their rows go on by the
    hash of the column ``spread`` and so to all tasks alike. The others meet
    their keys in a shuffle, where none is large. Nothing is repeated.
    """
    others = [c for c in table.columns if c not in (key, weight)]
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * 1000 > F.lit(total)
    few = F.broadcast(table.where(hot).select(F.col(key), F.struct(*others).alias("_hot")))
    rest = table.where(~hot).select(F.col(key), F.lit(0).alias("_salt"), F.struct(*others).alias("_own"))
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).cast("int")
    met = rows.join(few, key, "left").withColumn("_salt", salt).join(rest, [key, "_salt"], "left")
    found = F.coalesce("_hot", "_own")
    return met.select(*rows.columns, *(found[c].alias(c) for c in others))
