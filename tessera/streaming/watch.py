"""Keeping tables up to date from a stream of changes."""

from __future__ import annotations



from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.config import Config
from tessera.sources import snapshot

CHANGE = "path string, lang string, mtime_ms double, text string, deleted boolean, seq long"


def latest(changes: DataFrame) -> DataFrame:
    """Of several changes to a path, the last."""
    order = Window.partitionBy("path").orderBy(F.desc("seq"))
    return changes.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def apply_changes(spark: SparkSession, folder: str, changes: DataFrame, config: Config = Config()) -> str:
    """One micro-batch into the index: a new version, or none if nothing changed.
    Applying a batch again gives the same tables."""
    last = latest(changes).persist()
    try:
        if last.isEmpty():
            return snapshot.current(folder) or ""
        index = snapshot.load(spark, folder)
        gone = last.where("deleted").select("path")
        new = last.where("not coalesce(deleted, false)").select("path", "lang", "mtime_ms", "text")
        return snapshot.save(snapshot.update(spark, index, new, gone, config), folder)
    finally:
        last.unpersist()


def watch(changes: DataFrame, folder: str, checkpoint: str, config: Config = Config(), available_now: bool = True) -> StreamingQuery:
    """Maintain the index in ``folder`` from a streaming DataFrame of changes."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: apply_changes(df.sparkSession, folder, df, config) and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def overlay_nodes(base: DataFrame, overrides: DataFrame, key: str = "file") -> DataFrame:
    """Reads that see edits not yet indexed: the rows of overridden files are
    replaced; a deleted file has none in ``overrides`` but its key."""
    kept = base.join(overrides.select(key).distinct(), key, "left_anti").select(*base.columns)
    return kept.unionByName(overrides.where("not deleted").select(*base.columns))


def running_counts(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per type and window, for streams with a time column ``ts``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"))


