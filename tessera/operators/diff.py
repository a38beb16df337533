"""Differences: multisets of rows, lines of texts, fingerprints of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import clip, lines


def new_instances(before: DataFrame, after: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows of ``after`` beyond as many of their key as ``before`` has: the
    first ones, in order, are excused."""
    known = before.groupBy(*key).agg(F.count(F.lit(1)).alias("_before"))
    numbered = after.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    condition = [numbered[k].eqNullSafe(known[k]) for k in key]
    joined = numbered.join(known, condition, "left").where(F.col("_k") > F.coalesce("_before", F.lit(0)))
    return joined.select(*(numbered[c] for c in after.columns))


def one_per_line(diags: DataFrame, order: str = "ord") -> DataFrame:
    """The first diagnostic of each file and line."""
    return diags.withColumn("_k", F.row_number().over(Window.partitionBy("file", "line").orderBy(order))).where("_k = 1").drop("_k")


def anchor(diags: DataFrame, ops: DataFrame) -> DataFrame:
    """``diags`` with op_index and node_id of the edit whose node holds the line:
    the one that begins last (of those, the last in the batch), else null.
    ``ops``: idx, file, node_id, start_line, end_line."""
    held = diags.join(ops, "file").where("start_line <= line and line <= end_line")
    best = held.groupBy("file", "code", "message", "line", "ord").agg(F.max_by(F.struct("idx", "node_id"), F.struct("start_line", "idx")).alias("_op"))
    return diags.join(best, ["file", "code", "message", "line", "ord"], "left").select(*diags.columns, F.col("_op.idx").alias("op_index"), F.col("_op.node_id").alias("node_id"))


def line_receipt(before: DataFrame, after: DataFrame, id_col: str = "id", per_file: int = 6, width: int = 120) -> DataFrame:
    """id, k, sign, line: the lines that a text lost ("-"), then those that it
    gained ("+"), as multisets, in order, at most ``per_file`` for a file."""

    def cut(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).alias("id"), F.posexplode(lines(F.col("text"))).alias("at", "line"))

    def beyond(a: DataFrame, b: DataFrame, sign: str) -> DataFrame:
        return new_instances(b, a, ["id", "line"], ["at"]).select("id", F.lit(sign).alias("sign"), "at", "line")

    old, new = cut(before), cut(after)
    rows = beyond(old, new, "-").unionByName(beyond(new, old, "+"))
    order = Window.partitionBy("id").orderBy(F.desc("sign"), "at")  # "-" is after "+"
    numbered = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_file)
    return numbered.select("id", "k", "sign", clip(F.rtrim("line"), width).alias("line"))


def fingerprint_diff(stored: DataFrame, current: DataFrame, reread: DataFrame | None = None) -> DataFrame:
    """path, state (added, changed, missing) of two fingerprints (path, hash).

    Marker paths ("//...") are only compared where both have them. A stored
    path that the walk didn't see is compared with ``reread`` (path, hash) if
    given: it may be there still, unseen.
    """
    both = stored.select("path", F.col("hash").alias("_old")).join(current.select("path", F.col("hash").alias("_new")), "path", "full")
    if reread is not None:
        both = both.join(reread.select("path", F.col("hash").alias("_seen")), "path", "left").withColumn("_new", F.coalesce("_new", F.when(F.col("_old").isNotNull(), F.col("_seen"))))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), F.when(~F.startswith("path", F.lit("//")), "missing")).when(F.col("_old") != F.col("_new"), "changed")
    return both.select("path", state.alias("state")).where("state is not null")


def drift_reason(changes: DataFrame) -> DataFrame:
    """One row: why an index is out of date, null if it isn't."""
    said = {"added": "added", "changed": "changed", "missing": "removed/unreadable"}
    parts = [F.when(F.sum(F.when(F.col("state") == k, 1)) > 0, F.concat(F.sum(F.when(F.col("state") == k, 1)).cast("string"), F.lit(f" file(s) {w} (e.g. "), F.min(F.when(F.col("state") == k, F.col("path"))), F.lit(")"))) for k, w in said.items()]
    return changes.agg(F.nullif(F.concat_ws(", ", *parts), F.lit("")).alias("reason"))


def edit_order(ops: DataFrame) -> DataFrame:
    """``ops`` (batch, idx, structural, file, start_line) with ``position``:
    runs of structural ops are applied by file, from the bottom up; the others
    keep their place."""
    by = Window.partitionBy("batch").orderBy("idx")
    run = F.sum(F.when(F.col("structural") & F.coalesce(F.lag("structural").over(by), F.lit(False)), 0).otherwise(1)).over(by)
    numbered = ops.withColumn("_run", run)
    order = Window.partitionBy("batch").orderBy("_run", F.when(F.col("structural"), F.col("file")), F.when(F.col("structural"), -F.col("start_line")), "idx")
    return numbered.withColumn("position", F.row_number().over(order)).drop("_run")


def identity(columns: list[str]) -> Column:
    return F.concat_ws(":", *columns)
