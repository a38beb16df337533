"""Line ranges of nodes: innermost, outermost, containment, islands."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window, functions as F


def innermost(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """``points`` (file, line) with node_id of the shortest range of the file
    that holds the line, the later of equals; null outside all.

    Points and nodes meet on the file first; the line is tested on those pairs.
    """
    wanted = points.select("file", "line").distinct()
    held = wanted.join(nodes.select("file", "node_id", "start_line", "end_line", "ord"), "file").where("start_line <= line and line <= end_line")
    best = held.groupBy("file", "line").agg(F.min_by("node_id", F.struct((F.col("end_line") - F.col("start_line")).alias("span"), (-F.col("ord")).alias("o"))).alias("node_id"))
    return points.join(best, ["file", "line"], "left")


def enclosing_anchor(points: DataFrame, symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """As ``innermost`` for symbols, a symbol also holding the lines of its
    ``docs`` (node_id of the symbol, start_line, end_line); the first of equals."""
    own = symbols.select("file", "node_id", "start_line", "end_line", "ord", (F.col("end_line") - F.col("start_line")).alias("span"))
    comment = docs.select("node_id", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    doc_rows = own.join(comment, "node_id").select("file", "node_id", F.col("s").alias("start_line"), F.col("e").alias("end_line"), "ord", "span")
    wanted = points.select("file", "line").distinct()
    held = wanted.join(own.unionByName(doc_rows), "file").where("start_line <= line and line <= end_line")
    best = held.groupBy("file", "line").agg(F.min_by("node_id", F.struct("span", "ord")).alias("node_id"))
    return points.join(best, ["file", "line"], "left")


def without_inner(hits: DataFrame) -> DataFrame:
    """The rows (file, node_id, start_line, end_line) that hold no other row."""
    other = hits.select("file", F.col("node_id").alias("_id"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    inside = (hits["file"] == other["file"]) & (F.col("_id") != F.col("node_id")) & (F.col("_s") >= F.col("start_line")) & (F.col("_e") <= F.col("end_line"))
    return hits.join(other, inside, "left_anti")


def outermost(ranges: DataFrame, group: str = "file") -> DataFrame:
    """The half-open ranges (group, start, end) that no earlier one overlaps:
    what eliding a text's bodies replaces. A running maximum of the ends of all
    ranges before tells nested ones; overlapping ones are dropped as well."""
    before = Window.partitionBy(group).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.where("start < end").withColumn("_reach", F.max("end").over(before)).where("_reach is null or start >= _reach").drop("_reach")


def elide(texts: DataFrame, ranges: DataFrame, placeholder: str = "{ /* … */ }", id_col: str = "file") -> DataFrame:
    """id, text with the outermost character ranges replaced."""
    kept = outermost(ranges.withColumnRenamed(id_col, "file")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_r"))
    joined = texts.select(F.col(id_col).alias("file"), "text").join(kept, "file", "left")
    step = F.aggregate(F.coalesce("_r", F.array().cast("array<struct<start:int,end:int>>")), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda acc, r: F.struct(F.concat(acc["out"], F.substring("text", acc["at"] + 1, r["start"].cast("int") - acc["at"]), F.lit(placeholder)).alias("out"), r["end"].cast("int").alias("at")), lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.char_length("text"))))
    return joined.select(F.col("file").alias(id_col), step.alias("text"))


def leading_comments(rows: DataFrame) -> DataFrame:
    """file, node_ord, start_line, end_line of the unbroken run of comment lines
    directly above each node. ``rows``: file, line, is_comment, node_ord (null
    for lines that begin no node): gaps and islands."""
    by = Window.partitionBy("file").orderBy("line")
    marked = rows.withColumn("_island", F.col("line") - F.sum(F.when(F.col("is_comment"), 1).otherwise(0)).over(by))
    islands = marked.where("is_comment").groupBy("file", "_island").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"))
    nodes = rows.where("node_ord is not null").select("file", "node_ord", (F.col("line") - 1).alias("end_line"))
    return nodes.join(islands, ["file", "end_line"]).select("file", "node_ord", "start_line", "end_line")


def dedupe_ids(rows: DataFrame, group: list[str], name: str, order: list[str]) -> DataFrame:
    """``rows`` with unique_id: the name, with ~1, ~2, ... for later ones of a
    group in order."""
    k = F.row_number().over(Window.partitionBy(*group, name).orderBy(*order)) - 1
    return rows.withColumn("_k", k).withColumn("unique_id", F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("~"), F.col("_k").cast("string")))).drop("_k")


def decode_range(ints):
    """A 0-based range of 3 or 4 integers as (start_line, end_line, start_char,
    end_char) with lines from 1; null for any other length."""
    short = F.size(ints) == 3
    end_line = F.when(short, F.element_at(ints, 1)).otherwise(F.try_element_at(ints, F.lit(3)))
    end_char = F.when(short, F.element_at(ints, 3)).otherwise(F.try_element_at(ints, F.lit(4)))
    made = F.struct((F.element_at(ints, 1) + 1).alias("start_line"), (end_line + 1).alias("end_line"), F.element_at(ints, 2).alias("start_char"), end_char.alias("end_char"))
    return F.when(F.size(ints).isin(3, 4), made)


def reanchor(nodes: DataFrame, definitions: DataFrame) -> DataFrame:
    """file, node_id, start_line, end_line: recorded nodes (file, name, node_id,
    start_line) moved to the definitions (file, name, start_line, end_line) of
    their name in the present text. Nodes are taken in order of line; each gets
    the nearest definition that no earlier one took, the first of equals; what
    finds none is dropped. Greedy within a file and name, of which a file bounds the size."""
    import pandas as pd

    left = nodes.groupBy("file", "name").agg(F.array_sort(F.collect_list(F.struct("start_line", "node_id"))).alias("nodes"))
    right = definitions.groupBy("file", "name").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line"))).alias("free"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for file, wanted, found in zip(rows["file"], rows["nodes"], rows["free"]):
                free = [(d["start_line"], d["end_line"]) for d in found]
                for node in wanted:
                    if free:
                        k = min(range(len(free)), key=lambda i: abs(free[i][0] - node["start_line"]))
                        out.append((file, node["node_id"], *free.pop(k)))
            yield pd.DataFrame(out, columns=["file", "node_id", "start_line", "end_line"])

    return left.join(right, ["file", "name"]).select("file", "nodes", "free").mapInPandas(match, "file string, node_id string, start_line int, end_line int")
