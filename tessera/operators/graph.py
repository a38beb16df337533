"""Import graphs as edge tables (src imports dst)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.plans.scratch import kept


def reverse(edges: DataFrame) -> DataFrame:
    """file, importers: who imports a file, sorted, each once."""
    pairs = edges.select(F.col("dst").alias("file"), "src").distinct()
    return pairs.groupBy("file").agg(F.array_sort(F.collect_list("src")).alias("importers"))


def reverse_pairs(edges: DataFrame) -> DataFrame:
    """(file, importer) for every edge, repeated ones included."""
    return edges.select(F.col("dst").alias("file"), F.col("src").alias("importer"))


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, file, hop: all files that import ``start`` directly or through
    others, with the least number of steps; the start itself is left out.

    One join per round from the files reached last, less those seen before;
    every round is written, so plans stay short and a lost executor costs one
    round. Safe on cycles; ends with the frontier.
    """
    pairs = kept(edges.select("src", "dst").distinct())
    frontier = kept(starts.select(F.col(starts.columns[0]).alias("start")).distinct().select("start", F.col("start").alias("file")))
    rounds, seen = [], frontier
    for hop in count(1):
        reached = frontier.join(pairs, frontier["file"] == pairs["dst"]).select("start", F.col("src").alias("file")).distinct()
        frontier = kept(reached.join(seen, ["start", "file"], "left_anti"))
        if frontier.isEmpty():
            break
        rounds.append(frontier.withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    if not rounds:
        return frontier.limit(0).withColumn("hop", F.lit(0))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """query_id, file, hop, reason: files within ``hops`` steps of a query's
    seeds, in both directions, without the seeds.

    What a frontier file imports is ``imported-by-seed``, who imports it
    ``imports-seed``; at one hop the former wins. The hops are unrolled, as
    they are few.
    """
    pairs = edges.select("src", "dst").distinct()
    both = pairs.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), F.lit(0).alias("_way")).unionByName(pairs.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), F.lit(1).alias("_way")))
    seen = seeds.select("query_id", "file").distinct()
    frontier, found = seen, None
    for hop in range(1, hops + 1):
        reached = frontier.join(both, frontier["file"] == both["_from"]).groupBy("query_id", F.col("_to").alias("file")).agg(F.min("_way").alias("_way"))
        new = reached.join(seen, ["query_id", "file"], "left_anti").withColumn("hop", F.lit(hop))
        found = new if found is None else found.unionByName(new)
        frontier = new.select("query_id", "file")
        seen = seen.unionByName(frontier)
    return found.select("query_id", "file", "hop", F.when(F.col("_way") == 0, "imported-by-seed").otherwise("imports-seed").alias("reason"))


def seed_adjacency(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """query_id, file, n: the seeds other than itself that a file has an edge
    with, in either direction, each counted once."""
    both = edges.select(F.col("src").alias("file"), F.col("dst").alias("_seed")).unionByName(edges.select(F.col("dst").alias("file"), F.col("src").alias("_seed"))).where("file != _seed").distinct()
    wanted = seeds.select("query_id", F.col("file").alias("_seed")).distinct()
    return both.join(wanted, "_seed").groupBy("query_id", "file").agg(F.count(F.lit(1)).alias("n"))


def definition_edges(occurrences: DataFrame) -> DataFrame:
    """src, dst from occurrences (doc, ord, symbol, is_def): the first document,
    in order, that defines a symbol owns it; every other document that mentions
    it depends on the owner."""
    owner = occurrences.where("is_def").groupBy("symbol").agg(F.min_by("doc", F.struct("ord", "doc")).alias("dst"))
    uses = occurrences.where("not is_def").select("symbol", F.col("doc").alias("src")).distinct()
    return uses.join(owner, "symbol").where("src != dst").select("src", "dst").distinct()


def union_graphs(spark: SparkSession, graphs: list[DataFrame]) -> DataFrame:
    """All edges of several providers' graphs; a provider without a resolver
    gives an empty graph, never a guess."""
    out = spark.createDataFrame([], "src string, dst string")
    for g in graphs:
        out = out.unionByName(g.select("src", "dst"))
    return out


def overlay(edges: DataFrame, overrides: DataFrame) -> DataFrame:
    """``edges`` with the targets of overridden files replaced. ``overrides``:
    file, targets (null or empty: the file has no edges)."""
    kept = edges.select("src", "dst").join(overrides.select(F.col("file").alias("src")).distinct(), "src", "left_anti")
    new = overrides.select(F.col("file").alias("src"), F.explode("targets").alias("dst"))
    return kept.unionByName(new)


def blast_radius(edges: DataFrame, changed: DataFrame, semantic: bool) -> DataFrame:
    """file: the changed files and their importers, one step of them when edges
    are semantic, all when they are syntactic."""
    files = changed.select(F.col(changed.columns[0]).alias("file")).distinct()
    if semantic:
        importers = edges.join(files, edges["dst"] == files["file"]).select(F.col("src").alias("file"))
    else:
        importers = closure(edges, files).select("file")
    return files.unionByName(importers).distinct()


def delete_refusals(edges: DataFrame, deleted: DataFrame, staged: DataFrame, import_lines: DataFrame) -> DataFrame:
    """file, importer, line: why files can't be deleted. An importer that isn't
    ``staged`` (file) refuses by its edge; one that is, by an import line (file,
    line, text) of its staged text that still names the stem."""
    gone = deleted.select(F.col("file").alias("dst"))
    importers = edges.join(gone, "dst").where("src != dst").select(F.col("dst").alias("file"), F.col("src").alias("importer")).distinct()
    importers = importers.join(deleted.select(F.col("file").alias("importer")), "importer", "left_anti")
    open_ = importers.join(staged.select(F.col("file").alias("importer")), "importer", "left_anti").withColumn("line", F.lit(None).cast("int"))
    stem = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    held = importers.join(staged.select(F.col("file").alias("importer")), "importer", "left_semi").join(import_lines.select(F.col("file").alias("importer"), "line", "text"), "importer")
    still = held.where(F.contains(F.col("text"), stem) & F.trim("text").rlike(r"^(import|use|from|mod|export|require|include|#include)\b|require\(")).select("importer", "file", "line")
    return open_.unionByName(still, allowMissingColumns=True).select("file", "importer", "line")
