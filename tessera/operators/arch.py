"""The shape of a source tree: kinds of files per directory, module templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.config import Config
from tessera.functions.paths import base_name, file_suffix, parent


def suffix_histogram(files: DataFrame, path_col: str = "path") -> DataFrame:
    """dir, suffix, n."""
    path = F.col(path_col)
    return files.select(parent(path).alias("dir"), file_suffix(base_name(path)).alias("suffix")).groupBy("dir", "suffix").agg(F.count(F.lit(1)).alias("n"))


def module_templates(histogram: DataFrame) -> DataFrame:
    """dir, module_count, template: directories of whose child directories
    (two or more, those with files of their own) at least two kinds of files
    are each in half or more."""
    children = histogram.select(F.col("dir").alias("child"), parent(F.col("dir")).alias("dir"), "suffix").where("child != ''")
    count = children.select("dir", "child").distinct().groupBy("dir").agg(F.count(F.lit(1)).alias("module_count")).where("module_count >= 2")
    kinds = children.groupBy("dir", "suffix").agg(F.count(F.lit(1)).alias("_in"))
    kept = kinds.join(count, "dir").where(F.col("_in") >= F.ceil(F.col("module_count") / 2))
    return kept.groupBy("dir", "module_count").agg(F.array_sort(F.collect_list("suffix")).alias("template")).where(F.size("template") >= 2)


def architecture(files: DataFrame, path_col: str = "path", max_files: int | None = Config().arch_files) -> DataFrame:
    """dir, files, suffixes (map), template, module_count for every directory
    with files, and every other one above them that is a module template.

    More than ``max_files`` files are refused, as a map of them is not for
    reading; None takes any number. Files without a path are in no directory:
    they stand in a row of null ``dir`` under the suffix "".
    """
    if max_files is not None and files.limit(max_files + 1).count() > max_files:
        raise ValueError(f"more than {max_files} files")
    histogram = suffix_histogram(files, path_col)
    own = histogram.groupBy("dir").agg(F.sum("n").alias("files"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("suffix", F.lit("")).alias("suffix"), "n")))).alias("suffixes"))
    rows = own.join(module_templates(histogram), "dir", "full")
    return rows.select("dir", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("suffixes", F.create_map().cast("map<string,bigint>")).alias("suffixes"), "template", F.coalesce("module_count", F.lit(0)).alias("module_count")).orderBy("dir")


def top_suffixes(histogram: DataFrame, n: int = 5) -> DataFrame:
    """dir, top: the commonest kinds, ties by name, as "kind×count, ..."."""
    order = Window.partitionBy("dir").orderBy(F.desc("n"), F.asc("suffix"))
    kept = histogram.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", "suffix", "n"))), lambda x: F.concat(x["suffix"], F.lit("×"), x["n"].cast("string")))
    return kept.groupBy("dir").agg(F.array_join(listed, ", ").alias("top"))


def format_architecture(nodes: DataFrame, subpath: str | None = None) -> DataFrame:
    """dir, line: one text per directory, below ``subpath`` if given."""
    if subpath is not None:
        nodes = nodes.where((F.col("dir") == subpath) | F.startswith("dir", F.lit(subpath + "/")))
    histogram = nodes.select("dir", F.explode("suffixes").alias("suffix", "n"))
    shown = F.when(F.col("dir") == "", ".").otherwise(F.col("dir"))
    line = F.concat(shown, F.lit("/  ("), F.col("files").cast("string"), F.lit(" files: "), F.coalesce("top", F.lit("")), F.lit(")"))
    module = F.when(F.col("template").isNotNull(), F.concat(F.lit("\n    ↳ module container: "), F.col("module_count").cast("string"), F.lit(" sub-modules, each ~ { "), F.array_join("template", ", "), F.lit(" }"))).otherwise("")
    return nodes.join(top_suffixes(histogram), "dir", "left").select("dir", F.concat(line, module).alias("line")).orderBy("dir")
