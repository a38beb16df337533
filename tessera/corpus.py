"""The driver's tables as the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


class Corpus:
    """Views of the tables in a folder. Files are documents, ``f<doc_id>``; a
    document's source is its package; symbols are parts, in the file of their
    key; lines of orders are the edges between files."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang", "source")

    @property
    def files(self) -> DataFrame:
        d = self.documents
        return d.select("id", F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.col("source").alias("pkg"), "text")

    @property
    def queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), "text")

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("row_id"), "embedding", "label")

    @property
    def vector_queries(self) -> DataFrame:
        """Every twentieth vector is a query."""
        return self.vectors.where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), F.col("embedding").alias("query_vector"))

    @property
    def symbols(self) -> DataFrame:
        p = self.table("part")
        return p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file"), F.col("p_brand").alias("pkg"), F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"))

    @property
    def chunks(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select(F.col("vec_id").alias("row_id"), F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("file"), F.concat(F.lit("sym"), F.col("label").cast("string")).alias("name"), F.lit("function").alias("kind"), (F.col("vec_id") % 7 + 1).cast("int").alias("start_line"), (F.col("vec_id") % 7 + 9).cast("int").alias("end_line"))

    @property
    def packages(self) -> DataFrame:
        d = self.table("documents").select("source").distinct()
        return d.select(F.col("source").alias("name"), F.concat(F.lit("packages/"), F.col("source")).alias("dir"), F.lit(None).cast("string").alias("role"), F.array().cast("array<string>").alias("deps"))

    @property
    def file_edges(self) -> DataFrame:
        rows = self.table("lineitem")
        name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
        return rows.select(name("l_orderkey").alias("src"), name("l_partkey").alias("dst")).distinct()

    @property
    def edges(self) -> DataFrame:
        """region, nation, supplier, part: each depends on the one before."""
        tag = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
        nations = self.table("nation").select(tag("n", "n_nationkey").alias("src"), tag("r", "n_regionkey").alias("dst"))
        suppliers = self.table("supplier").select(tag("s", "s_suppkey").alias("src"), tag("n", "s_nationkey").alias("dst"))
        parts = self.table("lineitem").select(tag("p", "l_partkey").alias("src"), tag("s", "l_suppkey").alias("dst")).distinct()
        return nations.unionByName(suppliers).unionByName(parts)

    @property
    def paths(self) -> DataFrame:
        """id, path: pages' URLs without scheme, query and fragment, as paths."""
        url = F.regexp_replace(F.col("url"), "^[a-z]+://", "")
        return self.table("pages").select(F.col("page_id").alias("id"), F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/$", "").alias("path"))

    @property
    def nodes(self) -> DataFrame:
        """Ranges of lines in a file per order."""
        l = self.table("lineitem")  # noqa: E741
        return l.select(F.col("l_orderkey").alias("file"), F.concat_ws("#", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("node_id"), F.col("l_linenumber").alias("ord"), (F.col("l_linenumber") * 2).alias("start_line"), (F.col("l_linenumber") * 2 + F.col("l_quantity").cast("int")).alias("end_line"))
